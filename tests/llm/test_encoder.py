"""The encoder that the tasks of a worker share."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_a_worker_keeps_its_encoder_and_the_words_that_come_often():
    assert tokens.word_encoder(VOCABULARY) is tokens.word_encoder(VOCABULARY)
    encoder, plain = tokens.WordEncoder(VOCABULARY, words=40), Tokenizer.from_file(VOCABULARY)
    for k in range(20):
        text = "often met words " + " ".join(f"rare{k}x{i}" for i in range(12))
        ids, begin = encoder.encode(pa.array([text, None, text[:20]]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + plain.encode(text[:20], add_special_tokens=False).ids and begin[1] == begin[2]
        assert len(encoder.known) <= 40
    assert {"often", "met", "words"} <= set(list(encoder.known)[:20])
