"""Token ids of texts, by a public tokenizer whose tokens never cross white space."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordEncoder:
    """Encodes texts word by word and remembers words: the tokenizer drops white space and no token
    crosses it, so a text's ids are those of its words in a row. Its letters end where punctuation
    begins and it folds case, so that words are remembered without their closing punctuation and in lower case.
    When the memory would hold more than `words` entries, the half that fewest calls have met goes.

    special_as_text: whether the strings of special tokens in a text are ordinary text; else they
    give their ids, as the tokenizer has it unless told otherwise."""

    def __init__(self, path: str, special_as_text: bool = False, words: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = words
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        # Where a word's ids begin, how many they are, and in how many calls it was met, which counts for half after each forgetting.
        self.begin, self.count, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        n = len(self.known)
        kept = np.sort(np.argsort(-self.met[:n], kind="stable")[: self.words // 2])
        words, count = list(self.known), self.count[kept]
        upto = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[kept] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]
        met, self.known, self.used = self.met[kept] // 2, {}, 0
        self._remember([words[k] for k in kept.tolist()], ids, count)
        self.met[: len(kept)] = met

    def _encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.begin):
            self.begin, self.count, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.met[n : n + len(words)] = 0
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn(self, words: list[str]) -> None:
        """Words of letters are encoded in a row and told apart by the tokens that end a word; the row is given
        up if there are other ends than theirs."""
        letters = pc.utf8_is_alpha(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).tolist()
        rest = [w for w, x in zip(words, letters) if not x]
        alone = [w for w, x in zip(words, letters) if x]
        for at in range(0, len(alone), 500):
            part = alone[at : at + 500]
            ids = np.array(self._encoded([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                self._remember(part, ids, np.diff(ends, prepend=-1))
            else:
                rest += part
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            ids = self._encoded(part)
            self._remember(part, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (with the end of the last one)."""
        texts = texts.fill_null("")
        # Special tokens begin with these signs and are told by case.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.known.get, words))
        if None in at:
            new = [w for w, k in zip(words, at) if k is None]
            if len(self.known) + len(new) > self.words:
                self._forget()
                new = [w for w in words if w not in self.known]
            self._learn(new)
            at = list(map(self.known.get, words))
        at = np.array(at, np.int64)
        self.met[at] += 1
        at = at[coded.indices.to_numpy()]
        counts = self.count[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.begin[at] - upto[:-1], counts) + np.arange(upto[-1])]
        offsets = split.offsets.to_numpy().astype(np.int64)
        return ids, upto[offsets - offsets[0]]


@lru_cache(maxsize=1)
def word_encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """A Python worker's encoder, which later tasks of that worker find with the words that it knows."""
    return WordEncoder(path, special_as_text)


def ended(ids: np.ndarray, begin: np.ndarray, end: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """ids with the end id behind each text, and where each text's begin."""
    n = len(begin) - 1
    moved = begin + np.arange(n + 1)
    out, last = np.empty(moved[-1], kind), np.zeros(moved[-1], bool)
    last[moved[1:] - 1] = True
    out[last], out[~last] = end, ids
    return out, moved


def in_parts(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) in runs of about that many characters, so that a batch of long texts needs
    little memory at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def array_parts(texts: pa.Array, size: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """The same of an array, by bytes."""
    run = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(run, (run[start - 1] if start else 0) + size)))
        yield start, texts.slice(start, end - start)
        start = end
