"""Language identification with unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. The probabilities are fitted by expectation maximisation, which counts each
piece in each segmentation by that segmentation's share. Sums are kept as logarithms, each step's relative to the
step before, so that no word is too long for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_or_empty
from tessera.llm.tokens import in_parts

#: Documents of each language that are fitted on, at most about so many.
SAMPLE = 1000
ROUNDS = 3
UNKNOWN = 1e-9
#: Spans times languages that are looked at together.
AT_ONCE = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Pieces:
    """The vocabulary as sorted hashes of its pieces; ids are positions in that order, and len(hashes) + 1 stands
    for an unknown character."""

    hashes: np.ndarray
    longest: int

    @staticmethod
    def of(strings: list[str]) -> Pieces:
        hashes = np.unique(np.array([_prefixes(_codes([s]))[0, -1] for s in strings], np.uint64))
        return Pieces(hashes, max(map(len, strings)))

    def steps(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(to, rows, begins, ids) of the spans of words of one length that are pieces or single characters, for each
        place where spans end, by row."""
        prefixes = _prefixes(_codes(words))
        n = prefixes.shape[1] - 1
        powers = np.ones(self.longest + 1, np.uint64)
        for i in range(self.longest):
            powers[i + 1] = powers[i] * _BASE
        for to in range(1, n + 1):
            begins = np.arange(max(0, to - self.longest), to)
            h = prefixes[:, to, None] - prefixes[:, begins] * powers[to - begins]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            at[~known] = len(self.hashes) + 1
            known[:, -1] = True
            rows, k = np.nonzero(known)
            yield to, rows, begins[k], at[rows, k]


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


def vocabulary_pieces(model_file: str) -> list[str]:
    """Pieces of a public vocabulary that are text: no control, unknown or byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


def _by_length(words: list[str], width: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = max(1, AT_ONCE // (width * min(int(n) + 1, 64)))
        for start in range(0, len(at), rows):
            part = at[start : start + rows]
            yield part, [words[i] for i in part]


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], axis=1)


def likelihoods(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word in each language; table: (ids, languages)."""
    out = np.empty((len(words), table.shape[1]))
    with np.errstate(over="ignore"):
        for at, same in _by_length(words, table.shape[1]):
            alpha = np.zeros((len(same[0]) + 1, len(same), table.shape[1]))
            for to, rows, begins, ids in pieces.steps(same):
                last = alpha[to - 1]
                alpha[to] = last + np.log(_sums(rows, np.exp(alpha[begins, rows] - last[rows]) * table[ids], len(same)))
            out[at] = alpha[-1]
    return out


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in each language's words."""
    counts = np.zeros_like(table)
    with np.errstate(over="ignore"):
        for at, same in _by_length(words, pieces.longest):
            n, of, steps = len(same[0]), language[at], list(pieces.steps(same))
            alpha, beta = np.zeros((n + 1, len(same))), np.zeros((n + 1, len(same)))
            for to, rows, begins, ids in steps:
                last = alpha[to - 1]
                alpha[to] = last + np.log(np.bincount(rows, np.exp(alpha[begins, rows] - last[rows]) * table[ids, of[rows]], len(same)))
            # What begins at a place, gathered from the spans of all ends behind it.
            rows, begins, ids, ends = (np.concatenate(x) for x in zip(*[(r, b, i, np.full(len(r), to)) for to, r, b, i in steps]))
            order = np.argsort(-begins, kind="stable")
            rows, begins, ids, ends = rows[order], begins[order], ids[order], ends[order]
            cut = np.searchsorted(-begins, -np.arange(n - 1, -2, -1))
            for k in range(n):
                here, begin = slice(cut[k], cut[k + 1]), n - 1 - k
                r, next_ = rows[here], beta[begin + 1]
                beta[begin] = next_ + np.log(np.bincount(r, np.exp(beta[ends[here], r] - next_[r]) * table[ids[here], of[r]], len(same)))
            share = np.exp(alpha[begins, rows] + beta[ends, rows] - alpha[n, rows]) * table[ids, of[rows]]
            np.add.at(counts, (ids, of[rows]), times[at][rows] * share)
    return counts


@dataclass
class Model:
    languages: list[str]
    priors: np.ndarray
    pieces: Pieces
    table: np.ndarray


def fit(train: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """train: doc_id, text, lang. About `sample` documents of each language at most are fitted on, chosen by a hash of
    the id; of a language with fewer all, so that none is lost. The words and their numbers are counted by Spark, and the
    expected counts of each round are summed by it; a table of pieces by languages is all that reaches the driver."""
    train = train.where("lang is not null")
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(float(1 << 20)) * F.least(F.lit(1.0), sample / F.col("n"))).cast("long")
    # A row for each language, as the model has a column for each.
    train = train.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    words = train.select("lang", F.explode(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = materialise(words.groupBy("lang", "word").agg(F.count("*").cast("double").alias("n")).repartition(16, "word"), "language-words")
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return None
    languages = sorted(sums)
    pieces = Pieces.of(vocabulary_pieces(vocabulary))
    v = len(pieces.hashes)
    table = np.full((v + 2, len(languages)), 1 / v)

    for _ in range(rounds):
        table[v], table[v + 1] = 0, UNKNOWN
        held = words.sparkSession.sparkContext.broadcast(table)

        def step(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            counts = np.zeros_like(held.value)
            for b in batches:
                if len(b):
                    counts += expected_counts(pieces, held.value, ["▁" + w for w in b["word"]], np.searchsorted(languages, b["lang"].to_numpy(str)), b["n"].to_numpy())
            at, of = np.nonzero(counts)
            yield pd.DataFrame({"at": at, "of": of, "n": counts[at, of]})

        got = words.mapInPandas(step, "at int, of int, n double").groupBy("at", "of").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((v + 2, len(languages)), 0.01)
        counts[got["at"], got["of"]] += got["n"]
        counts[v:] = 0
        table = counts / counts.sum(axis=0)
    table[v], table[v + 1] = 0, UNKNOWN
    priors = np.array([sums[x] for x in languages])
    return Model(languages, priors / priors.sum(), pieces, table)


def predict(model: Model | None, docs: DataFrame, words: int = 300_000) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text). Texts without a letter, and all texts
    without a model, are und with score 0. Each worker remembers the likelihoods of up to about `words` words."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        m = held.value
        letters = regex.compile(r"\p{L}+")
        known: dict[str, int] = {}
        rows = np.empty((0, len(m.languages)))
        for batch in batches:
            for start, texts in in_parts(batch.column(1).to_pylist()):
                split = [letters.findall((t or "").lower()) for t in texts]
                if len(known) > words:
                    known, rows = {}, rows[:0]
                new = list({w for s in split for w in s if w not in known})
                if new:
                    made = likelihoods(m.pieces, m.table, ["▁" + w for w in new])
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    rows = np.concatenate([rows, made])
                best, score = [], []
                for s in split:
                    if not s:
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = rows[[known[w] for w in s]].sum(axis=0) + np.log(m.priors)
                    p = np.exp(total - total.max())
                    best.append(m.languages[int(p.argmax())])
                    score.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of docs (doc_id, text, lang); other columns are ignored.

    A null text and one without a letter are und, with score 0. Rows that repeat are each labelled; of languages that
    are equally likely the first by name is taken. Words and texts are scored whole, however long. Without a document to
    learn from all is und, and an empty table gives an empty result."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), vocabulary, sample)
    return predict(model, docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
