"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the words of a text and their
stems; each model also sees the log odds of the categories before it. In training these are
out of fold: they come from models that have not seen the row, as those of a new text do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.tokens import in_parts

#: Labelled rows that are fitted on, at most about so many.
SAMPLE = 6000
#: Features of a category, those that tell most about it.
FEATURES = 1024
LEAST_ROWS = 5
FOLDS = 3
#: Lengths of the beginnings of words that are features beside the words.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.35
#: In the order of the chain.
CATEGORIES = ("low_quality", "toxic")


@dataclass
class Chain:
    """weights: for each category one weight for each feature, one for each category before, and the bias."""

    categories: list[str]
    features: dict[str, int]
    weights: list[np.ndarray]


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}-" for n in STEMS if len(word) > n]]


def _words(text: str | None, letters: object) -> set[str]:
    return set(letters.findall((text or "").lower()))


def _logistic(x: np.ndarray, y: np.ndarray, sparse: float = 2e-4, ridge: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights and bias of a logistic regression with L1 and L2 penalties, by accelerated proximal
    gradient steps. The step is that of the largest curvature, by power iteration."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    u = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        u = x.T @ (x @ (u / np.linalg.norm(u)))
    step = 1 / (np.linalg.norm(u) / (4 * len(x)) + ridge)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * (x.T @ (p - y) / len(y) + ridge * v)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparse, 0)
        v, w = (new + k / (k + 3) * (new - w)).astype(np.float32), new.astype(np.float32)
    return w


def _log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -8, 8).astype(np.float32)


def chain_weights(x: np.ndarray, fold: np.ndarray, labels: list[np.ndarray]) -> list[np.ndarray]:
    """The weights of each category's model, whose inputs are x and the log odds of the categories before. For training
    those of a row come from a model of the rows in other folds. Rows whose label is NaN train no model of that category."""
    weights = []
    for k, y in enumerate(labels):
        known = ~np.isnan(y)
        weights.append(_logistic(x[known], y[known]))
        if k + 1 < len(labels):
            out = np.zeros(len(x), np.float32)
            for f in np.unique(fold):
                own = fold == f
                rest = ~own & known
                if rest.any():
                    out[own] = _log_odds(x[own], _logistic(x[rest], y[rest]))
            x = np.hstack([x, out[:, None]])
    return weights


def fit(labelled: DataFrame, categories: list[str], folds: int = FOLDS, features: int = FEATURES) -> Chain:
    """labelled: doc_id, text and a 0/1 column for each category, in the order of the chain; a null is not used for
    that category. Its number of
    rows is bounded by the caller. Spark counts the features; the rows' chosen features, rows
    times features * categories at most, are fitted on the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letters = regex.compile(r"\p{L}+")
        for batch in batches:
            for start, texts in in_parts(batch.column("text").to_pylist()):
                found = [list({f for w in _words(t, letters) for f in word_features(w)}) for t in texts]
                rest = batch.slice(start, len(texts)).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.list_(pa.string()))], names=[*rest.schema.names, "features"])

    rows = labelled.select("doc_id", *[F.col(c).cast("int") for c in categories], F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"), "text")
    rows = materialise(rows.mapInArrow(split, ", ".join(["doc_id long", *[f"{c} int" for c in categories], "fold int", "features array<string>"])), "labelled")
    total = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories], *[F.count(c).alias(f"n_{c}") for c in categories]).first()
    if not total["n"]:
        return Chain(categories, {}, [np.append(np.zeros(k, np.float32), np.float32(-8)) for k in range(len(categories))])
    each = rows.select(*categories, F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories], *[F.count(c).alias(f"n_{c}") for c in categories]).where(F.col("n") >= LEAST_ROWS)
    chosen: dict[str, int] = {}
    for c in categories:
        # The G statistic of the table (feature or not) x (category or not), from its two cells with the feature.
        base, n = total[c] / total[f"n_{c}"], F.col(f"n_{c}")
        yes, no = F.col(c) + 0.5, n - F.col(c) + 0.5
        g = yes * F.log(yes / (n * base + 0.5)) + no * F.log(no / (n * (1 - base) + 0.5))
        for r in each.orderBy(g.desc(), "f").limit(features).select("f").collect():
            chosen.setdefault(r["f"], len(chosen))

    # At most `features` for each category, in every task.
    ids = rows.sparkSession.createDataFrame(list(chosen.items()), "f string, id int")
    pairs = rows.select("doc_id", *categories, "fold", F.explode_outer("features").alias("f")).join(F.broadcast(ids), "f", "left")
    table = pairs.groupBy("doc_id", *categories, "fold").agg(F.collect_list("id").alias("features"))
    got = table.toPandas()
    x = np.zeros((len(got), len(chosen)), np.float32)
    for k, at in enumerate(got["features"]):
        x[k, np.asarray(at, int)] = 1
    return Chain(categories, chosen, chain_weights(x, got["fold"].to_numpy(), [got[c].to_numpy(np.float32) for c in categories]))


def predict(chain: Chain, docs: DataFrame, words: int = 500_000) -> DataFrame:
    """doc_id and p_<category> for each category: a row for each row of docs (doc_id, text). A null
    or empty text has no words and gets the probability of a text without a known feature."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{c}" for c in chain.categories]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letters, chain, known = regex.compile(r"\p{L}+"), held.value, {}
        n = len(chain.features)
        for batch in batches:
            for start, texts in in_parts(batch.column(1).to_pylist()):
                if len(known) > words:
                    known.clear()
                out = np.empty((len(texts), len(chain.categories)))
                for k, t in enumerate(texts):
                    at: set[int] = set()
                    for w in _words(t, letters):
                        ids = known.get(w)
                        if ids is None:
                            ids = known[w] = tuple(chain.features[f] for f in word_features(w) if f in chain.features)
                        if ids:
                            at.update(ids)
                    at_once, before = np.fromiter(at, int, len(at)), np.zeros(0)
                    for c, w in enumerate(chain.weights):
                        odds = float(np.clip(w[at_once].sum() + w[n:-1] @ before + w[-1], -8, 8))
                        before = np.append(before, odds)
                        out[k, c] = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *[pa.array(out[:, c]) for c in range(out.shape[1])]], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, ", ".join(["doc_id long", *[f"{c} double" for c in names[1:]]]))


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic: a row for each row of docs.

    labels: doc_id, quality, toxic (0/1), fitted on about `sample` rows at most of those whose documents are in docs,
    chosen by a hash of the id. A null label is not used, the row's other one is; of labels that repeat a doc_id the largest
    counts. A category without labels of both values can't be learned: its probabilities are null, and
    nothing is toxic if it is toxic. The other one is learned without it. Rows that repeat are each scored; very long texts
    are read whole, as the set of their words; other columns are ignored. An empty table gives an empty result."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    known = materialise(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known-labels")
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n)))
    chosen = known.where(share)
    values = chosen.agg(*[F.collect_set(c).alias(c) for c in CATEGORIES]).first()
    learned = [c for c in CATEGORIES if set(values[c]) == {0, 1}]
    out = docs.select("doc_id")
    if learned:
        # `sample` rows of two columns and an id, so that every task may hold them.
        labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        out = predict(fit(labelled, learned), docs)
    p = {c: F.col(f"p_{c}") if c in learned else F.lit(None).cast("double") for c in CATEGORIES}
    return out.select("doc_id", *[p[c].alias(f"p_{c}") for c in CATEGORIES], F.coalesce(p["toxic"] >= THRESHOLD, F.lit(False)).alias("toxic"))
