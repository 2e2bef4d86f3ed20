"""Sentiment by any scorer: an object with a name, a version and a method that turns a list of texts into probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("positive", "negative", "neutral")


class Scorer(Protocol):
    """Made once in each task; load() may take long."""

    name: str
    version: str

    def load(self) -> None: ...

    def score(self, texts: list[str]) -> list[tuple[float, float, float]]:
        """Probabilities of LABELS for each text."""


class WordScorer:
    """Counts words of two lists: a scorer without a model."""

    version = "1"

    def __init__(self, good: set[str], bad: set[str], name: str = "words"):
        self.good, self.bad, self.name = frozenset(good), frozenset(bad), name

    def load(self) -> None: ...

    def score(self, texts: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for words in (t.lower().split() for t in texts):
            good, bad = sum(w in self.good for w in words), sum(w in self.bad for w in words)
            out.append((good / (good + bad + 1), bad / (good + bad + 1), 1 / (good + bad + 1)))
        return out


class ColumnScorer(Protocol):
    """A scorer that Spark computes itself."""

    name: str
    version: str

    def with_probabilities(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """rows with a struct of p_positive, p_negative and p_neutral."""


def scored(rows: DataFrame, text: str, scorer: Scorer | ColumnScorer, batch: int = 16) -> DataFrame:
    """rows with model_name, model_version, label, p_positive, p_negative, p_neutral, score. A scorer that is not columns is loaded once in each
    task, which gives it texts in batches."""

    @F.pandas_udf("p_positive double, p_negative double, p_neutral double")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer.load()
        for part in parts:
            texts = part.fillna("").tolist()
            got = [p for k in range(0, len(texts), batch) for p in scorer.score(texts[k : k + batch])]
            yield pd.DataFrame(got, columns=["p_positive", "p_negative", "p_neutral"])

    own = getattr(scorer, "with_probabilities", None)
    of = own(rows, text, "_p") if own else rows.withColumn("_p", probabilities(F.col(text)))
    return of.select(*rows.columns, F.lit(scorer.name).alias("model_name"), F.lit(scorer.version).alias("model_version"), label(F.col("_p")).alias("label"), "_p.*", (F.col("_p.p_positive") - F.col("_p.p_negative")).alias("score"))


def label(p: Column) -> Column:
    """The likeliest label; of equal ones the first."""
    most = F.greatest(*[p[f"p_{x}"] for x in LABELS])
    return F.coalesce(*[F.when(p[f"p_{x}"] == most, F.lit(x)) for x in LABELS])


def pending(rows: DataFrame, stored: DataFrame, keys: list[str], scorer: Scorer) -> DataFrame:
    """Of rows those that the scorer has not scored."""
    return rows.join(stored.where(F.col("model_name") == scorer.name).select(*keys), keys, "left_anti")


def by_session(mentions: DataFrame, negative: float = -0.5) -> DataFrame:
    """symbol, session_date, story_count, article_count, mean_score, weighted_score, strong_negative_stories, latest_first_seen_at.

    mentions: article_id, symbol, story, score, confidence, first_seen_at, session_date. Copies are one story, of the first session of any."""
    story = mentions.groupBy("symbol", "story").agg(F.min("session_date").alias("session_date"), F.avg("score").alias("score"), F.max("confidence").alias("confidence"), F.count_distinct("article_id").alias("articles"), F.max("first_seen_at").alias("seen"))
    return story.groupBy("symbol", "session_date").agg(F.count("*").alias("story_count"), F.sum("articles").alias("article_count"), F.avg("score").alias("mean_score"), F.try_divide(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")).alias("weighted_score"), F.count_if(F.col("score") <= negative).alias("strong_negative_stories"), F.max("seen").alias("latest_first_seen_at"))
