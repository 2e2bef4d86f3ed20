"""News as a stream: what arrives is linked, scored and stored, and the sessions that it touches are made anew.

Both tables are written in partitions that follow from a batch's number and rows alone: a batch that runs again after a failure, at whatever
point, leaves what it would have left. Rows may come late by any time, as no state is held but the tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.calendar import known_moment, with_session
from tessera.operators.scoring import Scorer, by_session, scored
from tessera.operators.sinks import replace_partition, replace_partitions

ARTICLE = ("id", "story_id", "published_at", "first_seen_at")


def _dates(rows: DataFrame) -> list[dt.date]:
    """The sessions of rows: as many as there are trading days."""
    return sorted(r[0] for r in rows.select("session_date").distinct().collect())


class Desk:
    """The two tables under a folder that driver and executors share.

    `mentions`: article_id, symbol, story, score, confidence, first_seen_at by session and batch; an article that names nobody has a row without
    symbol, which says that it has been read. `daily`: sentiment by session and symbol.

    link: a function of articles that gives id, symbol, confidence and text, what the scorer reads; days: a calendar that has the articles' days.
    An article is taken once, the first time that its id arrives (in one batch: the one seen first); one without id, or without any moment, is stored and
    counts for no session. least: how sure a mention must be to be scored."""

    def __init__(self, spark: SparkSession, folder: str, days: DataFrame, link: Callable[[DataFrame], DataFrame], scorer: Scorer, least: float = 0.5):
        self.spark, self.days, self.link, self.scorer, self.least = spark, days, link, scorer, least
        self.mentions, self.daily, self.offsets = (f"{folder}/{name}" for name in ("mentions", "daily", "offsets"))
        for path in (self.mentions, self.daily):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def _stored(self, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.mentions)

    def _new(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose id no earlier batch has brought. The stored ids are cut down to those of the batch where they lie, so that
        the join's other side is no larger than the batch."""
        first = W.partitionBy("id").orderBy("first_seen_at", *sorted(set(rows.columns) - {"id", "first_seen_at"}))
        rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1 or id is null").drop("_r")
        ids = StructType([f for f in self._schema(rows) if f.name in ("article_id", "batch")])
        seen = self._stored(ids).where(F.col("batch") < batch).select(F.col("article_id").alias("id")).join(rows.select("id"), "id", "left_semi")
        return rows.join(seen, "id", "left_anti")

    def _schema(self, rows: DataFrame) -> StructType:
        kinds = dict(rows.dtypes)
        story = self.spark.sql(f"SELECT coalesce(CAST(NULL AS {kinds['story_id']}), CAST(NULL AS {kinds['id']})) AS s").dtypes[0][1]
        return StructType.fromDDL(f"article_id {kinds['id']}, symbol string, story {story}, score double, confidence double, first_seen_at timestamp, session_date date, batch long")

    def take(self, rows: DataFrame, batch: int) -> None:
        new = self._new(rows, batch)
        named = scored(self.link(new).where(F.col("confidence") >= self.least).select("id", "symbol", "confidence", "text"), "text", self.scorer).select("id", "symbol", "confidence", "score")
        known = new.select(*ARTICLE).withColumn("moment", known_moment("published_at", "first_seen_at"))
        dated = with_session(known, "moment", self.days).join(named, "id", "left")
        out = dated.select(F.col("id").alias("article_id"), "symbol", F.coalesce("story_id", "id").alias("story"), "score", "confidence", "first_seen_at", "session_date", F.lit(batch).cast("long").alias("batch"))
        replace_partitions(out, self.mentions, ["session_date", "batch"])
        self.rebuild(self._schema(rows), batch)

    def rebuild(self, schema: StructType, batch: int) -> None:
        """The sessions in which any copy of the batch's stories lies: a late copy may move its story to an earlier one. Files of other
        sessions are read for symbol and story only, and those for scores only where stories of these sessions have copies."""
        stored = self._stored(schema).where((F.col("batch") <= batch) & F.col("symbol").isNotNull() & F.col("session_date").isNotNull())
        of = lambda rows: stored.join(rows.select("symbol", "story").distinct(), ["symbol", "story"], "left_semi")
        touched = _dates(of(stored.where(F.col("batch") == batch)))
        if touched:
            reached = _dates(of(stored.where(F.col("session_date").isin(touched))))
            daily = by_session(stored.where(F.col("session_date").isin(reached))).where(F.col("session_date").isin(touched))
            replace_partition(daily, self.daily, "session_date", [str(d) for d in touched])

    def start(self, articles: DataFrame) -> StreamingQuery:
        """Takes all that a stream of articles (ARTICLE and what link reads) holds, from where the last run has ended, and stops."""
        return articles.writeStream.foreachBatch(self.take).option("checkpointLocation", self.offsets).trigger(availableNow=True).start()

    def sentiment(self) -> DataFrame:
        return self.spark.read.schema(SENTIMENT).parquet(self.daily)


SENTIMENT = "symbol string, story_count long, article_count long, mean_score double, weighted_score double, strong_negative_stories long, latest_first_seen_at timestamp, session_date date"
