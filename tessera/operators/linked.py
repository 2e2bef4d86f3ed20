"""Which symbol a forum post is about: its topic's own, or those that its text names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How sure a topic's own symbol is, and the least that a name with a condition is worth in its own topic.
THREAD, OWN = 0.9, 0.6


def linked_posts(posts: DataFrame, mentions: DataFrame, topics: DataFrame) -> DataFrame:
    """post_id, symbol, method, confidence. posts: post_id, topic_id, created_at; mentions: post_id, symbol, confidence, by_condition; topics:
    topic_id, symbol, until (from when it has no symbol of its own; null for never one)."""
    of = posts.join(topics.select("topic_id", F.col("symbol").alias("own"), "until"), "topic_id", "left")
    of = of.withColumn("default", F.when(F.col("created_at") < F.col("until"), F.col("own")))
    thread = of.where("default is not null").select("post_id", F.col("default").alias("symbol"), F.lit("thread").alias("method"), F.lit(THREAD).alias("confidence"))
    named = of.where("default is null").join(mentions, "post_id")
    own = F.col("by_condition") & ((F.col("symbol") == F.col("own")) | (F.col("own") == "any"))
    sure = F.when(F.coalesce(own, F.lit(False)), F.greatest("confidence", F.lit(OWN))).otherwise(F.col("confidence"))
    return thread.unionByName(named.select("post_id", "symbol", F.lit("linker").alias("method"), sure.alias("confidence")))
