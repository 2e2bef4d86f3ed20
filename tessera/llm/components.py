"""Connected components by alternating stars: every step is a grouped minimum and a join, so that
a node with very many links is no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialise, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for each id in links (a, b). Links between equal ids and
    repeated links change nothing; no links give no rows."""
    spark = links.sparkSession
    links, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        links, new = written(_small_star(_large_star(links)).where("a <> b").distinct(), "links")
        delete(spark, path)
        path = new
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, component of what components (labels) and further links (a, b) connect: only the components that these links meet are
    gone through again."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    met = components(between)
    old = labels.join(met.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return materialise(old.union(met.join(labels, "id", "left_anti").select("id", "component")), "components")
