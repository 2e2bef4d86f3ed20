"""Connected components by the smallest label: each round takes the least label of a node's neighbours and then that
label's own label, so that long chains shorten quickly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, growing


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in links (a, b)."""
    # Both ways from one reading: what makes the links may be long.
    ways = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    both = cut(links.where("a <> b").select(F.explode(ways).alias("way")).select("way.id", "way.other").distinct())
    labels = cut(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")))
    while True:
        of = labels.select(F.col("id").alias("other"), F.col("component").alias("near"))
        least = both.join(growing(of), "other").groupBy("id").agg(F.min("near").alias("near"))
        new = labels.join(growing(least), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = cut(new.join(growing(jump), "component", "left").select("id", "was", F.least("component", "far").alias("component")))
        if new.where("was <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
