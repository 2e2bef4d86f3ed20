"""Numbers within a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, order: str, name: str, width: int = 20_000) -> DataFrame:
    """rows with their number (from 1) within the key by `order`, a whole number: ranges of it are ranked each by itself, and the ranges' counts are added up."""
    of = rows.withColumn("_range", F.floor(F.col(order) / width))
    base = of.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(W.partitionBy(key).orderBy("_range")) - F.col("_n")).drop("_n")
    of = of.withColumn("_nth", F.row_number().over(W.partitionBy(key, "_range").orderBy(order))).join(base, [key, "_range"])
    return of.select(*rows.columns, (F.col("_base") + F.col("_nth")).cast("int").alias(name))
