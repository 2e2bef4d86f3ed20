"""Keyed, repeatable writes: each gives the table as it is after the write; `replace_partitions` writes it."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conform(rows: DataFrame, like: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of `like`: absent ones null, NaN null; unknown columns, missing, null or repeated keys raise."""
    if unknown := set(rows.columns) - set(like.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if absent := set(keys) - set(rows.columns):
        raise ValueError(f"missing keys: {sorted(absent)}")
    if not rows.where(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])).isEmpty():
        raise ValueError("null keys")
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys")
    kinds = dict(like.dtypes)
    value = lambda c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) if kinds[c] in ("double", "float") else F.col(c).cast(kinds[c])
    return rows.select(*[(value(c) if c in rows.columns else F.lit(None).cast(kinds[c])).alias(c) for c in like.columns])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of new replace the stored ones, with nulls too; columns new lacks keep their values."""
    new = new.withColumn("_new", F.lit(True))
    both = stored.alias("s").join(new.alias("n"), keys, "full")
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")) if c in new.columns else F.col(f"s.{c}")
    return both.select(*keys, *[pick(c).alias(c) for c in stored.columns if c not in keys])


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First of each key in new, by order, if stored has no such key."""
    first = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def delete_keys(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti").select(*stored.columns)


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of rows that only one of two tables has."""
    return old.exceptAll(new).unionAll(new.exceptAll(old)).select(key).distinct()


def replace_partitions(rows: DataFrame, path: str, by: str | list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def normalised(rows: DataFrame, moments: list[str], dates: list[str], zone: str = "Asia/Kolkata") -> DataFrame:
    """Before a write: NaN is null, moments (text with their offset, or moments) are in UTC, and dates are those of the exchange."""
    kinds = dict(rows.dtypes)

    def value(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.nanvl(F.col(c), F.lit(None).cast(kinds[c]))
        if c in moments:
            return F.col(c).cast("timestamp")
        if c in dates:
            return F.from_utc_timestamp(F.col(c).cast("timestamp"), zone).cast("date")
        return F.col(c)

    return rows.select(*[value(c).alias(c) for c in rows.columns])


def with_default(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """rows with the column, value where it is absent or null."""
    return rows.withColumn(column, F.coalesce(F.col(column), value) if column in rows.columns else value)


def update(stored: DataFrame, changes: DataFrame, keys: list[str], also: dict[str, Column] | None = None) -> DataFrame:
    """stored with the columns of changes for the keys that changes has, nulls too; rows of other keys stay as they are and no row comes in.
    also: what further columns become in a row that is changed, in terms of stored columns."""
    changes = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys], F.lit(True).alias("_hit"))
    both, also = stored.join(changes, keys, "left"), also or {}

    def value(c: str) -> Column:
        if f"_new_{c}" in changes.columns:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.when(F.col("_hit"), also[c]).otherwise(F.col(c)) if c in also else F.col(c)

    return both.select(*[value(c).alias(c) for c in stored.columns])


def replace_scope(stored: DataFrame, new: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """stored with all rows of the scope's keys replaced by those of new, which may have none for a key: then it is cleared."""
    return delete_keys(stored, scope, keys).unionByName(new.select(*stored.columns))


def inserted(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of new that insert_absent puts in; their number is what a write reports."""
    first = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(stored.select(*keys), keys, "left_anti").select(*new.columns)


def replace_partition(rows: DataFrame, path: str, by: str, values: list[str]) -> None:
    """Writes rows as the partitions `values` of the table at path, each replaced, and cleared where rows has none."""
    spark = rows.sparkSession
    # Made once, and known before anything is replaced.
    rows = rows.persist(StorageLevel.DISK_ONLY)
    have = {str(r[0]) for r in rows.select(by).distinct().collect()}
    replace_partitions(rows, path, by)
    rows.unpersist()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for value in set(values) - have:
        gone = hadoop(f"{path}/{by}={value}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
