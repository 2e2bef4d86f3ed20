"""As-of joins: each row with the last, or next, row of another table by time. Both tables are put into one and sorted once within their
keys; no row meets more than one other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, columns: dict[str, str], forward: bool = False, same: bool = True) -> DataFrame:
    """left with columns (of right, under new names) of the row of right with the same keys that is the last one up to left's time `at`,
    or the next one from it on; null where there is none.

    right's time is `when`; same: whether a row of just that time counts. Of right's rows of one time one stands for all, so that its rows
    should be unique by keys and time. Rows of left without a time have no match; all rows of left stay."""
    dated = right.where(F.col(when).isNotNull())
    side = lambda df, time, own, other: df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), own, other)
    kept = F.struct(*left.columns).alias("_left")
    found = F.struct(*[F.col(c).alias(n) for c, n in columns.items()]).alias("_right")
    kinds = {"left": left.select(kept).schema["_left"].dataType, "right": dated.select(found).schema["_right"].dataType}
    both = side(left, at, kept, F.lit(None).cast(kinds["right"]).alias("_right")).unionByName(side(dated, when, F.lit(None).cast(kinds["left"]).alias("_left"), found))
    # Where a row of the same time counts, it comes before the row that looks for it.
    mine = F.col("_left").isNotNull()
    time = F.desc_nulls_last("_t") if forward else F.asc_nulls_last("_t")
    order = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(time, (mine if same else ~mine).asc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = F.when(F.col("_t").isNotNull(), F.last("_right", ignorenulls=True).over(order))
    return both.withColumn("_right", hit).where(mine).select("_left.*", *[F.col("_right")[n].alias(n) for n in columns.values()])
