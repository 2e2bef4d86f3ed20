"""Exact deduplication by skew-safe combining.

Rows that are equal once white space is deleted are combined in three stages: each map task
combines its own rows (the partial aggregate), the partial groups of one salt meet, and the
winners of all salts meet. The grouping key of every stage holds the full normalised content
beside its digest, so equal digests of different contents are never merged. A group that holds
a third of all rows reaches a reducer as one row for each map task, spread over the salts.

The rows themselves never move with their text: they look up their group by digest. The groups of
more than one in HOT of all rows, HOT at most, are sent to every task, so that their rows do not move at all. Digests
that two contents share, if there are any, are looked up by digest and content.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, numbered, text_or_empty, without_blanks

#: One more code point weighs more than any doc_id.
_LENGTH = Decimal(2 * 10**19)
_MAX_ID = Decimal(2**63 - 1)


#: A group of more than one in so many rows is looked up where its rows are.
HOT = 1000


def _preference(doc_id: Column, chars: Column) -> Column:
    """Longer first, then the smaller doc_id, a null doc_id last; as one decimal, so that the
    aggregates stay hash aggregates with fixed-width buffers."""
    by_id = F.coalesce(F.lit(_MAX_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + 1, F.lit(0))
    return (chars.cast("decimal(12,0)") * F.lit(_LENGTH) + by_id).cast("decimal(38,0)")


def _preferred_id(best: Column) -> Column:
    by_id = best % F.lit(_LENGTH)
    return F.when(by_id != 0, (F.lit(_MAX_ID) + 1 - by_id).cast("long"))


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest, salts: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the columns of carry.

    docs: doc_id and text; other columns are ignored. A null text is the empty text, and all
    empty texts form one group. Ties of length go to the smallest doc_id; rows that repeat
    a doc_id are each counted, and all rows that have the kept doc_id stay. A null doc_id loses
    to any other. Very long texts are compared whole. An empty table gives an empty result.
    digest: the lookup key of a content; the result does not depend on it."""
    rows = docs.select("doc_id", *carry, text_or_empty().alias("text")).select("doc_id", *carry, F.length("text").alias("chars"), without_blanks(F.col("text")).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    by_salt = rows.groupBy("digest", "norm", salt).agg(F.count("*").alias("n"), F.max(_preference(F.col("doc_id"), F.col("chars"))).alias("best"))
    contents = by_salt.groupBy("digest", "norm").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    by_digest = materialise(contents.groupBy("digest").agg(F.count("*").alias("contents"), F.max("n").alias("group_size"), F.max("best").alias("best")), "exact-groups")

    alone = by_digest.where("contents = 1").select("digest", "group_size", "best")
    total = by_digest.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    large = F.col("group_size") > max(HOT, total // HOT)
    hot = alone.where(large).select("digest", F.col("group_size").alias("hot_size"), F.col("best").alias("hot_best"))
    out = rows.select("doc_id", *carry, "digest", F.sha2("norm", 256).alias("text_sha256")).join(F.broadcast(hot), "digest", "left")
    # A row that has its group is dealt out by what no other group has.
    out = out.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("doc_id", *carry).cast("string"))))
    cold = alone.where(~large).select(F.col("digest").alias("key"), "group_size", "best")
    out = out.join(cold, "key", "left").select("doc_id", *carry, "digest", "text_sha256", F.coalesce("hot_size", "group_size").alias("group_size"), F.coalesce("hot_best", "best").alias("best")).where("group_size is not null")
    clash = by_digest.where("contents > 1").select("digest")
    if not clash.isEmpty():
        mixed = rows.join(clash, "digest", "left_semi")
        of = mixed.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.max(_preference(F.col("doc_id"), F.col("chars"))).alias("best"))
        out = out.unionByName(mixed.join(of, ["digest", "norm"]).select("doc_id", *carry, "digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best"))
    keep = _preferred_id(F.col("best"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *carry)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: one for each normalised text, the longest of those with
    the smallest doc_id, whether or not ids repeat or are null."""
    rows, n = numbered(docs)
    kept = materialise(exact_groups(rows, carry=(n,)).where("kept").select("text_sha256", n), "exact-kept")
    by_digest = kept.groupBy("text_sha256").agg(F.count("*").alias("rows"), F.min(n).alias(n))
    stay = by_digest.where("rows = 1").select(n)
    again = by_digest.where("rows > 1").select("text_sha256")
    if not again.isEmpty():
        # Rows that share the kept doc_id: told apart by length and number, within equal contents.
        ties = rows.join(kept.join(again, "text_sha256", "left_semi").select(n), n, "left_semi")
        ties = ties.select(n, "doc_id", F.length(text_or_empty()).alias("chars"), without_blanks(text_or_empty()).alias("norm"))
        stay = stay.unionByName(ties.groupBy("norm").agg(F.min_by(n, F.struct(-F.col("chars"), n)).alias(n)).select(n))
    return rows.join(stay, n, "left_semi").drop(n)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
