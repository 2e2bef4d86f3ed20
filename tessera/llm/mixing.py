"""Mixing sources to target weights.

Each source's documents stand in a shuffled order, whose words are one stream, cut into
blocks of equal word counts; a source that is to give more than it has starts over. Slot t of
the mix takes the point frac(t * golden ratio), and the source whose interval of
cumulative weights holds that point gives its next block, until its target is met: the last block is cut to it. Slots are ranked
per source, and the rank names the block, so that slots and blocks meet in a join on (source, block). There are some
more slots than blocks, as the points are near the weights but not on them; slots of a source that is done stay empty, and
a source so small that the points missed it gives its last blocks at the end.

Both running numbers, of words within a source and of slots within a source, are
taken within small ranges first and then over the ranges, so that a source with a third of all
rows is not sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, numbered, text_or_empty, words_of

#: 2^32 divided by the golden ratio, odd: slot * GOLDEN modulo 2^32 is a golden-ratio sequence
#: in integers, the same on any engine. It repeats after 2^31 slots.
GOLDEN = 2654435769
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 256
#: Slots beyond the blocks: one in SPARE, and LEAST_SPARE.
SPARE = 64
LEAST_SPARE = 256
#: What one sort ranks: slots, and rows of a source.
SLOTS_A_RANGE = 1 << 16
ROWS_A_RANGE = 20_000
#: Parts of the unit interval by which points meet the sources there.
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, k (its rank by code point, null last), source_size, weight, target, low, high:
    a row for each source of sizes (source, size).

    Targets divide share * (all words) by weight. A target stops at most * source_size, and
    what it can't take goes to the others by weight until none is above. With the sources in the
    order in which they stop, the level that is left for one and those behind it rises as long as it
    stops below that level and falls from then on, so that the largest is the one that holds. low and high bound the source's interval of
    cumulative targets in [0, 2^32). The windows here run over one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(w) for w in weights])
    by = by.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("_stop", F.col("cap") / F.col("weight"))
    order, every = W.orderBy("_stop", "k"), W.orderBy("_stop", "k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("_left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("_level", F.col("_left") / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("_level", F.max("_level").over(every))
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_level")))
    # In whole words, whose sums are exact in any order.
    by = by.withColumn("words", F.round("target").cast("long"))
    run = F.try_divide(F.sum("words").over(W.orderBy("k")), F.sum("words").over(every))
    by = by.withColumn("high", F.coalesce(F.floor(run * F.lit(2.0**32)), F.lit(0)))
    return by.select("source", "k", "source_size", "weight", "target", "words", F.coalesce(F.lag("high").over(W.orderBy("k")), F.lit(0)).alias("low"), "high")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, k, rank, words: the mix, a row for each slot that takes a block of source k, its rank-th, with so many words."""
    spark = targets.sparkSession
    need = targets.select("k", "low", "high", "words", F.ceil(F.col("words") / block).alias("blocks"))
    size = need.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.count("*").alias("sources")).first()
    n_slots = size["blocks"] + size["blocks"] // SPARE + LEAST_SPARE
    cell = lambda x: F.floor(x / F.lit(2**32 // CELLS))
    there = need.where("high > low").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(2**31)) * F.lit(GOLDEN), F.lit(2**32)).alias("x")).withColumn("cell", cell(F.col("x")))
    of = points.join(there, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).withColumn("part", F.floor(F.col("slot") / SLOTS_A_RANGE))
    base = of.groupBy("k", "part").agg(F.count("*").alias("n"))
    base = materialise(base.withColumn("base", F.sum("n").over(W.partitionBy("k").orderBy("part")) - F.col("n")), "mix-slots")
    ranked = of.withColumn("r", F.row_number().over(W.partitionBy("k", "part").orderBy("slot"))).join(base.select("k", "part", "base"), ["k", "part"])
    got = ranked.select("slot", "k", (F.col("base") + F.col("r") - 1).alias("rank"), "words", "blocks").where("rank < blocks")
    # As many as the points have missed, a few for each source.
    have = base.groupBy("k").agg(F.sum("n").alias("have"))
    missed = need.join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks")
    missed = missed.withColumn("rank", F.explode(F.sequence("have", F.col("blocks") - 1)))
    late = missed.select((n_slots + F.col("rank") * size["sources"] + F.col("k") - 1).alias("slot"), "k", "rank", "words", "blocks")
    return got.unionByName(late).select("slot", "k", "rank", F.least(F.lit(block), F.col("words") - F.col("rank") * block).alias("words"))


def _streams(sizes: DataFrame, targets: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """sizes with the start of each document in its source's shuffled stream; carry tells equal rows apart."""
    ranges = -(-sizes.count() // ROWS_A_RANGE)
    at = sizes.join(targets.select("source", "k", "source_size", "target"), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    at = at.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    at = at.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2.0**32)))
    base = at.groupBy("k", "part").agg(F.sum("size").alias("n"))
    base = base.withColumn("base", F.sum("n").over(W.partitionBy("k").orderBy("part")) - F.col("n")).select("k", "part", "base")
    order = W.partitionBy("k", "part").orderBy("key", "doc_id", "size", *carry)
    at = at.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return at.join(base, ["k", "part"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))


def _placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of mix, those of carry, start (in the source's stream) and slots: for each time that the stream
    is run through, the first slot that holds words of the row."""
    sizes = materialise(docs.select("doc_id", "source", *carry, F.size(words_of(text_or_empty())).cast("long").alias("size")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    slots = schedule(targets, block).withColumnRenamed("k", "_k")

    # The places of a source's blocks modulo its size: block b of the mix starts at
    # b * block, in the epoch floor(b * block / source_size). Document words [start, start + size)
    # of epoch e stand at e * source_size + start.
    placed = _streams(sizes, targets, carry).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
    last = F.floor((F.col("from") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    pieces = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), last)))
    meet = (F.col("k") == F.col("_k")) & (F.col("rank") == F.col("_rank"))
    pieces = pieces.join(slots.withColumnRenamed("rank", "_rank"), meet, "left")
    begin = F.greatest(F.col("from"), F.col("rank") * block)
    end = F.least(F.col("from") + F.col("size"), F.col("rank") * block + F.col("words"))
    pieces = pieces.withColumn("got", F.when(F.col("words").isNotNull(), F.greatest(end - begin, F.lit(0))).otherwise(0))
    slot_of = [F.min(F.when((F.col("got") > 0) & (F.col("epoch") == e), F.col("slot"))) for e in range(most)]
    out = pieces.groupBy("k", "part", "nth", "doc_id", "source", *carry, "size", "source_size", "target", "start").agg(F.sum("got").alias("taken"), F.array(*slot_of).alias("slots"))
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"), "start", "slots")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (the first slot of the mix
    that holds words of the row, null if none does): one row for each row of docs.

    docs: doc_id, source, text; other columns are ignored. A null text has no words and a null
    source is a source of its own. Rows that repeat each have their own place in the stream. An
    empty table, or one without words, gives taken 0 for each of its rows. A very long text is in as many blocks as it
    fills. Words are taken by the slots that a source gets; taken adds up to the rounded target in every source, and no row
    gives more than `most` times its size."""
    return _placed(docs, weights, share, most, block).drop("start", "slots")


def mixed_documents(docs: DataFrame, in_order: bool = True) -> DataFrame:
    """The rows of docs in the mix, each as often as its words were taken, to the nearest whole number (0, 1 or 2 times). Rows without
    words are not in it; rows that repeat are each mixed. An empty table gives an empty result; very long texts move whole.

    in_order: sorted by the slots that the copies begin in, as a mix is read. That shuffles all texts once more; what packs or
    shuffles the mix has no use for it and says so."""
    rows, n = numbered(docs)
    slot, start = f"{n}slot", f"{n}start"
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    copies = _placed(rows, carry=(n,)).where(times > 0).select(n, F.explode(F.slice("slots", F.lit(1), times)).alias(slot), F.col("start").alias(start))
    mixed = rows.join(copies, n)
    return (mixed.orderBy(slot, start) if in_order else mixed).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), c AS (
  SELECT *, [3, 1, 2][1 + (k - 1) % 3] AS weight, 2 * source_size AS cap FROM s
), o AS (
  SELECT *, cap / weight AS stop FROM c
), l AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY stop, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY stop, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), t AS (
  SELECT source, k, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM l)) AS target FROM c
), i AS (
  SELECT *, round(target)::BIGINT AS words, ceil(round(target) / 256)::BIGINT AS blocks,
         floor(sum(round(target)::BIGINT) OVER (ORDER BY k) / (SELECT sum(round(target)::BIGINT) FROM t)::DOUBLE * 4294967296)::BIGINT AS high FROM t
), j AS (
  SELECT *, coalesce(lag(high) OVER (ORDER BY k), 0) AS low FROM i
), n AS (
  SELECT (sum(blocks) + sum(blocks) // 64 + 256)::BIGINT AS n_slots, count(*) AS sources FROM i
), g AS (
  SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, (slot * 2654435769) % 4294967296 AS x FROM (SELECT unnest(range(n_slots)) AS slot FROM n)) JOIN j ON x >= low AND x < high
), p AS (
  SELECT doc_id, size, source_size, target, words, k, sum(size) OVER (PARTITION BY k ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN j ON d.source IS NOT DISTINCT FROM j.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, words) - start)
        + greatest(0, least(start + size, words - source_size) - start))::BIGINT AS taken,
       CASE WHEN size > 0 AND start < words THEN coalesce(slot, n_slots + (start // 256) * sources + p.k - 1) ELSE -1 END::BIGINT AS first_slot
FROM p CROSS JOIN n LEFT JOIN g ON g.k = p.k AND g.rank = start // 256
"""
