"""Filter interaction audit: what filters remove one after the other, in every order, and each one's Shapley value.

A document fails a set of filters, its mask. If filter i is applied with probability x_i, the expected number of documents
removed is a polynomial in the x, linear in each of them (the multilinear extension of the game "how many go"):
a document with mask M goes with probability 1 - prod over i in M of (1 - x_i). Its coefficients are signed counts of
the documents that fail all filters of a set, so that each part's polynomial is made of its mask counts alone, at most 2^n numbers.

- At a corner, where each x is 0 or 1, the polynomial is the number that a set of filters removes: survivors, what a step
  removes, what it would have removed and what no other filter would are differences of corners.
- The integral of the partial derivative by x_i along the diagonal is the Shapley value of i: a sum of coefficients over
  degrees. It is held as a fraction of whole numbers, over the least common multiple of the degrees, and scaled by n!.

Texts are read once; what moves is one narrow row for each document (digest and mask), then one for each part and mask.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_or_empty, words_of

#: Conditions of failure over _text, _words (their number) and _distinct, by the letter of their filter. REPEATED
#: is the filter that the text of a smaller doc_id fails a document by; it is the last bit.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("_words") < 200,
    "B": lambda: 100 * F.col("_distinct") < 50 * F.col("_words"),
    "C": lambda: 100 * F.regexp_count("_text", F.lit("[A-Z]")) > 2 * F.length("_text"),
    "D": lambda: F.col("_text").rlike("[#$%&*|]"),
}
REPEATED = "E"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """doc_id, part, mask: a row for each row of docs. Bit k of the mask is the k-th filter's, the last bit that of REPEATED."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("_text"))
    # In an array of one element, so that the words are made once for both numbers.
    sizes = F.get(F.transform(F.array(words_of(F.col("_text"))), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))
    read = read.withColumn("_sizes", sizes).withColumn("_words", F.col("_sizes.all")).withColumn("_distinct", F.col("_sizes.distinct"))
    mask = sum((F.coalesce(fails().cast("int"), F.lit(0)) * (1 << k) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = materialise(read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest")), "failures")
    # A group of copies is a minimum, and each row looks for itself among the minima: no group meets in one task.
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeated = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + repeated).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part have a mask, and how many of them are labelled so."""
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    of = of.where("good + toxic > 0").select(F.struct("key", F.lit(None).cast("long").alias("_")).alias("key"), "good", "toxic")
    # Rows without doc_id have no labels; a second number deals them out.
    key = F.struct(F.col("doc_id").alias("key"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_"))
    rows = failed.select(key.alias("key"), "part", "mask").join(of, "key", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_polynomials(counts: DataFrame, n_filters: int) -> DataFrame:
    """part, total and, for each of COUNTS, its polynomial: 2^n coefficients, that of the product of the x in T at index T."""
    masks = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))

    def polynomial(count: str) -> Column:
        holding = lambda t: F.aggregate(F.filter("m", lambda e: e["mask"].bitwiseAND(t) == t), F.lit(0).cast("long"), lambda s, e: s + e[count])
        return F.transform(masks, lambda t: F.when(t == 0, F.lit(0).cast("long")).when(F.bit_count(t) % 2 == 1, holding(t)).otherwise(-holding(t)))

    # One row for each mask: at most 2^n in a group.
    of = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", *COUNTS)).alias("m"))
    return of.select("part", "total", *[polynomial(c).alias(c) for c in COUNTS])


def corners(polynomial: Column, n_filters: int) -> Column:
    """The polynomial's values where the x in S are 1 and all others 0, at index S."""
    masks = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    return F.transform(masks, lambda s: F.aggregate(polynomial, F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("sum")), lambda a, c: F.struct((a["t"] + 1).alias("t"), (a["sum"] + F.when(a["t"].bitwiseAND(s) == a["t"], c).otherwise(0)).alias("sum")), lambda a: a["sum"]))


def shapley_values(polynomial: str, n_filters: int) -> Column:
    """n! times each filter's Shapley value, exactly.

    The partial derivative by x_i has on the diagonal, at degree k, the sum of the coefficients of all sets of k + 1 filters
    that hold i; its integral from 0 to 1 divides that by k + 1. The sum is one numerator over the least common multiple."""
    common = math.lcm(*range(1, n_filters + 1))

    def of(i: int) -> Column:
        numerator = F.expr(" + ".join(f"{common // t.bit_count()} * {polynomial}[{t}]" for t in range(1 << n_filters) if t >> i & 1))
        return numerator * (math.factorial(n_filters) // common)

    return F.array(*[of(i) for i in range(n_filters)])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part
    (source), each order of all filters and each step of it.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. A null text is empty, a null source
    is the empty one. Texts count as identical if their SHA-256 digests are. Rows that repeat are each counted: all rows
    of the smallest doc_id with a text pass the last filter, all other rows of the text fail it. A row without doc_id passes it, has no
    labels and fails no other row. A document with several rows of labels is good, or toxic, if one of them says so; null labels say
    nothing. Very long texts are read whole. An empty table gives an empty result."""
    names = [*filters, REPEATED]
    n = len(names)
    of = removal_polynomials(mask_counts(failures(docs, filters), labels), n)
    of = of.select("part", "total", *[corners(F.col(c), n).alias(c) for c in COUNTS], shapley_values("n", n).alias("values"))
    orders = of.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)])))
    bit = lambda letter: F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), F.instr(F.lit("".join(names)), letter))
    steps = orders.select("*", F.posexplode(F.split("filter_order", "")).alias("before_it", "letter")).withColumn("bit", bit(F.col("letter")))
    steps = steps.withColumn("before", F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("before_it")), F.lit(0), lambda s, x: s + bit(x))).withColumn("after", F.col("before") + F.col("bit"))
    at = lambda count, s: F.get(count, F.col(s) if isinstance(s, str) else s)
    lost = lambda count: at(count, "after") - at(count, "before")
    every = (1 << n) - 1
    return steps.select(
        "part", "filter_order", (F.col("before_it") + 1).alias("step"), (F.col("total") - at("n", "after")).alias("kept"), lost("n").alias("removed"), (at("n", "bit") - lost("n")).alias("redundant"),
        (at("n", F.lit(every)) - at("n", F.lit(every) - F.col("bit"))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("values", F.instr(F.lit("".join(names)), F.col("letter"))).alias("shapley"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step)::INTEGER AS before
  FROM o, range(1, 6) AS r(step) JOIN f ON f.letter = substring(filter_order, step::INTEGER, 1)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
