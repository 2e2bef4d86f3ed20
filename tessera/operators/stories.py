"""Stories: articles whose titles tell the same within some hours of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.similarity import alike, folded, possible
from tessera.operators.components import components
from tessera.operators.lineage import cut, growing

# How alike titles are, within how many hours, and below how many words their order counts.
SIMILAR, HOURS, SHORT = 90.0, 48, 6
WEEKDAYS = "^(mon|tues|wednes|thurs|fri|satur|sun)day$"


def normal_title(title: Column) -> Column:
    """Lower case without accents; what is not a letter, digit, underscore or % is a blank."""
    plain = F.when(title.rlike("^[ -~]*$"), title).otherwise(folded(F.when(~title.rlike("^[ -~]*$"), title)))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9_%]+", " "))


def company_pattern(names: list[str]) -> str:
    """A pattern for any of a company's normal names as whole words, the longest first."""
    return r"\b(?:" + "|".join(sorted({n for n in names if n}, key=len, reverse=True)) + r")\b"


def distinguishing(norm: Column, companies: dict[str, str] | None = None) -> Column:
    """Words with a digit, weekdays, and @SYMBOL of the companies named: two titles that conflict in them tell different things."""
    words = F.filter(F.split(norm, " "), lambda w: w.rlike("[0-9]") | w.rlike(WEEKDAYS))
    named = F.array_compact(F.array(*[F.when(norm.rlike(p), F.lit(f"@{s}")) for s, p in (companies or {}).items()])) if companies else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(words, named)))


#: Titles of a tile, in the mean.
TILE = 512


def candidate_titles(titles: DataFrame, similar: float = SIMILAR, hours: int = HOURS, short: int = SHORT, tile: int = TILE) -> DataFrame:
    """a, b: all pairs of titles (id, norm, blocks: the blocks of time that they are in) that may reach the similarity and have neighbouring
    blocks; none that reach it are left out.

    The titles of a block are dealt to tiles. Each tile meets those of its block and of the next one, each pair of tiles in a row of its own,
    where products of matrices tell for all pairs of titles at once how much they have in common (possible_pairs)."""
    placed = titles.select("id", "norm", F.explode(F.array_distinct("blocks")).alias("block"))
    parts = cut(placed.groupBy("block").agg(F.ceil(F.count("*") / tile).alias("parts")))
    dealt = placed.join(growing(parts), "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    tiles = cut(dealt.groupBy("block", "part").agg(F.collect_list(F.struct("id", "norm")).alias("titles")))
    behind = parts.join(growing(parts.select((F.col("block") - 1).alias("block"), F.col("parts").alias("next"))), "block", "left")
    of = lambda block, first, last: F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>")), lambda p: F.struct(block.alias("block"), p.alias("part")))
    reach = F.concat(of(F.col("block"), F.col("part"), F.col("parts") - 1), of(F.col("block") + 1, F.lit(0).cast("long"), F.coalesce("next", F.lit(0)) - 1))
    asks = tiles.join(growing(behind), "block").select(F.col("titles").alias("x"), F.explode(reach).alias("to")).select("x", "to.block", "to.part")
    met = asks.join(growing(tiles.withColumnRenamed("titles", "y")), ["block", "part"]).select("x", "y", possible(similar, short)(F.col("x.norm"), F.col("y.norm")).alias("found"))
    size = F.size("y")
    pairs = F.transform("found", lambda k: F.struct(F.get("x.id", (k / size).cast("int")).alias("a"), F.get("y.id", (k % size).cast("int")).alias("b")))
    each = met.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b")
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def matching_pairs(titles: DataFrame, similar: float = SIMILAR, hours: int = HOURS, short: int = SHORT) -> DataFrame:
    """a, b: ids of titles (id, norm, keys, seconds) that tell the same or hang together by such, and, together, connect all that do.

    Rows of one title and the same keys are one class: they hang together in runs without too long a gap. Only classes
    are compared, so that a title that comes thousands of times is compared once. Runs of two classes that tell the same are linked by
    their first rows where rows of both are near enough, which connects them as all their links would."""
    span = hours * 3600
    kinds = titles.groupBy("norm", "keys").agg(F.min("id").alias("class"), F.array_distinct(F.collect_set(F.floor(F.col("seconds") / span))).alias("blocks"))
    kinds = cut(kinds)
    rows = cut(titles.join(growing(kinds.select("norm", "keys", "class")), ["norm", "keys"]).select("id", "class", "seconds"))
    w = W.partitionBy("class").orderBy("seconds", "id")
    # A run of rows none of which is too long behind the one before it is linked with its first row.
    begins = F.coalesce(F.col("seconds") - F.lag("seconds").over(w) > span, F.lit(True))
    runs = rows.withColumn("begins", begins).withColumn("head", F.last(F.when(F.col("begins"), F.col("id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = cut(runs.select("id", "class", "seconds", "head"))
    same = runs.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))

    found = candidate_titles(kinds.select(F.col("class").alias("id"), "norm", "blocks"), similar, hours, short)
    of = lambda x: growing(kinds.select(F.col("class").alias(x), F.col("norm").alias(f"n{x}"), F.col("keys").alias(f"k{x}")))
    found = found.join(of("a"), "a").join(of("b"), "b")
    within = (F.size(F.array_except("ka", "kb")) == 0) | (F.size(F.array_except("kb", "ka")) == 0)
    alike_ = found.where(within).where((F.col("na") == F.col("nb")) | (alike(short)(F.col("na"), F.col("nb")) >= similar)).select("a", "b")
    return same.unionByName(_runs_that_meet(alike_, runs.groupBy("class", "head").agg(F.min("seconds").alias("begin"), F.max("seconds").alias("end")), span)).distinct()


def _runs_that_meet(pairs: DataFrame, runs: DataFrame, span: int) -> DataFrame:
    """a, b: the heads of two runs (class, head, begin, end) of paired classes (a, b) that have rows within the span of each other.

    No gap in a run is longer than the span, so that these are the runs that are no farther apart, or overlap. The class that fills fewer
    blocks of time asks for runs of the other in its own blocks: a title that comes again and again is not gone through for each of those like it."""
    block = lambda seconds: F.floor(seconds / span)
    runs = cut(runs)
    sizes = cut(runs.groupBy("class").agg(F.sum(block(F.col("end")) - block(F.col("begin")) + 1).alias("size")))
    of = lambda x: growing(sizes.select(F.col("class").alias(x), F.col("size").alias(f"s{x}")))
    fewer = F.col("sa") <= F.col("sb")
    asked = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("class"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    # A second more, as differences of moments are rounded.
    around = F.sequence(block(F.col("begin") - span - 1), block(F.col("end") + span + 1))
    asks = asked.join(growing(runs), "class").select(F.col("other").alias("class"), "head", "begin", "end", F.explode(around).alias("block"))
    there = runs.select("class", F.col("head").alias("to"), F.col("begin").alias("from"), F.col("end").alias("until"), F.explode(F.sequence(block(F.col("begin")), block(F.col("end")))).alias("block"))
    met = asks.join(growing(there), ["class", "block"]).where((F.col("begin") - F.col("until") <= span) & (F.col("from") - F.col("end") <= span))
    return met.select(F.least("head", "to").alias("a"), F.greatest("head", "to").alias("b")).distinct()


def grouped(articles: DataFrame, companies: dict[str, str] | None = None, similar: float = SIMILAR, hours: int = HOURS, short: int = SHORT) -> DataFrame:
    """id, story_id for each of articles (id, title, published_at, first_seen_at, story_id): the first id that a story has already, by time,
    else its earliest article."""
    of = articles.select("id", "story_id", F.unix_micros(F.coalesce("published_at", "first_seen_at")).alias("micros"), normal_title(F.coalesce("title", F.lit(""))).alias("norm"))
    of = cut(of.withColumn("keys", distinguishing(F.col("norm"), companies)))
    titles = of.select("id", "norm", "keys", (F.col("micros") / 1_000_000).alias("seconds"))
    group = components(matching_pairs(titles, similar, hours, short))
    of = of.join(growing(group), "id", "left").withColumn("component", F.coalesce("component", "id"))
    time = F.struct("micros", "id")
    named = of.groupBy("component").agg(F.coalesce(F.min_by("story_id", F.when(F.col("story_id").isNotNull(), time)), F.min_by("id", time)).alias("story"))
    return of.join(growing(named), "component").select("id", F.col("story").alias("story_id"))


def regrouped(articles: DataFrame, companies: dict[str, str] | None = None, **how: float) -> DataFrame:
    """id, story_id of the articles whose story changes, when only what is at most two windows older than the first article
    without a story is grouped again."""
    time = F.coalesce("published_at", "first_seen_at")
    first = articles.where("story_id is null").agg(F.min(time).alias("first"))
    hours = how.get("hours", HOURS)
    recent = articles.join(first, time >= F.col("first") - F.expr(f"interval {2 * int(hours)} hours")).drop("first")
    new = grouped(recent, companies, **how)
    old = recent.select("id", F.col("story_id").alias("was"))
    return new.join(growing(old), "id").where(~F.col("story_id").eqNullSafe(F.col("was"))).select("id", "story_id")
