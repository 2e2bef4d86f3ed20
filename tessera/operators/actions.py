"""Corporate actions that filings announce: gathered from all filings on one action, and held against what is known."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.actions import classified, extracted, filing_text
from tessera.operators.asof import as_of

# Days within which a known action is the same, the overnight move below which prices are adjusted already, days within
# which an undated mention belongs to a dated one.
SAME_DAYS, ADJUSTED, FOLD_DAYS = 3, 0.10, 120


def announced(filings: DataFrame) -> DataFrame:
    """A row for each decided action in filings (id, symbol, filed_at, category, subject, description): action_type, ratio, price_factor,
    record_date, ex_date, assumed."""
    f = filings.withColumn("_text", filing_text(F.col("category"), F.col("subject"), F.col("description")))
    f = f.withColumn("action_type", F.explode(classified(F.col("_text"))[2]))
    parts = extracted(F.col("action_type"), F.col("_text"))
    return f.select("id", "symbol", "filed_at", "subject", "action_type", *[c.alias(n) for n, c in parts.items()])


def gathered(actions: DataFrame) -> DataFrame:
    """One row for each action: symbol, action_type, ratio, price_factor, record_date, ex_date, assumed, filing_id, filed_at, subject, n_filings.

    Filings on one symbol, type and ex-date tell of one action; all of a symbol and type without a date belong to the first dated
    one within FOLD_DAYS of any of them, or are one of their own. Each attribute is the first one stated, by filing."""
    keys = ["symbol", "action_type"]
    local = F.from_utc_timestamp("filed_at", "UTC").cast("date")
    dated = actions.where("ex_date is not null").groupBy(*keys, "ex_date").agg(F.min(F.struct("filed_at", "id")).alias("first"))
    undated = actions.where("ex_date is null").select(*keys, local.alias("on")).distinct()
    # What lies within so many days is in the same block of them or in one beside it.
    block = lambda c: F.floor(F.unix_date(c) / FOLD_DAYS)
    around = dated.withColumn("block", F.explode(F.sequence(block("ex_date") - 1, block("ex_date") + 1)))
    near = undated.withColumn("block", block("on")).join(around, [*keys, "block"]).where(F.abs(F.datediff("on", "ex_date")) <= FOLD_DAYS)
    into = near.groupBy(*keys).agg(F.min_by("ex_date", "first").alias("into"))
    of = actions.join(into, keys, "left").withColumn("key_date", F.coalesce("ex_date", "into"))
    time = F.struct("filed_at", "id")
    stated = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), time)).alias(c)
    out = of.groupBy(*keys, "key_date").agg(*[stated(c) for c in ("ratio", "price_factor", "record_date", "ex_date")], F.bool_or("assumed").alias("assumed"), F.min_by("id", time).alias("filing_id"), F.min("filed_at").alias("filed_at"), F.min_by("subject", time).alias("subject"), F.count("*").alias("n_filings"))
    return out.drop("key_date")


def overnight(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """symbol, ex_date, bar_date, gap of wanted (symbol, ex_date): the open of the first bar on or after the date over the close of the last one
    before it; null where there is none."""
    after = as_of(wanted.select("symbol", "ex_date"), bars, ["symbol"], "ex_date", "date", {"date": "bar_date", "open": "opened"}, forward=True)
    both = as_of(after, bars, ["symbol"], "ex_date", "date", {"close": "before"}, same=False)
    return both.where("bar_date is not null").select("symbol", "ex_date", "bar_date", (F.col("opened") / F.col("before") - 1).alias("gap"))


def with_status(actions: DataFrame, known: DataFrame, bars: DataFrame, today: dt.date) -> DataFrame:
    """actions with status and note. known: symbol, ex_date of recorded actions; bars: symbol, date, open, close."""
    k = known.select("symbol", F.col("ex_date").alias("known_date"))
    k = k.withColumn("ex_date", F.explode(F.expr(f"sequence(known_date - {SAME_DAYS}, known_date + {SAME_DAYS})")))
    hit = k.groupBy("symbol", "ex_date").agg(F.min("known_date").alias("known_date"))
    gaps = overnight(bars, actions.where("ex_date is not null").select("symbol", "ex_date").distinct())
    of = actions.join(hit, ["symbol", "ex_date"], "left").join(gaps, ["symbol", "ex_date"], "left")
    ex, gap = F.col("ex_date"), F.col("gap")
    status = F.when(F.col("action_type") == "buyback", "no_adjustment").when(ex.isNull(), "undated").when(F.col("known_date").isNotNull(), "recorded").when(ex > F.lit(today), "upcoming").when(gap.isNull(), "needs_review").when(F.abs(gap) < ADJUSTED, "adjusted").otherwise("needs_review")
    move = F.format_string("overnight move on %s: %+.1f%%", F.col("bar_date").cast("string"), gap * 100)
    note = F.when(status == "recorded", F.concat(F.lit("recorded for "), F.col("known_date").cast("string"))).when(status.isin("adjusted", "needs_review") & gap.isNotNull(), move).when(status == "needs_review", "no bars around the date").otherwise(status)
    extra = F.when(F.col("assumed"), "ex-date is the record date")
    return of.select(*actions.columns, status.alias("status"), F.concat_ws("; ", note, extra, F.concat(F.col("n_filings").cast("string"), F.lit(" filings"))).alias("note"))


def action_id(symbol: Column, action_type: Column, ex_date: Column, filing_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", symbol, action_type, F.coalesce(ex_date.cast("string"), filing_id.cast("string"))), 256), 1, 32)
