"""Quarterly results: which source counts, corrections, comparisons, flags, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import fiscal_quarter, months_before

# Sources by trust, how far a figure may jump, metrics that stay positive and that are looked at when their sign changes.
SOURCES = ("xbrl", "sec", "pdf")
JUMP = 5.0
POSITIVE = ("revenue", "total_income", "interest_earned", "nii", "gross_npa", "net_npa")
SWINGS = ("net_profit", "eps")
HEADLINE = ("revenue", "total_income", "net_profit", "eps", "interest_earned", "interest_expended", "nii", "provisions", "gross_npa", "net_npa", "gross_npa_pct", "net_npa_pct")
DISCONTINUED = ("x:ProfitLossFromDiscontinuedOperationsAfterTax", "x:ProfitLossFromDiscontinuedOperationsBeforeTax")
TOLERANCE = 0.01
KEYS = ["symbol", "period_end", "basis"]


def best_rows(parsed: DataFrame) -> DataFrame:
    """Of parsed (symbol, period_end, basis, metric, value, source, file) the rows of the best source of each quarter and basis, the last file's of each metric,
    with trust and fiscal_quarter."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    of = parsed.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(W.partitionBy(*KEYS))).where("_rank = _best")
    last = F.row_number().over(W.partitionBy(*KEYS, "metric").orderBy(F.desc("file")))
    of = of.withColumn("_r", last).where("_r = 1").drop("_rank", "_best", "_r")
    return of.withColumn("trust", F.when(F.col("source") == "pdf", "low").otherwise("high")).withColumn("fiscal_quarter", fiscal_quarter(F.col("period_end")))


def mismatches(printed: DataFrame, filed: DataFrame) -> DataFrame:
    """Figures that an exhibit prints (symbol, period_end, basis, metric, value, step) and that XBRL (…, value), rounded as the exhibit does, does not have."""
    both = printed.join(filed.select(*KEYS, "metric", F.col("value").alias("filed")), [*KEYS, "metric"])
    tolerance = F.col("step") / 2 + 1e-9 * F.greatest(F.lit(1.0), F.abs("value"))
    return both.where(F.abs(F.col("filed") - F.col("value")) > tolerance)


def override_problems(overrides: DataFrame, filed: DataFrame, printed: DataFrame, checks: DataFrame) -> DataFrame:
    """overrides (symbol, period_end, basis, metric, value, source_file) with problem, why they may not be applied; null if they may.

    filed: XBRL values; printed: values and steps of exhibits (file, …); checks: symbol, period_end, basis, metric, side, sign, element:
    sums of XBRL elements whose two sides ought to be equal. A correction needs an exhibit that prints it, an XBRL figure
    that differs, and a check that fails: then the XBRL contradicts itself."""
    keys = [*KEYS, "metric"]
    o = overrides.join(filed.select(*keys, F.col("value").alias("filed")), keys, "left")
    o = o.join(printed.select(*keys, F.col("file").alias("source_file"), F.col("value").alias("printed"), "step"), [*keys, "source_file"], "left")
    parts = checks.join(filed.select(*KEYS, F.substring("metric", 3, 200).alias("element"), F.col("value").alias("part")).where("element is not null"), [*KEYS, "element"], "left")
    sides = parts.groupBy(*keys).agg(F.sum(F.when(F.col("side") == 0, F.col("sign") * F.col("part"))).alias("left"), F.sum(F.when(F.col("side") == 1, F.col("sign") * F.col("part"))).alias("right"), F.min(F.when(F.col("part").isNull(), F.col("element"))).alias("absent"))
    o = o.join(sides, keys, "left")
    tolerance = F.col("step") / 2 + 1e-9 * F.greatest(F.lit(1.0), F.abs("printed"))
    problem = (
        F.when(F.col("filed").isNull(), "there is no XBRL figure to correct").when(F.col("printed").isNull(), "the exhibit does not print it").when(F.abs(F.col("value") - F.col("printed")) > tolerance, "the exhibit prints another value")
        .when(F.abs(F.col("filed") - F.col("printed")) <= tolerance, "the XBRL agrees with the exhibit").when(F.col("absent").isNotNull(), F.concat(F.lit("the XBRL has no "), "absent"))
        .when(F.abs(F.col("left") - F.col("right")) <= TOLERANCE, "the check holds")
    )
    return o.select(*overrides.columns, problem.alias("problem"))


def corrected(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with the values of overrides (…, value, source_file, reason) in place of XBRL ones, corrected_from and correction."""
    o = overrides.select(*KEYS, "metric", F.col("value").alias("_new"), F.concat(F.lit("6-K "), "source_file", F.lit(": "), "reason").alias("_why"))
    of = rows.join(o, [*KEYS, "metric"], "left").withColumn("_hit", F.col("_new").isNotNull() & (F.col("source") == "xbrl"))
    return of.withColumns({"corrected_from": F.when(F.col("_hit"), F.col("value")), "correction": F.when(F.col("_hit"), F.col("_why")), "value": F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value"))}).drop("_new", "_why", "_hit")


def discontinued(results: DataFrame) -> DataFrame:
    """symbol, basis, period_end, fiscal_quarter, amount: quarters with a result of discontinued operations, after tax where that is stated."""
    of = results.where(F.col("metric").isin(*DISCONTINUED) & (F.col("value") != 0))
    rank = F.array_position(F.array(*[F.lit(m) for m in DISCONTINUED]), F.col("metric"))
    return of.groupBy("symbol", "basis", "period_end").agg(F.min_by("fiscal_quarter", rank).alias("fiscal_quarter"), F.min_by("value", rank).alias("amount"))


def notes(rows: DataFrame, breaks: DataFrame, before: Column, name: str) -> DataFrame:
    """rows (symbol, basis, period_end) with a note on the breaks after `before` and up to the row's quarter: the two are not like for like."""
    keys = ["symbol", "basis", "period_end"]
    each = rows.select(*keys, before.alias("_from")).distinct()
    b = breaks.select("symbol", "basis", F.col("period_end").alias("_at"), F.concat("fiscal_quarter", F.format_string(" reports %,.0f cr from discontinued operations", "amount")).alias("_text"))
    hit = each.join(b, ["symbol", "basis"]).where("_at > _from and _at <= period_end").groupBy(*keys).agg(F.concat(F.lit("not like-for-like: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), "; ")).alias(name))
    return rows.join(hit, keys, "left")


def changes(results: DataFrame) -> DataFrame:
    """The headline rows with prev_q, qoq, prev_y, yoy by calendar quarter, and notes where a comparison spans a break."""
    of = results.where(F.col("metric").isin(*HEADLINE))
    keys = ["symbol", "basis", "metric"]
    old = lambda name: of.select(*keys, F.col("period_end").alias(f"_{name}"), F.col("value").alias(name))
    out = of.withColumns({"_prev_q": months_before(F.col("period_end"), 3), "_prev_y": months_before(F.col("period_end"), 12)})
    out = out.join(old("prev_q"), [*keys, "_prev_q"], "left").join(old("prev_y"), [*keys, "_prev_y"], "left")
    change = lambda p: F.try_divide(F.col("value") - F.col(p), F.abs(p))
    out = out.withColumns({"qoq": change("prev_q"), "yoy": change("prev_y")})
    breaks = discontinued(results)
    out = notes(out, breaks, F.col("_prev_q"), "qoq_note")
    out = notes(out, breaks, F.col("_prev_y"), "yoy_note")
    only = lambda n, p: F.when(F.col(p).isNotNull(), F.coalesce(n, F.lit(""))).otherwise("")
    return out.withColumns({"qoq_note": only("qoq_note", "prev_q"), "yoy_note": only("yoy_note", "prev_y")}).drop("_prev_q", "_prev_y")


def flagged(diff: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """changes with flag (a jump, a sign that ought not to change) and flag_reviewed, the reason of an acknowledgement (symbol, fiscal_quarter, basis, metric, flag,
    reason) of exactly that flag."""
    v, p = F.col("value"), F.col("prev_q")
    ratio = F.abs(F.try_divide(v, p))
    jump = F.when((v != 0) & ((ratio > JUMP) | (ratio < 1 / JUMP)), F.format_string("%.1fx vs previous quarter", ratio))
    swing = ((v < 0) != (p < 0)) & (v != 0) & (p != 0)
    sign = F.when(swing & F.col("metric").isin(*POSITIVE), "sign change on a metric that should stay positive").when(swing & F.col("metric").isin(*SWINGS), "sign change (profit/loss swing?) - check")
    of = diff.withColumn("flag", F.nullif(F.concat_ws("; ", jump, sign), F.lit("")))
    return of.join(F.broadcast(acknowledged.withColumnRenamed("reason", "flag_reviewed")), ["symbol", "fiscal_quarter", "basis", "metric", "flag"], "left")


def quarter_table(rows: DataFrame, quarters: int = 8) -> DataFrame:
    """The last quarters of each symbol and basis: the top line (revenue, or total income where there is none), net profit, eps, with their
    changes, the weakest source, flags and notes. rows: flagged changes with source and trust."""
    keys = ["symbol", "basis"]
    has = F.bool_or(F.col("metric") == "revenue").over(W.partitionBy(*keys))
    of = rows.withColumn("top", F.when(has, "revenue").otherwise("total_income"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    source = F.when(F.bool_or(F.col("trust") == "low"), "PDF (lower trust)").when(F.bool_or(F.col("source") == "sec"), "SEC 6-K").otherwise("XBRL")
    told = F.array_join(F.array_sort(F.collect_set(F.coalesce(F.concat(F.lit("reviewed: "), "flag_reviewed"), F.col("flag")))), "; ")
    out = of.groupBy(*keys, "period_end", "fiscal_quarter", "top").agg(
        *[F.max(F.when(F.col("metric") == F.col("top"), F.col(c))).alias(f"top_{c}") for c in ("value", "qoq", "yoy")], *[pick("net_profit", c).alias(f"profit_{c}") for c in ("value", "qoq", "yoy")], pick("eps", "value").alias("eps"),
        source.alias("source"), told.alias("flags"), F.max(F.when(F.col("metric") == F.col("top"), F.concat_ws(" | ", F.nullif("qoq_note", F.lit("")), F.nullif("yoy_note", F.lit(""))))).alias("notes"),
    )
    return out.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("period_end")))).where(f"r <= {quarters}").drop("r")


def report(table: DataFrame) -> DataFrame:
    """Of quarter_table one basis a symbol: consolidated where there is any."""
    any_ = F.bool_or(F.col("basis") == "consolidated").over(W.partitionBy("symbol"))
    return table.withColumn("_c", any_).where("(basis = 'consolidated') = _c").drop("_c")


def checklist(symbols: DataFrame, quarters: DataFrame, results: DataFrame) -> DataFrame:
    """symbol, period_end, basis, status for each symbol, each due quarter (period_end) and both bases."""
    bases = symbols.sparkSession.createDataFrame([("standalone",), ("consolidated",)], "basis string")
    have = results.groupBy("symbol", "period_end", "basis").agg(F.min("source").alias("source"))
    status = F.when(F.col("source") == "xbrl", "ok (XBRL)").when(F.col("source") == "sec", "ok (SEC 6-K)").when(F.col("source") == "pdf", "PDF only - XBRL would upgrade").otherwise("MISSING")
    return symbols.crossJoin(quarters).crossJoin(bases).join(have, KEYS, "left").select("symbol", "period_end", "basis", status.alias("status"))
