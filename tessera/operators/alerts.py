"""Alerts from bars, signals, sentiment, results, announced actions and runs: each builder gives rows for all days at once
(symbol, alert_type, subject, alert_date, severity, text), and one check refuses a batch that reads like advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What would read as advice, and headlines that are tips.
ADVICE = r"\b(?:buy(?!(?:[- ]?back|-in)\b)|buying|sell(?![- ]?off\b)|selling|accumulate|go long|go short|shorting|target price|recommend\w*|stop[- ]loss|take profit)\b"
TIP = rf"{ADVICE}|\b(?:stocks? to|top picks?|picks?\b|multibagger|upside of)"
MOVE, WIDE, SHIFT, LEAST_STORIES, HEADLINES, RESULT_DAYS = 0.03, 3, 0.3, 3, 3, 30
TOO_FEW, NONE, BETTER, WORSE = "too few events to judge", "no clear difference", "beats baseline (CI > 0)", "worse than baseline (CI < 0)"
COLUMNS = ["symbol", "alert_type", "subject", "alert_date", "severity", "text"]


def pct(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%+.1f%%", value * 100)).otherwise("n/a")


def trading_days(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" trading day"), F.when(n == 1, "").otherwise("s"))


def clause(note: Column, n: Column, horizon: Column) -> Column:
    """What the past of a signal at a horizon says, in words; a null note is no result."""
    at, than = trading_days(horizon), lambda way: F.concat(F.lit(f"historically moved {way} in the signal's direction than an average day at "), trading_days(horizon), F.format_string(" (n=%d), possibly by chance", n))
    text = F.when(note == TOO_FEW, F.format_string("too few past events to judge (n=%d)", n)).when(note == NONE, F.concat(F.lit("historically no edge vs doing nothing at "), at, F.format_string(" (n=%d)", n)))
    return text.when(note == BETTER, than("further")).when(note == WORSE, than("less")).when(note.isNull(), F.concat(F.lit("no backtest result at "), at, F.lit(" yet"))).otherwise(F.format_string("n=%d", n))


def notes(rules: DataFrame, study: DataFrame) -> DataFrame:
    """signal, note: a line on the past of each signal. rules: signal, label, horizons (array), status (of a test out of sample, or null);
    study: signal, horizon, n, note."""
    wanted = rules.select("signal", "label", "status", F.posexplode("horizons").alias("k", "horizon"))
    of = wanted.join(study.select("signal", "horizon", "n", "note"), ["signal", "horizon"], "left")
    of = of.groupBy("signal", "label", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", clause(F.col("note"), F.col("n"), F.col("horizon")).alias("c")))), lambda x: x["c"]).alias("clauses"))
    return of.select("signal", F.concat(F.lit("Backtest ("), "label", F.lit("): "), F.array_join("clauses", "; "), F.coalesce(F.concat(F.lit("; "), "status"), F.lit("")), F.lit(".")).alias("note"))


def day_moves(bars: DataFrame) -> DataFrame:
    """symbol, date, close, move (close over the close before), gap (open over it); null on a first bar."""
    before = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    return bars.select("symbol", "date", "close", (F.col("close") / before - 1).alias("move"), (F.col("open") / before - 1).alias("gap"))


def candidate_moves(bars: DataFrame, gaps: DataFrame, threshold: float = MOVE) -> DataFrame:
    """symbol, date, close, move, gap_signal, gap_value, direction, same_way: days with a move above the threshold or a gap signal (gaps: symbol,
    date, signal, value). The gap says the direction if there is one; same_way counts the symbols of a day that go there."""
    of = day_moves(bars).where("move is not null").join(gaps.select("symbol", "date", F.col("signal").alias("gap_signal"), F.col("value").alias("gap_value")), ["symbol", "date"], "left")
    of = of.where((F.abs("move") > threshold) | F.col("gap_signal").isNotNull())
    of = of.withColumn("direction", F.when(F.coalesce("gap_value", "move") > 0, 1).otherwise(-1))
    return of.withColumn("same_way", F.count("*").over(W.partitionBy("date", "direction")))


def alert(kind: str, subject: Column, day: Column, severity: Column | str, text: Column, symbol: Column | str = "symbol") -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [(F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.lit(kind).alias("alert_type"), subject.alias("subject"), day.alias("alert_date"), lit(severity).alias("severity"), text.alias("text")]


def news_sentence(count: Column, score: Column, covered: Column, since: Column) -> Column:
    """A session's news; before a symbol's first covered session there is no data, which is not the same as no news."""
    had = F.concat(F.lit("News that session: "), count.cast("string"), F.when(count == 1, " story").otherwise(" stories"), F.format_string(", sentiment %+.2f.", score))
    begun = F.coalesce(F.concat(F.lit(" (collection started "), F.date_format(since, "dd MMM yyyy"), F.lit(")")), F.lit(""))
    return F.when(~F.coalesce(covered, F.lit(False)), F.concat(F.lit("No news data for this date"), begun, F.lit("."))).when(count.isNull(), "No linked news that session.").otherwise(had)


def benchmark_sentence(move: Column, gap: Column, gapped: Column) -> Column:
    opened = F.when(gapped, F.concat(F.lit(" (it opened "), pct(gap), F.lit(")"))).otherwise("")
    return F.when(move.isNull(), "No index bar for this date.").otherwise(F.concat(F.lit("Index "), pct(move), F.lit(" the same day"), opened, F.lit(".")))


def price_moves(moves: DataFrame, benchmark: DataFrame, daily: DataFrame, filed: DataFrame, said: DataFrame, wide: int = WIDE) -> DataFrame:
    """Alerts of candidate_moves. benchmark: its bars; daily: symbol, session_date, story_count, weighted_score; filed: symbol, date, subjects;
    said: the notes on signals."""
    index = day_moves(benchmark).select("date", F.col("move").alias("i_move"), F.col("gap").alias("i_gap"))
    first = daily.groupBy("symbol").agg(F.min("session_date").alias("news_from"))
    began = daily.agg(F.min("session_date").alias("began"))
    of = moves.join(index, "date", "left").join(first, "symbol", "left").crossJoin(began)
    of = of.join(daily.select("symbol", F.col("session_date").alias("date"), "story_count", "weighted_score"), ["symbol", "date"], "left").join(filed, ["symbol", "date"], "left").join(said.select(F.col("signal").alias("gap_signal"), "note"), "gap_signal", "left")
    up = F.col("direction") > 0
    parts = [
        F.concat("symbol", F.when(F.col("move") > 0, " rose ").otherwise(" fell "), F.format_string("%.1f%% on ", F.abs("move") * 100), F.date_format("date", "dd MMM"), F.lit(" (close "), F.format_string("%,.2f", "close"), F.lit(").")),
        benchmark_sentence(F.col("i_move"), F.col("i_gap"), F.col("gap_signal").isNotNull()),
        F.when(F.col("same_way") >= wide, F.concat(F.format_string("Market-wide move: %d symbols moved ", F.col("same_way")), F.when(up, "up").otherwise("down"), F.lit(" the same day."))),
        F.when(F.col("gap_signal").isNotNull(), F.concat(F.format_string("It opened %.1f%% ", F.abs("gap_value")), F.when(F.col("gap_value") > 0, "above").otherwise("below"), F.lit(" the previous close."))),
        news_sentence(F.col("story_count"), F.col("weighted_score"), F.col("date") >= F.col("news_from"), F.col("began")),
        F.when(F.col("subjects").isNotNull(), F.concat(F.lit("Filing that day: "), "subjects", F.lit("."))),
        F.when(F.col("gap_signal").isNull(), "A price move on its own isn't a tested signal.").otherwise(F.col("note")),
    ]
    return of.select(*alert("price_move", F.concat(F.col("date").cast("string"), F.lit(":price_move")), F.col("date"), "high", F.concat_ws(" ", *parts)))


def signal_alerts(signals: DataFrame, said: DataFrame, described: Column, label: Column) -> DataFrame:
    """Alerts of signals (symbol, date, signal, value) that are to be told."""
    of = signals.join(said, "signal", "left")
    text = F.concat("symbol", F.lit(": "), label, F.lit(" on "), F.date_format("date", "dd MMM"), F.lit(", "), described, F.lit(". "), F.coalesce("note", F.lit("")))
    return of.select(*alert("price_signal", F.concat_ws(":", F.col("date").cast("string"), "signal"), F.col("date"), "normal", F.rtrim(text)))


#: Exact, so that running sums give the same whatever entered them.
EXACT = "decimal(28,15)"


def averages(daily: DataFrame, days: DataFrame, windows: tuple[int, int] = (7, 30)) -> DataFrame:
    """symbol, day, avg_7, avg_30, stories_7 for each asked day, which may be any: story-weighted means over 7 and 30 calendar days up to it; null
    without stories. daily: symbol, session_date, weighted_score, story_count; days: day, asked of all symbols of daily, or symbol and day.

    A row enters the sums on its day and leaves them 7 and 30 days on; running sums over these days and the asked ones are the windows, so
    that each row is seen three times, however many days are asked for."""
    asked = days.select("symbol", "day").distinct() if "symbol" in days.columns else daily.select("symbol").distinct().crossJoin(days.select("day").distinct())
    w, n = (F.coalesce("weighted_score", F.lit(0.0)) * F.col("story_count")).cast(EXACT), F.col("story_count").cast("long")
    zero, none = F.lit(0).cast(EXACT), F.lit(0).cast("long")
    change = lambda k, sign: (F.date_add("session_date", k).alias("day"), *[x.alias(name) for width, m in enumerate(windows) for x, name in ((sign * w if sign > 0 or m == k else zero, f"w{width}"), (sign * n if sign > 0 or m == k else none, f"n{width}"))])
    moves = daily.select("symbol", F.explode(F.array(F.struct(*change(0, 1)), *[F.struct(*change(k, -1)) for k in windows])).alias("m")).select("symbol", "m.*", F.lit(False).alias("asked"))
    points = moves.unionByName(asked.select("symbol", "day", *[c.alias(f"{x}{k}") for k in (0, 1) for x, c in (("w", zero), ("n", none))], F.lit(True).alias("asked")))
    points = points.groupBy("symbol", "day").agg(*[F.sum(c).cast("decimal(38,15)" if c[0] == "w" else "long").alias(c) for c in ("w0", "n0", "w1", "n1")], F.max("asked").alias("asked"))
    upto = W.partitionBy("symbol").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = points.select("symbol", "day", "asked", *[F.sum(c).over(upto).cast("double" if c[0] == "w" else "long").alias(c) for c in ("w0", "n0", "w1", "n1")]).where("asked")
    return sums.select("symbol", "day", F.when(F.col("n0") > 0, F.col("w0") / F.col("n0")).alias("avg_7"), F.when(F.col("n1") > 0, F.col("w1") / F.col("n1")).alias("avg_30"), F.col("n0").alias("stories_7"))


def is_shift(shift: float = SHIFT, least: int = LEAST_STORIES) -> Column:
    return F.coalesce((F.col("stories_7") >= least) & (F.abs(F.col("avg_7") - F.col("avg_30")) >= shift), F.lit(False))


def news_shifts(daily: DataFrame, days: DataFrame, stories: DataFrame, shift: float = SHIFT, least: int = LEAST_STORIES) -> DataFrame:
    """Alerts on the asked days of a shift that was not there on the trading day before, with the stories of its week that lean that way most; tips
    are never quoted. days: day, previous_session; stories: symbol, session_date, title, source, score."""
    days = days.select("day", "previous_session").distinct()
    both = days.select("day").unionByName(days.select(F.col("previous_session").alias("day"))).where("day is not null").distinct()
    on = averages(daily, both).withColumn("on", is_shift(shift, least))
    before = on.select("symbol", F.col("day").alias("previous_session"), F.col("on").alias("was"))
    of = on.where("`on`").join(days, "day").join(before, ["symbol", "previous_session"], "left").where("not coalesce(was, false)")
    of = of.withColumn("way", F.when(F.col("avg_7") > F.col("avg_30"), 1).otherwise(-1))
    s = stories.where(F.col("score").isNotNull() & ~F.col("title").rlike(f"(?i){TIP}")).select("symbol", "session_date", "title", "source", "score")
    week = of.select("symbol", "day", "way", F.explode(F.sequence(F.date_sub("day", 6), F.col("day"))).alias("session_date"))
    near = week.join(s, ["symbol", "session_date"])
    near = near.withColumn("r", F.row_number().over(W.partitionBy("symbol", "day").orderBy(F.desc(F.col("score") * F.col("way")), "title"))).where(f"r <= {HEADLINES}")
    heads = near.groupBy("symbol", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit('"'), "title", F.lit('" ('), F.coalesce("source", F.lit("unknown")), F.lit(")")).alias("h")))), lambda x: x["h"]), "; ").alias("heads"))
    of = of.join(heads, ["symbol", "day"], "left")
    text = F.concat("symbol", F.format_string(": news sentiment over the last 7 days is %+.2f, vs %+.2f over 30 days (%d stories, ", "avg_7", "avg_30", "stories_7"), F.when(F.col("way") > 0, "more positive).").otherwise("more negative)."), F.coalesce(F.concat(F.lit(" Top stories: "), "heads", F.lit(".")), F.lit("")))
    return of.select(*alert("news_shift", F.concat(F.col("day").cast("string"), F.lit(":news_shift")), F.col("day"), "normal", text))


def figure(name: Column, value: Column, yoy: Column, qoq: Column) -> Column:
    return F.concat(name, F.format_string(" ₹%,.0f cr (YoY ", value), pct(yoy), F.lit(", QoQ "), pct(qoq), F.lit(")"))


def results_alerts(filings: DataFrame, changes: DataFrame, max_age: int = RESULT_DAYS) -> DataFrame:
    """Alerts on newly seen results of a symbol's latest quarter: its revenue (total income where there is none) and net profit.

    filings: id, symbol, filed_on, seen_on; changes: filing_id, symbol, period_end, basis, fiscal_quarter, metric, value, qoq, yoy. Of a
    filing with both bases the first one by name is told."""
    latest = changes.groupBy("symbol").agg(F.max("period_end").alias("latest"))
    own = changes.where("filing_id is not null").groupBy("symbol", F.col("filing_id").alias("id")).agg(F.max("period_end").alias("latest"), F.min("basis").alias("basis"), F.max_by("fiscal_quarter", "period_end").alias("fiscal_quarter"))
    of = filings.where(F.col("filed_on") >= F.date_sub("seen_on", max_age)).join(own.join(latest, ["symbol", "latest"]), ["symbol", "id"])
    told = changes.where("metric in ('revenue', 'total_income', 'net_profit')").select("symbol", "basis", F.col("period_end").alias("latest"), "metric", "value", "qoq", "yoy")
    of = of.join(told, ["symbol", "basis", "latest"])
    rank = F.when(F.col("metric") == "revenue", 0).when(F.col("metric") == "total_income", 1).otherwise(2)
    line = figure(F.replace(F.col("metric"), F.lit("_"), F.lit(" ")), F.col("value"), F.col("yoy"), F.col("qoq"))
    of = of.groupBy("id", "symbol", "seen_on", "filed_on", "fiscal_quarter", "basis").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), line.alias("f")))).alias("lines"))
    lines = F.filter("lines", lambda x: (x["k"] != 1) | (F.get("lines", F.lit(0))["k"] == 1))
    text = F.concat("symbol", F.lit(": "), "fiscal_quarter", F.lit(" "), "basis", F.lit(" results imported (board date "), F.date_format("filed_on", "dd MMM yyyy"), F.lit("). "), F.array_join(F.transform(lines, lambda x: x["f"]), "; "), F.lit("."))
    return of.select(*alert("results", F.col("id").cast("string"), F.col("seen_on"), "high", text))


def pending_alerts(pending: DataFrame, day: Column, statuses: tuple[str, ...] = ("upcoming", "undated", "needs_review")) -> DataFrame:
    """Alerts on announced actions that may have to be recorded."""
    p = pending.where(F.col("status").isin(*statuses))
    text = F.concat("symbol", F.lit(": "), "action_type", F.coalesce(F.concat(F.lit(" "), "ratio"), F.lit("")), F.lit(" detected in a filing (ex-date "), F.coalesce(F.col("ex_date").cast("string"), F.lit("not stated")), F.lit("), status "), "status", F.lit("."))
    return p.select(*alert("pending_action", F.concat_ws(":", "action_type", F.col("filing_id").cast("string")), day, "normal", text))


def pipeline_alerts(runs: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Alerts on runs (started_at, exit_code, failures) that failed, on the exchange's day."""
    local = F.from_utc_timestamp("started_at", zone)
    failures = F.array_join(F.filter(F.split("failures", "\n"), lambda x: x != ""), ", ")
    text = F.concat(F.lit("update at "), F.date_format(local, "HH:mm"), F.lit(" failed: "), failures, F.lit("."))
    return runs.where("exit_code <> 0").select(*alert("pipeline", F.concat(F.lit("run:"), F.unix_seconds("started_at").cast("string")), local.cast("date"), "high", text, F.lit("*")))


def refused(alerts: DataFrame) -> DataFrame:
    """alerts; a task that meets a text that reads like advice fails, and with it the write."""
    bad = F.col("text").rlike(f"(?i){ADVICE}")
    return alerts.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("alert text reads like advice: "), "text")).cast("string")).otherwise(F.col("text")))


def pipeline_status(runs: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """day, status: a line on the last run of each day."""
    local = F.from_utc_timestamp("started_at", zone)
    last = runs.withColumn("day", local.cast("date")).groupBy("day").agg(F.max_by(F.struct("started_at", "exit_code", "failures"), "started_at").alias("r"))
    at = F.date_format(F.from_utc_timestamp(F.col("r.started_at"), zone), "HH:mm")
    failures = F.array_join(F.filter(F.split("r.failures", "\n"), lambda x: x != ""), ", ")
    return last.select("day", F.when(F.col("r.exit_code") == 0, F.concat(F.lit("Pipeline: run at "), at, F.lit(" completed without failures."))).otherwise(F.concat(F.lit("Pipeline: run at "), at, F.lit(" had failures: "), failures, F.lit("."))).alias("status"))


def digest(alerts: DataFrame, symbols: DataFrame, days: DataFrame, status: DataFrame) -> DataFrame:
    """day, digest: a section for each symbol of each day, quiet or with its alerts, and the day's pipeline status."""
    own = alerts.groupBy("symbol", F.col("alert_date").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "text"))), lambda x: F.concat(F.when(x["severity"] == "high", "  [!] ").otherwise("  - "), x["text"])), "\n").alias("lines"))
    each = days.crossJoin(symbols).join(own, ["symbol", "day"], "left")
    section = F.when(F.col("lines").isNull(), F.concat("symbol", F.lit(": quiet day."))).otherwise(F.concat("symbol", F.lit(":\n"), "lines"))
    body = each.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", section.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    out = body.join(status, "day", "left")
    return out.select("day", F.concat(F.lit("Digest for "), F.date_format("day", "dd MMM yyyy"), F.lit("\n"), "body", F.lit("\n"), F.coalesce("status", F.lit("Pipeline: no run recorded for this day."))).alias("digest"))
