"""Market queries: bars, corporate actions, indicators, signals, event study. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import series, study
from tessera.operators.series import by_date, crossed, full
from tessera.sources.tables import BARS, bars

ACTIONS = "VALUES ('1-URGENT', DATE '1995-03-01', 'split', 0.5D), ('1-URGENT', DATE '1996-05-20', 'demerger', 0.8D), ('2-HIGH', DATE '1997-01-15', 'bonus', 0.25D)"
HORIZONS = (1, 5, 20, 60)
BENCHMARK = "5-LOW"


def price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("symbol = '2-HIGH' and date between date '1995-01-01' and date '1996-06-30'")


def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices before an ex-date times the factors of all later actions; splits and bonuses divide the volume."""
    actions = spark.sql(f"SELECT * FROM {ACTIONS} AS t(symbol, ex_date, kind, factor)")
    # A symbol's actions are a few in years: bars look up one array and do not move.
    by = actions.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "factor", "kind"))).alias("a"))
    out = bars(spark, sf_dir).join(by, "symbol", "left").withColumn("later", F.filter("a", lambda x: x["ex_date"] > F.col("date")))
    product = lambda arr: F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(1.0), lambda acc, x: acc * x["factor"]))
    out = out.withColumn("f", product(F.col("later"))).withColumn("vf", product(F.filter("later", lambda x: x["kind"].isin("split", "bonus"))))
    f = F.coalesce("f", F.lit(1.0))
    return out.select("symbol", "date", *[(F.col(c) * f).alias(c) for c in ("open", "high", "low", "close")], F.bround(F.col("volume") / F.coalesce("vf", F.lit(1.0))).cast("long").alias("volume"))


def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_averages(bars(spark, sf_dir))


def smoothed_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smoothed(bars(spark, sf_dir))


def unrecorded_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = spark.sql(f"SELECT * FROM {ACTIONS} AS t(symbol, date, kind, factor)")
    b = bars(spark, sf_dir).withColumn("gap", F.col("open") / F.lag("close").over(by_date()) - 1)
    return b.where(F.abs("gap") > 0.25).join(F.broadcast(actions.select("symbol", "date")), ["symbol", "date"], "left_anti").select("symbol", "date", "gap")


def rule_firings(b: DataFrame) -> DataFrame:
    """symbol, date, bar, signal, value: all rules in one pass over one window's shuffle."""
    b = b.withColumn("bar", F.row_number().over(by_date())).withColumn("spread", full(F.avg, "close", 50) / full(F.avg, "close", 200) - 1)
    b = b.withColumn("move", F.col("close") / F.lag("close").over(by_date()) - 1).withColumn("gap", F.col("open") / F.lag("close").over(by_date()) - 1)
    b = b.withColumn("multiple", F.try_divide("volume", full(F.avg, "volume", 20, before=True)))
    b = b.withColumn("top", full(F.max, "high", 252, before=True)).withColumn("bottom", full(F.min, "low", 252, before=True))
    b = b.withColumn("rose", crossed("spread", 0, 1)).withColumn("fell", crossed("spread", 0, -1))
    rules = [
        ("golden_cross", F.col("rose"), F.col("spread") * 100),
        ("death_cross", F.col("fell"), F.col("spread") * 100),
        ("volume_spike", F.col("multiple") > 2, F.col("multiple")),
        ("high_52w_breakout", F.col("close") > F.col("top"), (F.col("close") / F.col("top") - 1) * 100),
        ("low_52w_breakdown", F.col("close") < F.col("bottom"), (F.col("close") / F.col("bottom") - 1) * 100),
        ("gap_up", F.col("gap") > 0.03, F.col("gap") * 100),
        ("gap_down", F.col("gap") < -0.03, F.col("gap") * 100),
    ]
    fired = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(name).alias("signal"), value.alias("value"))) for name, on, value in rules]))
    direction = F.when(F.col("move") > 0, "bullish").when(F.col("move") < 0, "bearish").otherwise("neutral")
    return b.select("symbol", "date", "bar", direction.alias("direction"), F.explode(fired).alias("x")).select("symbol", "date", "bar", "direction", "x.*")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_firings(bars(spark, sf_dir))


def signals_after_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cooled_down(rule_firings(bars(spark, sf_dir)), ["symbol", "signal"], "bar", 20)


def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by symbol, with zeros, and the sum; rows for each rule."""
    symbols = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rules = spark.createDataFrame([(x,) for x in ("golden_cross", "death_cross", "volume_spike", "high_52w_breakout", "low_52w_breakdown", "gap_up", "gap_down")], "signal string")
    made = rule_firings(bars(spark, sf_dir)).groupBy("signal").pivot("symbol", symbols).count()
    out = rules.join(made, "signal", "left").na.fill(0)
    return out.select("signal", *[F.col(f"`{s}`").alias(f"s{s[0]}") for s in symbols], sum(F.col(f"`{s}`") for s in symbols).alias("total"))


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    b = b.select("symbol", "date", (full(F.avg, "close", 5) / full(F.avg, "close", 20) - 1).alias("spread"))
    return series.confirmed_crosses(b, 0.05)


def event_panel(b: DataFrame) -> DataFrame:
    """symbol, date, bar, horizon, entry_date, excess: return from the next open to the close h bars on, less the
    benchmark's between the same dates."""
    b = b.withColumn("bar", F.row_number().over(by_date())).withColumn("entry_date", F.lead("date").over(by_date())).withColumn("entry", F.lead("open").over(by_date()))
    exits = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(by_date()).alias("exit_date"), F.lead("close", h).over(by_date()).alias("exit")) for h in HORIZONS])
    panel = b.withColumn("exits", exits).select("symbol", "date", "bar", "entry_date", "entry", F.explode("exits").alias("x")).select("symbol", "date", "bar", "entry_date", "entry", "x.*")
    base = b.where(F.col("symbol") == BENCHMARK)
    enter, leave = base.select(F.col("date").alias("entry_date"), F.col("open").alias("bench_in")), base.select(F.col("date").alias("exit_date"), F.col("close").alias("bench_out"))
    panel = panel.where(F.col("symbol") != BENCHMARK).join(enter, "entry_date", "left").join(leave, "exit_date", "left")
    return panel.select("symbol", "date", "bar", "horizon", "entry_date", (F.col("exit") / F.col("entry") - F.col("bench_out") / F.col("bench_in")).alias("excess"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declustered signals with their edge over the symbol's mean excess."""
    b = bars(spark, sf_dir)
    panel = event_panel(b)
    fired = series.first_in_clusters(rule_firings(b).where(F.col("symbol") != BENCHMARK), ["symbol", "signal"], "bar", 10)
    sign = F.when(F.col("signal").isin("golden_cross", "high_52w_breakout", "gap_up"), 1).when(F.col("signal") == "volume_spike", F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1).otherwise(0)).otherwise(-1)
    mean = panel.groupBy("symbol", "horizon").agg(F.avg("excess").alias("base"))
    out = fired.withColumn("sign", sign).where("sign <> 0").join(panel.drop("bar"), ["symbol", "date"]).join(mean, ["symbol", "horizon"])
    return out.where("excess is not null").select("symbol", "date", "signal", "horizon", "sign", "excess", (F.col("sign") * (F.col("excess") - F.col("base"))).alias("edge"))


def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("signal", "horizon").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.median("excess").alias("median_excess"), F.avg((F.col("sign") * F.col("excess") > 0).cast("int")).alias("hit_rate"), F.avg("edge").alias("mean_edge"))


def bootstrap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of resampled mean edges, events in the order of symbol and date, and what they say."""
    got = study.intervals(events(spark, sf_dir), ["signal", "horizon"], "edge", ["symbol", "date"])
    return got.withColumn("verdict", study.verdict(F.col("n"), F.col("ci_low"), F.col("ci_high")))


def last_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last close and change, and the extremes of the 52 weeks before the last day."""
    b = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(by_date())).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    year = F.col("date") > F.date_sub("last", 364)
    return b.groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max_by("prev", "date").alias("previous"), F.max(F.when(year, F.col("high"))).alias("high_52w"), F.min(F.when(year, F.col("low"))).alias("low_52w"))


def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of over 3 % and whether at least 3 symbols moved so on that day in one direction."""
    b = bars(spark, sf_dir).withColumn("move", F.col("close") / F.lag("close").over(by_date()) - 1).where("abs(move) > 0.03")
    b = b.withColumn("direction", F.when(F.col("move") > 0, "up").otherwise("down"))
    return b.select("symbol", "date", "move", "direction", (F.count("*").over(W.partitionBy("date", "direction")) >= 3).alias("market_wide"))


def missing_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).where("symbol = '1-URGENT'").select("date")
    days = b.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date")).where(F.weekday("date") < 5)
    return days.join(b, "date", "left_anti")


QUERIES = {f"market_{f.__name__}": f for f in (price_scan, high_water_marks, adjusted_prices, moving_averages, smoothed_indicators, unrecorded_gaps, signals, signals_after_cooldown, signal_counts, confirmed, events, event_study, bootstrap_verdicts, last_metrics, price_moves, missing_weekdays)}

_W = "OVER (PARTITION BY symbol ORDER BY date"
_FULL = lambda fn, c, n: f"CASE WHEN count({c}) {_W} ROWS {n - 1} PRECEDING) = {n} THEN {fn}({c}) {_W} ROWS {n - 1} PRECEDING) END"
_BEFORE = lambda fn, c, n: f"CASE WHEN count({c}) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {fn}({c}) {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
_ACTIONS = f"actions AS (SELECT * FROM ({ACTIONS.replace('D)', ')')}) AS t(symbol, ex_date, kind, factor))"
_FIRED = f"""{BARS}, m AS (
  SELECT *, row_number() {_W}) AS bar, {_FULL("avg", "close", 50)} / ({_FULL("avg", "close", 200)}) - 1 AS spread,
         close / lag(close) {_W}) - 1 AS move, open / lag(close) {_W}) - 1 AS gap, volume / ({_BEFORE("avg", "volume", 20)}) AS multiple,
         {_BEFORE("max", "high", 252)} AS top, {_BEFORE("min", "low", 252)} AS bottom FROM bars
), c AS (SELECT *, lag(spread) {_W}) AS was FROM m), fired AS (
  SELECT symbol, date, bar, CASE WHEN move > 0 THEN 'bullish' WHEN move < 0 THEN 'bearish' ELSE 'neutral' END AS direction, signal, value FROM (
    SELECT *, 'golden_cross' AS signal, spread * 100 AS value FROM c WHERE was <= 0 AND spread > 0
    UNION ALL SELECT *, 'death_cross', spread * 100 FROM c WHERE was >= 0 AND spread < 0
    UNION ALL SELECT *, 'volume_spike', multiple FROM c WHERE multiple > 2
    UNION ALL SELECT *, 'high_52w_breakout', (close / top - 1) * 100 FROM c WHERE close > top
    UNION ALL SELECT *, 'low_52w_breakdown', (close / bottom - 1) * 100 FROM c WHERE close < bottom
    UNION ALL SELECT *, 'gap_up', gap * 100 FROM c WHERE gap > 0.03
    UNION ALL SELECT *, 'gap_down', gap * 100 FROM c WHERE gap < -0.03))"""
_EVENTS = f"""{_FIRED}, base AS (SELECT * FROM bars WHERE symbol = '{BENCHMARK}'), panel AS (
  SELECT l.symbol, l.date, horizon, exit / entry - b2.close / b1.open AS excess FROM (
    {" UNION ALL ".join(f"SELECT symbol, date, {h} AS horizon, lead(date) {_W}) AS entry_date, lead(open) {_W}) AS entry, lead(date, {h}) {_W}) AS exit_date, lead(close, {h}) {_W}) AS exit FROM bars" for h in HORIZONS)}) l
  LEFT JOIN base b1 ON b1.date = entry_date LEFT JOIN base b2 ON b2.date = exit_date WHERE l.symbol <> '{BENCHMARK}'
), kept AS (
  SELECT *, CASE WHEN signal IN ('golden_cross', 'high_52w_breakout', 'gap_up') THEN 1
                 WHEN signal = 'volume_spike' THEN CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END ELSE -1 END AS sign
  FROM (SELECT *, lag(bar) OVER (PARTITION BY symbol, signal ORDER BY bar) AS before FROM fired WHERE symbol <> '{BENCHMARK}') WHERE before IS NULL OR bar - before > 10
), mean AS (SELECT symbol, horizon, avg(excess) AS base FROM panel GROUP BY ALL), events_ AS (
  SELECT k.symbol, k.date, signal, p.horizon, sign, excess, sign * (excess - base) AS edge
  FROM kept k JOIN panel p ON k.symbol = p.symbol AND k.date = p.date JOIN mean m ON m.symbol = p.symbol AND m.horizon = p.horizon WHERE sign <> 0 AND excess IS NOT NULL)"""
_EMA = lambda x, alpha: f"CASE WHEN r.{x} IS NULL THEN b.{x}_in WHEN b.{x}_in IS NULL THEN r.{x} ELSE r.{x} + {alpha} * (b.{x}_in - r.{x}) END"

_CONFIRMED = f"""{BARS}, sp AS (SELECT symbol, date, {_FULL("avg", "close", 5)} / ({_FULL("avg", "close", 20)}) - 1 AS v FROM bars), sq AS (SELECT * FROM sp WHERE v IS NOT NULL), sr AS (SELECT *, coalesce(lag(v) {_W}) <= 0 AND v > 0, false) AS crossed, count(*) FILTER (v <= 0) {_W} ROWS UNBOUNDED PRECEDING) AS run FROM sq),
ar AS (SELECT *, max(CASE WHEN crossed THEN date END) OVER (PARTITION BY symbol, run ORDER BY date ROWS UNBOUNDED PRECEDING) AS armed FROM sr), confirmed AS (SELECT symbol, min(date) AS date FROM ar WHERE v >= 0.05 AND armed IS NOT NULL GROUP BY symbol, armed)"""

ORACLES = {
    "market_confirmed": f"WITH {_CONFIRMED} SELECT * FROM confirmed",
    "market_price_scan": f"WITH {BARS} SELECT * FROM bars WHERE symbol = '2-HIGH' AND date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'",
    "market_high_water_marks": f"WITH {BARS} SELECT symbol, max(date) AS last_date, count(*) AS n_bars FROM bars GROUP BY symbol",
    "market_adjusted_prices": f"""WITH {BARS}, {_ACTIONS}, f AS (
        SELECT b.symbol, b.date, product(factor) AS f, coalesce(product(factor) FILTER (kind IN ('split', 'bonus')), 1) AS vf
        FROM bars b JOIN actions a ON a.symbol = b.symbol AND a.ex_date > b.date GROUP BY ALL)
        SELECT b.symbol, b.date, open * coalesce(f, 1) AS open, high * coalesce(f, 1) AS high, low * coalesce(f, 1) AS low, close * coalesce(f, 1) AS close,
               round_even(volume / coalesce(vf, 1), 0)::BIGINT AS volume FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.date = b.date""",
    "market_moving_averages": f"""WITH {BARS} SELECT symbol, date, close, {_FULL("avg", "close", 20)} AS sma_20, {_FULL("avg", "close", 50)} AS sma_50, {_FULL("avg", "close", 200)} AS sma_200,
        {_FULL("avg", "volume", 20)} AS volume_sma_20, ({_FULL("avg", "close", 20)}) + 2 * ({_FULL("stddev_pop", "close", 20)}) AS bb_upper, ({_FULL("avg", "close", 20)}) - 2 * ({_FULL("stddev_pop", "close", 20)}) AS bb_lower FROM bars""",
    "market_unrecorded_gaps": f"WITH {BARS}, {_ACTIONS}, g AS (SELECT symbol, date, open / lag(close) {_W}) - 1 AS gap FROM bars) SELECT * FROM g WHERE abs(gap) > 0.25 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.symbol = g.symbol AND a.ex_date = g.date)",
    "market_signals": f"WITH {_FIRED} SELECT * FROM fired",
    "market_signals_after_cooldown": f"""WITH RECURSIVE {_FIRED}, kept AS (
        SELECT symbol, signal, min(bar) AS bar FROM fired GROUP BY ALL
        UNION ALL (SELECT k.symbol, k.signal, min(f.bar) AS bar FROM kept k JOIN fired f ON f.symbol = k.symbol AND f.signal = k.signal AND f.bar > k.bar + 20 GROUP BY k.symbol, k.signal, k.bar)
        ) SELECT * FROM kept""",
    "market_signal_counts": f"""WITH {_FIRED}, rules AS (SELECT unnest(['golden_cross', 'death_cross', 'volume_spike', 'high_52w_breakout', 'low_52w_breakdown', 'gap_up', 'gap_down']) AS signal)
        SELECT r.signal, {", ".join(f"count(*) FILTER (symbol LIKE '{k}%') AS s{k}" for k in range(1, 6))}, count(symbol) AS total FROM rules r LEFT JOIN fired f ON f.signal = r.signal GROUP BY r.signal""",
    "market_events": f"WITH {_EVENTS} SELECT * FROM events_",
    "market_event_study": f"""WITH {_EVENTS} SELECT signal, horizon, count(*) AS n, avg(excess) AS mean_excess, median(excess) AS median_excess,
        avg((sign * excess > 0)::INT) AS hit_rate, avg(edge) AS mean_edge FROM events_ GROUP BY ALL""",
    "market_last_metrics": f"""WITH {BARS}, p AS (SELECT *, lag(close) {_W}) AS prev, max(date) OVER (PARTITION BY symbol) AS last FROM bars)
        SELECT symbol, arg_max(close, date) AS close, arg_max(prev, date) AS previous, max(high) FILTER (date > last - 364) AS high_52w, min(low) FILTER (date > last - 364) AS low_52w FROM p GROUP BY symbol""",
    "market_price_moves": f"""WITH {BARS}, m AS (SELECT symbol, date, close / lag(close) {_W}) - 1 AS move FROM bars), d AS (SELECT *, CASE WHEN move > 0 THEN 'up' ELSE 'down' END AS direction FROM m WHERE abs(move) > 0.03)
        SELECT *, count(*) OVER (PARTITION BY date, direction) >= 3 AS market_wide FROM d""",
    "market_missing_weekdays": f"""WITH {BARS}, b AS (SELECT date FROM bars WHERE symbol = '1-URGENT'), r AS (SELECT unnest(generate_series((SELECT min(date) FROM b), (SELECT max(date) FROM b), INTERVAL 1 DAY))::DATE AS date)
        SELECT date FROM r WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM b)""",
    "market_smoothed_indicators": f"""WITH RECURSIVE {BARS}, n AS (
        SELECT symbol, date, row_number() {_W}) AS i, close, close - lag(close) {_W}) AS move,
               greatest(high - low, coalesce(abs(high - lag(close) {_W})), 0), coalesce(abs(low - lag(close) {_W})), 0)) AS tr FROM bars
    ), x AS (SELECT symbol, date, i, close AS e20_in, close AS e12_in, close AS e26_in, greatest(move, 0) AS up_in, greatest(-move, 0) AS down_in, tr AS atr_in FROM n
    ), r AS (
        SELECT symbol, date, i, e20_in AS e20, e12_in AS e12, e26_in AS e26, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, atr_in AS atr FROM x WHERE i = 1
        UNION ALL SELECT b.symbol, b.date, b.i, {_EMA("e20", "2.0::DOUBLE / 21")}, {_EMA("e12", "2.0::DOUBLE / 13")}, {_EMA("e26", "2.0::DOUBLE / 27")}, {_EMA("up", "1.0::DOUBLE / 14")}, {_EMA("down", "1.0::DOUBLE / 14")}, {_EMA("atr", "1.0::DOUBLE / 14")}
        FROM r JOIN x b ON b.symbol = r.symbol AND b.i = r.i + 1
    ), g AS (
        SELECT symbol, date, i, e12 - e26 AS sig FROM r WHERE i = 26
        UNION ALL SELECT r.symbol, r.date, r.i, g.sig + 2.0::DOUBLE / 10 * (r.e12 - r.e26 - g.sig) FROM g JOIN r ON r.symbol = g.symbol AND r.i = g.i + 1
    ) SELECT r.symbol, r.date, CASE WHEN r.i >= 20 THEN e20 END AS ema_20, CASE WHEN r.i >= 26 THEN e12 - e26 END AS macd, CASE WHEN r.i >= 34 THEN sig END AS macd_signal,
             CASE WHEN r.i >= 34 THEN e12 - e26 - sig END AS macd_hist, CASE WHEN r.i >= 15 THEN 100 * up / nullif(up + down, 0) END AS rsi_14, CASE WHEN r.i >= 14 THEN atr END AS atr_14
      FROM r LEFT JOIN g ON g.symbol = r.symbol AND g.i = r.i""",
}
