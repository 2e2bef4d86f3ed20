"""Rules with parameters, event studies, claims, incremental indicators, marks on charts, and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import scoring, sentiment, series
from tessera.operators import study as S
from tessera.operators.rules import SignalRule, counted, displayed, firings, frozen
from tessera.operators.series import by_date, full
from tessera.plans import entities, market
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("study")
query = AREA.query
RULES = [
    SignalRule("fast_cross", "ma_cross", {"fast": 10, "slow": 50, "cross": "above"}, "bullish"), SignalRule("slow_cross", "ma_cross", {"fast": 10, "slow": 50, "cross": "below"}, "bearish"),
    SignalRule("rsi_below_30", "rsi_cross", {"length": 14, "level": 30, "cross": "below"}, "bullish"), SignalRule("rsi_above_70", "rsi_cross", {"length": 14, "level": 70, "cross": "above"}, "bearish"),
    SignalRule("burst", "volume_spike", {"window": 20, "multiple": 2.5}), SignalRule("low_60", "range_breakout", {"window": 60, "side": "low"}, "bearish", cooldown=20), SignalRule("gap_down", "gap", {"threshold": 50.0, "side": "down"}, "bearish"),
]
_W = "OVER (PARTITION BY symbol ORDER BY date"
_RULES = f"""{T.BARS}, rsi AS (SELECT symbol, date, rsi_14 FROM ({market.ORACLES["market_smoothed_indicators"]})), m AS (SELECT b.*, row_number() {_W}) AS bar, close / lag(close) {_W}) - 1 AS move, {market._FULL("avg", "close", 10)} / ({market._FULL("avg", "close", 50)}) - 1 AS spread, volume / ({market._BEFORE("avg", "volume", 20)}) AS multiple,
  {market._BEFORE("min", "low", 60)} AS bottom, (open / lag(close) {_W}) - 1) * 100 AS gap, r.rsi_14 FROM bars b LEFT JOIN rsi r USING (symbol, date)), c AS (SELECT *, lag(spread) {_W}) AS was, lag(rsi_14) {_W}) AS rsi_was, CASE WHEN move > 0 THEN 'bullish' WHEN move < 0 THEN 'bearish' ELSE 'neutral' END AS way FROM m),
fired AS (SELECT symbol, date, bar, 'fast_cross' AS signal, 'bullish' AS direction, spread * 100 AS value FROM c WHERE was <= 0 AND spread > 0 UNION ALL SELECT symbol, date, bar, 'slow_cross', 'bearish', spread * 100 FROM c WHERE was >= 0 AND spread < 0
  UNION ALL SELECT symbol, date, bar, 'rsi_below_30', 'bullish', rsi_14 FROM c WHERE rsi_was >= 30 AND rsi_14 < 30 UNION ALL SELECT symbol, date, bar, 'rsi_above_70', 'bearish', rsi_14 FROM c WHERE rsi_was <= 70 AND rsi_14 > 70
  UNION ALL SELECT symbol, date, bar, 'burst', way, multiple FROM c WHERE multiple > 2.5 UNION ALL SELECT symbol, date, bar, 'gap_down', 'bearish', gap FROM c WHERE gap < -50),
low AS (SELECT symbol, date, bar, 'low_60' AS signal, 'bearish' AS direction, (close / bottom - 1) * 100 AS value FROM c WHERE close < bottom)"""
_COOL = "kept AS (SELECT symbol, min(bar) AS bar FROM low GROUP BY symbol UNION ALL (SELECT k.symbol, min(l.bar) AS bar FROM kept k JOIN low l ON l.symbol = k.symbol AND l.bar > k.bar + 20 GROUP BY k.symbol, k.bar))"


@query(f"WITH RECURSIVE {_RULES}, {_COOL}, every AS (SELECT * FROM fired UNION ALL SELECT low.* FROM low JOIN kept USING (symbol, bar)) SELECT symbol, date, signal, direction, round(value, 6) AS value FROM every")
def rule_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of rules of all types over all bars, with a cooldown for one of them."""
    return firings(T.bars(spark, sf_dir), RULES).select("symbol", "date", "signal", "direction", F.round("value", 6).alias("value"))


@query(f"WITH RECURSIVE {_RULES}, {_COOL}, every AS (SELECT * FROM fired UNION ALL SELECT low.* FROM low JOIN kept USING (symbol, bar)), r AS (SELECT * FROM (VALUES (0, 'fast_cross'), (1, 'slow_cross'), (2, 'rsi_below_30'), (3, 'rsi_above_70'), (4, 'burst'), (5, 'low_60'), (6, 'gap_down')) t(k, signal)) SELECT k, signal, (SELECT count(*) FROM every e WHERE e.signal = r.signal) AS n FROM r")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(firings(T.bars(spark, sf_dir), RULES), RULES)


_CONFIRMED = market._CONFIRMED


@query(f"WITH {_CONFIRMED} SELECT * FROM confirmed")
def confirmed_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.confirmed(spark, sf_dir)


@query(f"WITH {market._FIRED}, {_CONFIRMED.split(', sp AS', 1)[0].replace(T.BARS, 'z AS (SELECT 1)')}, sp AS {_CONFIRMED.split(', sp AS', 1)[1]} SELECT symbol, date, signal FROM fired WHERE signal NOT IN ('golden_cross', 'death_cross') UNION ALL SELECT symbol, date, 'confirmed_cross' FROM confirmed")
def displayed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with confirmed crosses in place of the plain ones."""
    s = market.rule_firings(T.bars(spark, sf_dir)).select("symbol", "date", "signal")
    return displayed(s, market.confirmed(spark, sf_dir).select("symbol", "date", F.lit("confirmed_cross").alias("signal")), ["golden_cross", "death_cross"])


@query(f"WITH {market._FIRED} SELECT f.symbol, f.date, f.signal, row_number() OVER (PARTITION BY f.symbol, f.date, direction ORDER BY signal) AS stack, round(CASE direction WHEN 'bullish' THEN b.low * (1 - 0.02 * row_number() OVER (PARTITION BY f.symbol, f.date, direction ORDER BY signal)) WHEN 'bearish' THEN b.high * (1 + 0.02 * row_number() OVER (PARTITION BY f.symbol, f.date, direction ORDER BY signal)) ELSE b.close END, 4) AS y FROM fired f JOIN bars b ON b.symbol = f.symbol AND b.date = f.date WHERE f.date >= DATE '2000-01-01' AND f.signal IN ('gap_up', 'gap_down', 'volume_spike')")
def signal_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the selected signals stand on a chart: below the low, above the high or at the close, one above the other."""
    b = T.bars(spark, sf_dir)
    s = market.rule_firings(b).where("signal in ('gap_up', 'gap_down', 'volume_spike')").select("symbol", "date", "signal", "direction")
    of = s.join(b.where("date >= date '2000-01-01'").select("symbol", "date", "high", "low", "close"), ["symbol", "date"])
    of = of.withColumn("stack", F.row_number().over(W.partitionBy("symbol", "date", "direction").orderBy("signal")))
    y = F.when(F.col("direction") == "bullish", F.col("low") * (1 - 0.02 * F.col("stack"))).when(F.col("direction") == "bearish", F.col("high") * (1 + 0.02 * F.col("stack"))).otherwise(F.col("close"))
    return of.select("symbol", "date", "signal", "stack", F.round(y, 4).alias("y"))


def returns(b: DataFrame) -> DataFrame:
    """symbol, date, horizon, ret: from the next open to the close h bars on."""
    b = b.withColumn("entry", F.lead("open").over(by_date()))
    exits = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(by_date()).alias("exit")) for h in market.HORIZONS])
    of = b.withColumn("exits", exits).select("symbol", "date", "entry", F.explode("exits").alias("x"))
    return of.select("symbol", "date", "x.horizon", (F.col("x.exit") / F.col("entry") - 1).alias("ret"))


SIGNALS = ["golden_cross", "death_cross", "volume_spike", "high_52w_breakout", "low_52w_breakdown", "gap_up", "gap_down", "never"]


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.bars(spark, sf_dir)
    panel = market.event_panel(b)
    base = panel.groupBy("symbol", "horizon").agg(F.avg("excess").alias("base"), F.avg((F.col("excess") > 0).cast("int")).alias("base_up"))
    e = market.events(spark, sf_dir).select("symbol", "date", "signal", "horizon", "sign", "excess").join(returns(b), ["symbol", "date", "horizon"])
    return S.summary(e, base, SIGNALS, market.HORIZONS)


_SUMMARY = f"""{market._EVENTS}, rt AS (SELECT symbol, date, horizon, exit / entry - 1 AS ret FROM ({" UNION ALL ".join(f"SELECT symbol, date, {h} AS horizon, lead(open) {_W}) AS entry, lead(close, {h}) {_W}) AS exit FROM bars" for h in market.HORIZONS)})),
bu AS (SELECT symbol, horizon, avg((excess > 0)::INT) AS base_up FROM panel WHERE excess IS NOT NULL GROUP BY ALL), ev AS (SELECT e.*, rt.ret, CASE WHEN sign > 0 THEN base_up ELSE 1 - base_up END AS up FROM events_ e JOIN rt USING (symbol, date, horizon) JOIN bu USING (symbol, horizon)),
sp_ AS (SELECT s AS signal, h AS horizon FROM (SELECT unnest({SIGNALS}) AS s), (SELECT unnest({list(market.HORIZONS)}) AS h)),
summary AS (SELECT sp_.signal, sp_.horizon, count(ev.symbol) AS n, avg(ret) AS mean_return, avg(excess) AS mean_excess, median(excess) AS median_excess, avg((sign * excess > 0)::INT) AS hit_rate, avg(up) AS baseline_hit_rate, avg(edge) AS edge FROM sp_ LEFT JOIN ev ON ev.signal = sp_.signal AND ev.horizon = sp_.horizon GROUP BY ALL)"""


@query(f"WITH {_SUMMARY} SELECT signal, horizon, n, " + ", ".join(f"round(coalesce({c}, 99), 8) AS {c}" for c in ("mean_return", "mean_excess", "median_excess", "hit_rate", "baseline_hit_rate", "edge")) + " FROM summary")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed each signal at each horizon, 99 where nothing did; signals without events keep their rows."""
    s = summary_rows(spark, sf_dir)
    return s.select("signal", "horizon", "n", *[F.round(F.coalesce(c, F.lit(99.0)), 8).alias(c) for c in ("mean_return", "mean_excess", "median_excess", "hit_rate", "baseline_hit_rate", "edge")])


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal, horizon, n, ci_low, ci_high, verdict; events in the order of symbol, date, signal."""
    e = market.events(spark, sf_dir)
    got = S.intervals(e, ["signal", "horizon"], "edge", ["symbol", "date"])
    return got.withColumn("verdict", S.verdict(F.col("n"), F.col("ci_low"), F.col("ci_high")))


@query()
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_rows(spark, sf_dir)


@query()
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered claims at each of their horizons."""
    c = spark.createDataFrame([("H1", "gap_down", 5, "above"), ("H1", "gap_down", 20, "above"), ("H2", "gap_up", 1, "below")], "key string, signal string, horizon int, side string")
    return S.hypotheses(c, verdict_rows(spark, sf_dir))


@query(f"WITH {T.BARS}, g AS (SELECT symbol, date, (open / lag(close) {_W}) - 1) * 100 AS value FROM bars), e AS (SELECT * FROM g WHERE abs(value) > 50), d AS (SELECT * FROM ({T.ACTIONS.replace('D)', ')')}) t(symbol, date, kind, factor) WHERE kind = 'demerger') SELECT e.symbol, e.date, CASE WHEN d.symbol IS NOT NULL THEN 'known demerger ex-date' WHEN abs(value) > 200 THEN 'overnight move beyond 200%' ELSE '' END AS reason FROM e LEFT JOIN d ON d.symbol = e.symbol AND d.date = e.date WHERE e.date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30'")
def universe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the registered period, and why some are left out."""
    b = T.bars(spark, sf_dir).withColumn("value", (F.col("open") / F.lag("close").over(by_date()) - 1) * 100).where("abs(value) > 50")
    b = b.where("date between date '1995-06-01' and date '2000-06-30'").select("symbol", "date", "value")
    return S.kept_events(b, T.corporate_actions(spark).where("action_type = 'demerger'"), 200.0).select("symbol", "date", "reason")


#: The gap rules that claims are registered for, and their digest on that day.
UNIVERSE = [*RULES, SignalRule("gap_up", "gap", {"threshold": 80.0, "side": "up"}, "bullish")]
REGISTERED, DIGEST = {"gap_down", "gap_up"}, "a59e338b9057c746551b5d5fd02e6dd7792b5e3c192f0416d873d913b4feca70"
_UNIVERSE = f"""{T.BARS}, g AS (SELECT symbol, date, (open / lag(close) {_W}) - 1) * 100 AS value, close / lag(close) {_W}) - 1 AS move FROM bars WHERE date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30'), u AS (SELECT symbol, date, CASE WHEN value > 80 THEN 'gap_up' ELSE 'gap_down' END AS signal, CASE WHEN value > 80 THEN 'bullish' ELSE 'bearish' END AS direction, value FROM g WHERE value > 80 OR value < -50),
d AS (SELECT * FROM ({T.ACTIONS.replace('D)', ')')}) t(symbol, date, kind, factor) WHERE kind = 'demerger')"""


@query(f"WITH {_UNIVERSE} SELECT u.symbol, u.date, signal, direction, round(value, 6) AS value, CASE WHEN d.symbol IS NOT NULL THEN 'known demerger ex-date' WHEN abs(value) > 200 THEN 'overnight move beyond 200%' ELSE '' END AS reason FROM u LEFT JOIN d ON d.symbol = u.symbol AND d.date = u.date")
def universe_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered rules, as they were frozen, over all symbols' bars of the registered period; why some events are left out."""
    b = T.bars(spark, sf_dir).where("date between date '1995-06-01' and date '2000-06-30'")
    found = firings(b, frozen(UNIVERSE, REGISTERED, DIGEST)).select("symbol", "date", "signal", "direction", F.round("value", 6).alias("value"))
    return S.kept_events(found, T.corporate_actions(spark).where("action_type = 'demerger'"), 200.0)


_KEPT = ("ema_20", "macd", "macd_signal", "rsi_14", "atr_14")


@query(f"WITH {T.BARS}, i AS (SELECT symbol, date, {market._FULL('avg', 'close', 50)} AS sma_50 FROM bars), r AS (SELECT * FROM ({market.ORACLES['market_smoothed_indicators']})) SELECT i.symbol, i.date, round(coalesce(sma_50, -1), 4) AS sma_50, " + ", ".join(f"round(coalesce(r.{c}, -1), 4) AS {c}" for c in _KEPT) + " FROM i JOIN r ON r.symbol = i.symbol AND r.date = i.date WHERE i.symbol = '1-URGENT' OR i.date >= DATE '2001-03-01'")
def incremental_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators from the last stored date on; all of a symbol whose actions have changed. Means over windows look back over 600 days of bars,
    recursive ones go on from the state that the stored bars have left."""
    b, since = T.bars(spark, sf_dir), F.lit("2001-03-01").cast("date")
    dirty = spark.createDataFrame([("1-URGENT",)], "symbol string")
    whole, clean = b.join(dirty, "symbol", "left_semi"), b.join(dirty, "symbol", "left_anti")
    _, state = series.indicators(clean.where(F.col("date") < since))
    new, _ = series.indicators(clean.where(F.col("date") >= since), state)
    recursive = series.smoothed(whole).unionByName(new).select("symbol", "date", *[F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c) for c in _KEPT])
    of = lambda df: df.select("symbol", "date", F.round(F.coalesce(full(F.avg, "close", 50), F.lit(-1.0)), 4).alias("sma_50"))
    means = of(whole).unionByName(of(clean.where(F.col("date") >= F.date_sub(since, 600))).where(F.col("date") >= since))
    return means.join(recursive, ["symbol", "date"])


@query(f"WITH RECURSIVE {T.BARS}, r AS (SELECT symbol, date, rsi_14 FROM ({market.ORACLES['market_smoothed_indicators']})), p AS (SELECT b.symbol, date, close, lag(close) {_W}) AS prev, high, low, {market._FULL('avg', 'close', 200)} AS sma_200, max(date) OVER (PARTITION BY symbol) AS last FROM bars b) SELECT p.symbol, arg_max(close, date) AS close, round(100 * (arg_max(close, date) / arg_max(prev, date) - 1), 6) AS change_pct, max(high) FILTER (date > last - 364) AS high_52w, min(low) FILTER (date > last - 364) AS low_52w, round(arg_max(sma_200, date), 4) AS sma_200, round(arg_max(rsi_14, date), 6) AS rsi_14, arg_max(close, date) > arg_max(sma_200, date) AS above FROM p JOIN r USING (symbol, date) GROUP BY p.symbol")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's last figures: close, change, extremes of 52 weeks, relative strength, and whether it is above its long mean."""
    b = T.bars(spark, sf_dir)
    of = b.withColumn("prev", F.lag("close").over(by_date())).withColumn("sma", full(F.avg, "close", 200)).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    of = of.join(series.smoothed(b).select("symbol", "date", "rsi_14"), ["symbol", "date"])
    year, last = F.col("date") > F.date_sub("last", 364), lambda c: F.max_by(c, "date")
    return of.groupBy("symbol").agg(last("close").alias("close"), F.round(100 * (last("close") / last("prev") - 1), 6).alias("change_pct"), F.max(F.when(year, F.col("high"))).alias("high_52w"), F.min(F.when(year, F.col("low"))).alias("low_52w"), F.round(last("sma"), 4).alias("sma_200"), F.round(last("rsi_14"), 6).alias("rsi_14"), (last("close") > last("sma")).alias("above"))


GOOD, BAD = {"that", "which", "people"}, {"there", "were", "this"}


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0), c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({str(sorted(GOOD))[1:-1]}))) AS g, len(list_filter(w, lambda x: x IN ({str(sorted(BAD))[1:-1]}))) AS b FROM w)
    SELECT doc_id, CASE WHEN g >= b AND g >= 1 THEN 'positive' WHEN b >= 1 THEN 'negative' ELSE 'neutral' END AS label, round((g - b) / (g + b + 1), 9) AS score FROM c""")
def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that no model of this name has scored, by a scorer that counts words."""
    scorer = scoring.WordScorer(GOOD, BAD)
    d = T.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    stored = d.where("doc_id % 5 = 0").select("doc_id", F.lit("words").alias("model_name"))
    return scoring.scored(scoring.pending(d, stored, ["doc_id"], scorer), "text", scorer).select("doc_id", "label", F.round("score", 9).alias("score"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, sentiment of the labelled documents: toxic ones are negative, others of low quality neutral."""
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "neutral").when(F.col("quality") == 1, "positive")
    return T.table(spark, sf_dir, "documents").select("doc_id", "text").join(T.table(spark, sf_dir, "labels").select("doc_id", kind.alias("sentiment")), "doc_id")


def trained(spark: SparkSession, sf_dir: str) -> sentiment.TrainedScorer:
    return sentiment.fit(labelled(spark, sf_dir), "text", "sentiment", "doc_id")


@query()
def scored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked mentions with the trained model's score of the sentences that name the company."""
    return scoring.scored(entities.scorer_inputs(spark, sf_dir), "text", trained(spark, sf_dir)).drop("text")


@query()
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the trained model, and whether it has neither been fitted nor calibrated on them."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    of = scoring.scored(d, "text", trained(spark, sf_dir)).withColumn("held_out", sentiment.fold("doc_id") == 0)
    return of.select("doc_id", "held_out", "label", *[F.round(c, 6).alias(c) for c in ("p_positive", "p_negative", "p_neutral", "score")])


@query()
def scorer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the trained model does on labelled documents that it has not seen."""
    rows = labelled(spark, sf_dir)
    return sentiment.held_out(rows, "text", "sentiment", "doc_id", trained(spark, sf_dir)).withColumn("calibration_error", F.round("calibration_error", 6))


@query(f"WITH {T.BARS}, o AS (SELECT *, hash_k FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) % 4 AS hash_k FROM bars)) SELECT symbol, date, open, CASE WHEN hash_k = 1 AND open = high AND high = low AND low = close THEN 1.0 ELSE close END AS close, CASE WHEN hash_k = 1 THEN 0 ELSE volume END AS volume FROM o WHERE hash_k <> 0")
def normalised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's frame into bars: moments to exchange dates, rows without prices and flat fillers out, the last of repeated dates, no volume is 0."""
    b = T.bars(spark, sf_dir).withColumn("k", F.row_number().over(by_date()) % 4)
    moment = F.to_timestamp(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00+05:30")))
    raw = b.select("symbol", moment.alias("moment"), *[F.when(F.col("k") != 0, F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.when(F.col("k") > 1, F.col("volume")).alias("volume"), F.lit(2).alias("arrival"))
    earlier = raw.where("open is not null").withColumns({"close": F.lit(1.0), "arrival": F.lit(1)})
    return series.normalised_bars(raw.unionByName(earlier)).select("symbol", "date", "open", "close", "volume")
