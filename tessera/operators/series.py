"""Window operators over series of one key: moving frames, crossings, cooldown, clusters, smoothing.

All take a DataFrame with symbol and date; a series is what one symbol has, in the order of dates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("date")


def full(fn: Callable[[Column], Column], column: str, n: int, before: bool = False) -> Column:
    """fn over the last n rows, or the n rows before this one; null until there are n."""
    frame = by_date().rowsBetween(-n, -1) if before else by_date().rowsBetween(1 - n, 0)
    return F.when(F.count(column).over(frame) == n, fn(F.col(column)).over(frame))


def crossed(value: str, level: float, side: int) -> Column:
    """value was on or below the level in the row before and is above it now (side 1), or the reverse (-1)."""
    was, now = F.lag(value).over(by_date()), F.col(value)
    return F.coalesce((side * was <= side * level) & (side * now > side * level), F.lit(False))


def moving_averages(bars: DataFrame) -> DataFrame:
    """SMA 20, 50 and 200, SMA 20 of the volume, and Bollinger bands (20 rows, 2 deviations)."""
    out = bars.select("symbol", "date", "close", *[full(F.avg, "close", n).alias(f"sma_{n}") for n in (20, 50, 200)], full(F.avg, "volume", 20).alias("volume_sma_20"), full(F.stddev_pop, "close", 20).alias("_s"))
    return out.select("symbol", "date", "close", "sma_20", "sma_50", "sma_200", "volume_sma_20", (F.col("sma_20") + 2 * F.col("_s")).alias("bb_upper"), (F.col("sma_20") - 2 * F.col("_s")).alias("bb_lower"))


#: Rows of a block, and how small a factor is nothing to a double.
BLOCK, NOTHING = 64, 1e-18
#: Name of a mean's state, its weight of a new value, the bar (from 0) it begins with, and how many values it needs.
MEANS = {"ema_20": (2 / 21, 0, 20), "ema_12": (2 / 13, 0, 12), "ema_26": (2 / 27, 0, 26), "up": (1 / 14, 1, 14), "down": (1 / 14, 1, 14), "range": (1 / 14, 0, 14)}
SIGNAL = {"signal": (2 / 10, 25, 9)}
#: What the last bar of a symbol leaves for the next ones.
STATE = "symbol string, bar long, last_close double, " + ", ".join(f"s_{m} double" for m in (*MEANS, *SIGNAL))


def recursive_means(rows: DataFrame, means: dict[str, tuple[float, int, int]], states: bool = False) -> DataFrame:
    """rows with s_NAME for each of means, the exponential mean of x_NAME up to the row: y = (1 - w) y before + w x, from a first value on.

    rows: symbol, bar (its number, without gaps), n (the number among these rows, from 0) and x_NAME; with states also y_NAME, what the mean was
    before the first of these rows (null if it had none). Each step is an affine map. A block of rows composes its own maps from nothing; a
    block's end is its own value and those of the blocks before it, times powers of (1 - w) until these are nothing to a double; a row is
    its own value in the block and what the block began with. So a series is neither one task's frame nor stepped through row by row."""
    rows = rows.withColumn("_k", F.floor(F.col("n") / BLOCK)).withColumn("_i", (F.col("n") % BLOCK).cast("double"))
    inside = W.partitionBy("symbol", "_k").orderBy("n").rowsBetween(W.unboundedPreceding, 0)

    def own(name: str) -> Column:
        weight, first, _ = means[name]
        x, keep = F.col(f"x_{name}"), 1 - weight
        b = F.when(F.col("bar") < first, 0.0).when(F.col("bar") == first, x).otherwise(weight * x)
        return (F.sum(b * F.pow(F.lit(keep), -F.col("_i"))).over(inside) * F.pow(F.lit(keep), F.col("_i"))).alias(f"_own_{name}")

    rows = rows.select("*", *[own(m) for m in means])
    ends = rows.groupBy("symbol", "_k").agg(*[F.max_by(f"_own_{m}", "n").alias(f"_end_{m}") for m in means], *([F.first(f"y_{m}").alias(f"_y_{m}") for m in means] if states else []))
    order = W.partitionBy("symbol").orderBy("_k")

    def before(name: str) -> Column:
        """The mean at the end of the block before."""
        keep = (1 - means[name][0]) ** BLOCK
        back = max(1, math.ceil(math.log(NOTHING) / math.log(keep)))
        folded = F.aggregate(F.collect_list(f"_end_{name}").over(order.rowsBetween(-back, -1)), F.lit(0.0), lambda s, b: s * keep + b)
        return folded + (F.coalesce(F.col(f"_y_{name}"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k")) if states else F.lit(0.0))

    begins = ends.select("symbol", "_k", *[before(m).alias(f"_before_{m}") for m in means])
    rows = rows.join(begins, ["symbol", "_k"])

    def mean(name: str) -> Column:
        weight, first, _ = means[name]
        # A block whose first row is the first value, or comes before it, begins with nothing.
        carried = F.when(F.col("bar") - F.col("_i") > first, F.col(f"_before_{name}") * F.pow(F.lit(1 - weight), F.col("_i") + 1)).otherwise(0.0)
        return F.when(F.col("bar") >= first, carried + F.col(f"_own_{name}")).alias(f"s_{name}")

    return rows.select(*[c for c in rows.columns if not c.startswith("_")], *[mean(m) for m in means])


def indicators(bars: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """EMA 20, MACD (12, 26, 9), RSI 14 and ATR 14 of bars (symbol, date, high, low, close), null during warm-up, and the state that the last bar
    of each symbol leaves. With the state of an earlier run the bars are those that follow it, and the result is that of all bars in one run."""
    n = F.row_number().over(by_date()) - 1
    rows = bars.select("symbol", "date", "high", "low", "close", n.alias("n"))
    if state is None:
        rows = rows.withColumn("bar", F.col("n").cast("long")).withColumn("_last", F.lit(None).cast("double"))
    else:
        rows = rows.join(state.select("symbol", F.col("bar").alias("_bar"), F.col("last_close").alias("_last"), *[F.col(f"s_{m}").alias(f"y_{m}") for m in (*MEANS, *SIGNAL)]), "symbol", "left")
        rows = rows.withColumn("bar", F.col("n") + F.coalesce(F.col("_bar") + 1, F.lit(0)))
    prev = F.coalesce(F.lag("close").over(by_date()), F.col("_last"))
    move = F.col("close") - prev
    # Without a bar before, greatest leaves the high over the low.
    x = {m: F.col("close") for m in ("ema_20", "ema_12", "ema_26")} | {"up": F.greatest(move, F.lit(0.0)), "down": F.greatest(-move, F.lit(0.0)), "range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))}
    rows = recursive_means(rows.select("*", *[c.alias(f"x_{m}") for m, c in x.items()]), MEANS, state is not None)
    rows = recursive_means(rows.withColumn("x_signal", F.col("s_ema_12") - F.col("s_ema_26")), SIGNAL, state is not None)
    ready = lambda m: F.col("bar") >= sum((MEANS | SIGNAL)[m][1:]) - 1
    warm = lambda m, c=None: F.when(ready(m), F.col(f"s_{m}") if c is None else c)
    macd, total = warm("ema_26", F.col("x_signal")), F.col("s_up") + F.col("s_down")
    rsi = warm("up", F.when(total > 0, 100 * F.col("s_up") / total))
    out = rows.select("symbol", "date", warm("ema_20").alias("ema_20"), macd.alias("macd"), warm("signal").alias("macd_signal"), (macd - warm("signal")).alias("macd_hist"), rsi.alias("rsi_14"), warm("range").alias("atr_14"))
    kept = F.struct("bar", F.col("close").alias("last_close"), *[f"s_{m}" for m in (*MEANS, *SIGNAL)])
    return out, rows.groupBy("symbol").agg(F.max_by(kept, "bar").alias("s")).select("symbol", "s.*")


def smoothed(bars: DataFrame) -> DataFrame:
    """The indicators of all bars."""
    return indicators(bars)[0]


def cooled_down(fired: DataFrame, keys: list[str], position: str, rows: int) -> DataFrame:
    """Of firings (keys, position) those at least `rows` behind the last one kept. The state is one number, so
    that the fold runs over the firings of a key alone."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    step = lambda a, x: F.when(a["last"].isNull() | (x - a["last"] > rows), F.struct(x.alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    sorted_ = fired.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(position).cast("long"))).alias("_p"))
    return sorted_.select(*keys, F.explode(F.aggregate("_p", start, step, lambda a: a["kept"])).alias(position))


def first_in_clusters(events: DataFrame, keys: list[str], position: str, gap: int) -> DataFrame:
    """Events without another, kept or not, within `gap` positions before."""
    before = F.lag(position).over(W.partitionBy(*keys).orderBy(position))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(position) - F.col("_b") > gap)).drop("_b")


def confirmed_crosses(spreads: DataFrame, gap: float, side: int = 1) -> DataFrame:
    """spreads: symbol, date, spread. A crossing of 0 arms, a spread on or below 0 disarms, and the first spread of
    at least gap while armed is the confirmed cross."""
    s = spreads.where("spread is not null").withColumn("v", side * F.col("spread"))
    s = s.withColumn("crossed", F.coalesce((F.lag("v").over(by_date()) <= 0) & (F.col("v") > 0), F.lit(False)))
    upto = by_date().rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("run", F.sum(F.when(F.col("v") <= 0, 1).otherwise(0)).over(upto)).withColumn("armed", F.max(F.when(F.col("crossed"), F.col("date"))).over(W.partitionBy("symbol", "run").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    hit = s.where((F.col("v") >= gap) & F.col("armed").isNotNull())
    return hit.groupBy("symbol", "armed").agg(F.min("date").alias("date")).select("symbol", "date")


def normalised_bars(raw: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Bars (symbol, date, open, high, low, close, volume) of a provider's rows (symbol, moment, prices, volume, arrival): the date is the exchange's; rows
    without any price, and flat ones without volume, which stand for holidays, go; of repeated dates the last arrival stays; no volume is 0."""
    from tessera.functions.dates import is_filler

    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    of = raw.withColumn("date", F.from_utc_timestamp("moment", zone).cast("date")).where(F.coalesce(*prices).isNotNull())
    of = of.where(~F.coalesce(is_filler(*prices, F.col("volume")), F.lit(False)))
    last = of.groupBy("symbol", "date").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "arrival").alias("b"))
    return last.select("symbol", "date", "b.open", "b.high", "b.low", "b.close", F.coalesce("b.volume", F.lit(0)).alias("volume"))
