"""Signal rules: each type is a function of its parameters that gives, over a series of bars by date, when it fires and its value.

A further type is a further entry of RULES. Nothing looks ahead: every frame ends at the bar or before it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.series import by_date, cooled_down, crossed, full, smoothed

Rule = Callable[[dict], tuple[dict[str, Column], Column, Column]]


@dataclass(frozen=True)
class SignalRule:
    """direction: bullish, bearish or from_price; cooldown: bars after a firing in which it does not fire again."""

    name: str
    type: str
    params: dict = field(default_factory=dict)
    direction: str = "from_price"
    cooldown: int = 0
    label: str = ""


def _side(params: dict, up: str = "above") -> int:
    return 1 if params.get("cross", params.get("side", up)) in ("above", "high", "up") else -1


def ma_cross(p: dict) -> tuple[dict[str, Column], Column, Column]:
    """The spread of two moving averages crosses zero; its value is the spread in percent."""
    name = f"spread_{p['fast']}_{p['slow']}"
    return {name: full(F.avg, "close", p["fast"]) / full(F.avg, "close", p["slow"]) - 1}, crossed(name, 0, _side(p)), F.col(name) * 100


def rsi_cross(p: dict) -> tuple[dict[str, Column], Column, Column]:
    """The relative strength (column rsi_14) crosses a level."""
    return {}, crossed("rsi_14", p["level"], _side(p)), F.col("rsi_14")


def volume_spike(p: dict) -> tuple[dict[str, Column], Column, Column]:
    """The volume is a multiple of the mean of the bars before."""
    name = f"multiple_{p['window']}"
    return {name: F.try_divide("volume", full(F.avg, "volume", p["window"], before=True))}, F.col(name) > p["multiple"], F.col(name)


def range_breakout(p: dict) -> tuple[dict[str, Column], Column, Column]:
    """The close is beyond the highs, or the lows, of the bars before; the value is by how much, in percent."""
    side, name = _side(p, "high"), f"bound_{p['window']}_{p['side']}"
    bound = full(F.max, "high", p["window"], before=True) if side > 0 else full(F.min, "low", p["window"], before=True)
    return {name: bound}, side * F.col("close") > side * F.col(name), (F.col("close") / F.col(name) - 1) * 100


def gap(p: dict) -> tuple[dict[str, Column], Column, Column]:
    """The open is that far above or below the close before, in percent."""
    side = _side(p, "up")
    return {"open_gap": (F.col("open") / F.lag("close").over(by_date()) - 1) * 100}, side * F.col("open_gap") > p["threshold"], F.col("open_gap")


RULES: dict[str, Rule] = {"ma_cross": ma_cross, "rsi_cross": rsi_cross, "volume_spike": volume_spike, "range_breakout": range_breakout, "gap": gap}


def firings(bars: DataFrame, rules: list[SignalRule]) -> DataFrame:
    """symbol, date, bar, signal, direction, value of all rules, by one window's shuffle (and one for the relative strength, if a rule asks for it).

    A direction from the price is that of the close over the close before; on a first bar it is neutral."""
    of = bars
    if any(r.type == "rsi_cross" for r in rules):
        of = of.join(smoothed(bars).select("symbol", "date", "rsi_14"), ["symbol", "date"], "left")
    of = of.withColumn("bar", F.row_number().over(by_date())).withColumn("_move", F.col("close") / F.lag("close").over(by_date()) - 1)
    built = [(r, *RULES[r.type](r.params)) for r in rules]
    of = of.withColumns({k: c for _, helpers, _, _ in built for k, c in helpers.items()})
    of = of.withColumns({f"_on_{i}": on for i, (_, _, on, _) in enumerate(built)})
    price = F.when(F.col("_move") > 0, "bullish").when(F.col("_move") < 0, "bearish").otherwise("neutral")
    told = [F.when(F.coalesce(F.col(f"_on_{i}"), F.lit(False)), F.struct(F.lit(r.name).alias("signal"), (price if r.direction == "from_price" else F.lit(r.direction)).alias("direction"), value.alias("value"))) for i, (r, _, _, value) in enumerate(built)]
    out = of.select("symbol", "date", "bar", F.explode(F.array_compact(F.array(*told))).alias("x")).select("symbol", "date", "bar", "x.*")
    cool = {r.name: r.cooldown for r in rules if r.cooldown}
    for bars_ in sorted(set(cool.values())):
        names = [n for n, c in cool.items() if c == bars_]
        kept = cooled_down(out.where(F.col("signal").isin(names)), ["symbol", "signal"], "bar", bars_).withColumn("bar", F.col("bar").cast("int"))
        out = out.where(~F.col("signal").isin(names)).unionByName(out.join(kept, ["symbol", "signal", "bar"], "left_semi"))
    return out


def digest(rules: list[SignalRule]) -> str:
    """What tells a set of rules from every other one, by name, type, parameters, direction and cooldown; labels and the order do not count."""
    told = sorted((r.name, r.type, json.dumps(r.params, sort_keys=True), r.direction, r.cooldown) for r in rules)
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def frozen(configured: list[SignalRule], registered: set[str], of: str) -> list[SignalRule]:
    """The configured rules that claims were registered for. ValueError if one is missing or any of them is not as it was when `of` was its
    digest: what is tested must not be tuned afterwards."""
    found = [r for r in configured if r.name in registered]
    if missing := registered - {r.name for r in found}:
        raise ValueError(f"registered rules are not configured: {sorted(missing)}")
    if digest(found) != of:
        raise ValueError("registered rules have changed")
    return found


def displayed(signals: DataFrame, confirmed: DataFrame, filtered: list[str]) -> DataFrame:
    """signals without those of filtered names, and the confirmed ones in their place."""
    return signals.where(~F.col("signal").isin(filtered)).unionByName(confirmed)


def counted(signals: DataFrame, rules: list[SignalRule]) -> DataFrame:
    """n of each rule, 0 for those that never fired, in the rules' order."""
    names = signals.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)], "k int, signal string")
    return names.join(signals.groupBy("signal").agg(F.count("*").alias("n")), "signal", "left").select("k", "signal", F.coalesce("n", F.lit(0)).alias("n"))
