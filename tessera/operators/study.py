"""Event studies: what followed a signal, against what followed any day, with intervals from resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Samples, seed, least events, verdicts.
SAMPLES, SEED, LEAST = 10_000, 20260924, 30
TOO_FEW, NONE, BETTER, WORSE = "too few events to judge", "no clear difference", "beats baseline (CI > 0)", "worse than baseline (CI < 0)"
#: Resamples whose sums travel in one row, groups that a task holds sums of at once, rows that draw at once.
SLICE, HELD, ROWS = 1000, 64, 64
#: A value is held as a whole number of these, so that sums are the same in any order.
STEP = 2.0**-30
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def draws(positions: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """How often each row (by its position, 64 bits) is in each resample, rows by samples: a Poisson draw of mean 1 that is a function of
    (seed, sample, position) alone, whoever makes it and in whatever order."""
    with np.errstate(over="ignore"):
        of_sample = _mixed(np.uint64(seed) + _A * np.arange(1, samples + 1, dtype=np.uint64))
        mixed = _mixed(_mixed(positions.astype(np.uint64) + _A)[:, None] ^ of_sample[None, :]) >> np.uint64(11)
    # How many values of the distribution function each draw of 53 bits has passed.
    upto = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 18.0)]))
    out = np.zeros(mixed.shape, np.int8)
    for least in np.ceil(upto * 2.0**53).astype(np.uint64):
        over = mixed >= least
        if not over.any():
            break
        out += over
    return out.astype(np.int64)


def intervals(rows: DataFrame, keys: list[str], value: str, order: list[str], samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """keys, n, ci_low, ci_high: the 95 % interval of each group's mean over resamples; null for fewer than two rows.

    In each resample a row counts as often as its draw says, the same law for groups of any size. A row's position is the hash of its
    columns in `order`, which should tell the rows of a group apart. Tasks draw for the rows that lie with them and add up whole numbers,
    so that an interval depends neither on partitions nor on the order of rows, and nobody holds a group. Values are taken to 2^-30."""
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    of = rows.where(F.col(value).isNotNull()).select(*keys, F.round(F.col(value) / STEP).cast("long").alias("_v"), F.xxhash64(*order).alias("_p"))

    def told(sums: dict[tuple, np.ndarray]) -> pd.DataFrame:
        out = [(*key, k, total[0, at : at + SLICE].tobytes(), total[1, at : at + SLICE].tobytes()) for key, total in sums.items() for k, at in enumerate(range(0, samples, SLICE))]
        return pd.DataFrame(out, columns=[*keys, "slice", "sums", "counts"])

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for part in parts:
            for key, group in part.groupby(keys, dropna=False, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                if key not in sums and len(sums) == HELD:
                    yield told(sums)
                    sums = {}
                total = sums.setdefault(key, np.zeros((2, samples), np.int64))
                v, p = group["_v"].to_numpy(), group["_p"].to_numpy().view(np.uint64)
                for at in range(0, len(v), ROWS):
                    w = draws(p[at : at + ROWS], samples, seed)
                    total += np.stack([v[at : at + ROWS] @ w, w.sum(axis=0)])
        if sums:
            yield told(sums)

    def added(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | int = 0
        for part in parts:
            for c in zip(part["sums"], part["counts"]):
                total = total + np.stack([np.frombuffer(x, np.int64) for x in c])
        some = total[1] > 0  # a resample of very few rows may have none
        yield pd.DataFrame([(*key[:-1], (total[0][some] / total[1][some] * STEP).tolist())], columns=[*keys, "means"])

    counts = of.groupBy(*keys).agg(F.count("*").alias("n"))
    slices = of.mapInPandas(drawn, f"{head}, slice int, sums binary, counts binary").groupBy(*keys, "slice").applyInPandas(added, f"{head}, means array<double>")
    ends = slices.select(*keys, F.explode("means").alias("m")).groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    same = [counts[k].eqNullSafe(ends[k]) for k in keys]
    end = lambda k: F.when(F.col("n") > 1, F.col("ends")[k])
    return counts.join(ends, same).select(*[counts[k] for k in keys], "n", end(0).alias("ci_low"), end(1).alias("ci_high"))


def verdict(n: Column, low: Column, high: Column, least: int = LEAST) -> Column:
    return F.when(n < least, TOO_FEW).when(low > 0, BETTER).when(high < 0, WORSE).otherwise(NONE)


def summary(events: DataFrame, baseline: DataFrame, signals: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """signal, horizon, n, mean_return, mean_excess, median_excess, hit_rate, baseline_hit_rate, edge: a row for each signal and horizon, also without events.

    events: symbol, date, signal, horizon, sign, ret, excess; baseline: symbol, horizon, base, base_up (mean excess of all days and share of days with one above 0)."""
    spark = events.sparkSession
    spine = spark.createDataFrame([(s, h) for s in signals for h in horizons], "signal string, horizon int")
    e = events.where("sign <> 0 and excess is not null").join(baseline, ["symbol", "horizon"])
    up = F.when(F.col("sign") > 0, F.col("base_up")).otherwise(1 - F.col("base_up"))
    of = e.groupBy("signal", "horizon").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_return"), F.avg("excess").alias("mean_excess"), F.median("excess").alias("median_excess"), F.avg((F.col("sign") * F.col("excess") > 0).cast("int")).alias("hit_rate"), F.avg(up).alias("baseline_hit_rate"), F.avg(F.col("sign") * (F.col("excess") - F.col("base"))).alias("edge"))
    return spine.join(of, ["signal", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kept_events(events: DataFrame, demergers: DataFrame, beyond: float = 25.0) -> DataFrame:
    """events (symbol, date, value) with reason, why one is left out: a known demerger's ex-date, or a move so large that it is an unrecorded action."""
    known = demergers.select("symbol", F.col("ex_date").alias("date"), F.lit(True).alias("_known"))
    of = events.join(F.broadcast(known), ["symbol", "date"], "left")
    return of.withColumn("reason", F.when(F.col("_known"), "known demerger ex-date").when(F.abs("value") > beyond, F.format_string("overnight move beyond %.0f%%", F.lit(beyond))).otherwise("")).drop("_known")


def hypotheses(claims: DataFrame, results: DataFrame) -> DataFrame:
    """key, signal, horizon, n, ci_low, ci_high, held of claims (key, signal, horizon, side: above or below) at each of their horizons; too few events hold nothing."""
    of = claims.join(results, ["signal", "horizon"], "left")
    side = F.when(F.col("side") == "above", F.col("ci_low") > 0).otherwise(F.col("ci_high") < 0)
    return of.select("key", "signal", "horizon", F.coalesce("n", F.lit(0)).alias("n"), "ci_low", "ci_high", F.coalesce((F.col("n") >= LEAST) & side, F.lit(False)).alias("held"))


def upheld(table: DataFrame) -> DataFrame:
    """key, holds: a claim holds if it does at all of its horizons."""
    return table.groupBy("key").agg(F.bool_and("held").alias("holds"))
