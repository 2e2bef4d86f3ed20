import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import alerts, series, sinks
from tessera.operators.asof import as_of
from tessera.streaming.sessions import windowed


def test_cooldown_and_clusters_differ(spark):
    fired = spark.createDataFrame([("a", p) for p in (0, 8, 16, 24, 40)], "k string, p long")
    assert sorted(r.p for r in series.cooled_down(fired, ["k"], "p", 10).collect()) == [0, 16, 40]
    assert sorted(r.p for r in series.first_in_clusters(fired, ["k"], "p", 10).collect()) == [0, 40]


def test_confirmed_crosses(spark):
    values = [-1, 0.5, -0.5, 0.2, 2.5, 3, -1, 5]
    rows = [("a", dt.date(2026, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    got = series.confirmed_crosses(spark.createDataFrame(rows, "symbol string, date date, spread double"), 2)
    assert sorted(r.date.day for r in got.collect()) == [5, 8]


def test_full_frames_are_null_before(spark):
    rows = [("a", dt.date(2026, 1, 1) + dt.timedelta(i), float(i), 1) for i in range(60)]
    got = series.moving_averages(spark.createDataFrame(rows, "symbol string, date date, close double, volume long"))
    assert got.where("sma_50 is not null").count() == 11


def plain_indicators(rows):
    """Bar by bar."""
    out, y, prev = [], {}, None
    for bar, (h, l, c) in enumerate(rows):
        up, down = (max(c - prev, 0), max(prev - c, 0)) if prev is not None else (None, None)
        x = {"ema_20": c, "ema_12": c, "ema_26": c, "up": up, "down": down, "range": max(h - l, abs(h - prev), abs(l - prev)) if prev is not None else h - l}
        for m, (w, first, _) in series.MEANS.items():
            if bar >= first:
                y[m] = x[m] if bar == first else (1 - w) * y[m] + w * x[m]
        macd = y["ema_12"] - y["ema_26"]
        if bar >= 25:
            y["signal"] = macd if bar == 25 else 0.8 * y["signal"] + 0.2 * macd
        told = lambda m, v: v if bar >= sum((series.MEANS | series.SIGNAL)[m][1:]) - 1 else None
        macd, signal = told("ema_26", macd), told("signal", y.get("signal"))
        rsi = told("up", 100 * y["up"] / (y["up"] + y["down"]) if bar and y["up"] + y["down"] > 0 else None)
        out.append((told("ema_20", y["ema_20"]), macd, signal, macd - signal if signal is not None else None, rsi, told("range", y["range"])))
        prev = c
    return out


def test_indicators_in_blocks_and_in_parts(spark):
    """Blocks give what stepping bar by bar gives, and a run that goes on from a stored state what one run over all bars gives."""
    r = random.Random(2)
    rows = {}
    for symbol, n in (("a", 700), ("b", 130), ("c", 20), ("d", 1)):
        close = 100.0
        rows[symbol] = []
        for _ in range(n):
            close = max(1.0, close + r.gauss(0, 2))
            rows[symbol].append((close + r.random(), close - r.random(), close))
    rows["flat"] = [(5.0, 5.0, 5.0)] * 80
    day = dt.date(2020, 1, 1)
    bars = spark.createDataFrame([(s, day + dt.timedelta(i), *x) for s, all_ in rows.items() for i, x in enumerate(all_)], "symbol string, date date, high double, low double, close double")
    names = ["ema_20", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14"]
    of = lambda df: {(x.symbol, x.date): tuple(x[n] for n in names) for x in df.collect()}

    def same(got, want):
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-8) for a, b in zip(got[k], v)), (k, got[k], v)

    want = {(s, day + dt.timedelta(i)): v for s, all_ in rows.items() for i, v in enumerate(plain_indicators(all_))}
    same(of(series.smoothed(bars)), want)
    got, state = {}, None
    for low, high in ((0, 1), (1, 15), (15, 26), (26, 90), (90, 700)):
        part = bars.where(F.col("date").between(day + dt.timedelta(low), day + dt.timedelta(high - 1)))
        out, new = series.indicators(part, state)
        got |= of(out)
        new = spark.createDataFrame(new.collect(), series.STATE)
        state = new if state is None else new.unionByName(state.join(new, "symbol", "left_anti"))
    same(got, want)


def test_windows_for_any_days(spark):
    """One asked day gives what all days give, a day without a session too; shifts are seen against the trading day before."""
    day = dt.date(2026, 1, 1)
    daily = spark.createDataFrame([("a", day + dt.timedelta(i), 1.0 if i < 24 else -1.0, 1 + i % 2) for i in range(30)] + [("b", day, None, 0)], "symbol string, session_date date, weighted_score double, story_count int")
    ask = lambda *ds: {(r.symbol, r.day): r for r in alerts.averages(daily, spark.createDataFrame([(d,) for d in ds], "day date")).collect()}
    every = ask(*[day + dt.timedelta(i) for i in range(-3, 70)])
    rows = {day + dt.timedelta(i): (1.0 if i < 24 else -1.0, 1 + i % 2) for i in range(30)}
    for (symbol, d), r in every.items():
        for got, n in ((r.avg_7, 7), (r.avg_30, 30)):
            of = [x for at, x in rows.items() if symbol == "a" and d - dt.timedelta(n) < at <= d]
            assert (got is None and not of) or abs(got - sum(w * k for w, k in of) / sum(k for _, k in of)) < 1e-12
    last = day + dt.timedelta(29)
    alone = ask(last)[("a", last)]
    assert alone == every[("a", last)] and alone.avg_7 < 0 < alone.avg_30
    stories = spark.createDataFrame([("a", day + dt.timedelta(25), "Bad news", "S", -0.9), ("a", day + dt.timedelta(2), "Old news", "S", -0.9)], "symbol string, session_date date, title string, source string, score double")
    days = spark.createDataFrame([(day + dt.timedelta(i), day + dt.timedelta(i - 1)) for i in (25, 29)], "day date, previous_session date")
    told = alerts.news_shifts(daily, days, stories).collect()
    assert [(r.symbol, r.alert_date.day) for r in told] == [("a", 26)] and "Bad news" in told[0].text and "Old news" not in told[0].text


def test_as_of(spark):
    t = lambda k: dt.date(2026, 1, k)
    left = spark.createDataFrame([("a", t(3), 1), ("a", t(5), 2), ("a", t(1), 3), ("b", t(3), 4), (None, t(3), 5), ("a", None, 6)], "k string, at date, n int")
    right = spark.createDataFrame([("a", t(2), 20), ("a", t(3), 30), ("a", t(9), 90), ("b", t(4), 40)], "k string, day date, v int")
    of = lambda **how: {r.n: r.got for r in as_of(left, right, ["k"], "at", "day", {"v": "got"}, **how).collect()}
    assert of() == {1: 30, 2: 30, 3: None, 4: None, 5: None, 6: None}
    assert of(same=False) == {1: 20, 2: 30, 3: None, 4: None, 5: None, 6: None}
    assert of(forward=True) == {1: 30, 2: 90, 3: 20, 4: 40, 5: None, 6: None}
    assert of(forward=True, same=False) == {1: 90, 2: 90, 3: 20, 4: 40, 5: None, 6: None}
    assert as_of(left, right.limit(0), ["k"], "at", "day", {"v": "got"}).where("got is null").count() == 6 and as_of(left.limit(0), right, ["k"], "at", "day", {"v": "got"}).count() == 0


def test_sinks(spark):
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(2, None), (3, 3.0)], "k int, v double")
    assert sorted(map(tuple, sinks.upsert(stored, new, ["k"]).select("k", "n", "v").collect())) == [(1, "a", 1.0), (2, "b", None), (3, None, 3.0)]
    with pytest.raises(ValueError):
        sinks.conform(new.union(new), stored, ["k"])
    with pytest.raises(ValueError):
        sinks.conform(new.withColumn("x", F.lit(1)), stored, ["k"])
    assert {r.k for r in sinks.changed_keys(stored, stored.where("k = 1"), "k").collect()} == {2}


def test_dates_and_text(spark):
    one = spark.createDataFrame([(dt.date(2026, 6, 30), "HTTP://Ex.com:80/a/?utm_x=1&b=2&a=1#f", "One\ntwo. \nThree")], "d date, u string, t string")
    got = one.select(dates.fiscal_quarter(F.col("d")), dates.months_before(F.col("d"), 3), text.normal_url(F.col("u")), text.leading_sentences(F.lit("A b. C d! E"), 2)).first()
    assert tuple(got) == ("FY27Q1", dt.date(2026, 3, 31), "https://ex.com/a?a=1&b=2", "A b. C d!")


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2026, 1, 1 + i % 3, 5), "x", float(i)) for i in range(9)], "ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions_out").collect())) == sorted(map(tuple, windowed(rows).collect()))
