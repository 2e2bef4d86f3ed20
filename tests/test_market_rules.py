"""Calendars, rules, studies, registries, results and writes, case by case."""

import datetime as dt
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alerts, calendar, results, scoring, sinks, study
from tessera.operators.rules import SignalRule, digest, firings, frozen
from tessera.sources import parsers, registries

KNOWN = [dt.date(2026, 9, d) for d in (18, 21, 22, 23, 25)]


@pytest.fixture(scope="module")
def days(spark):
    return calendar.calendar(spark.createDataFrame([(d,) for d in KNOWN], "day date"), dt.date(2026, 9, 1), dt.date(2026, 10, 10))


@pytest.mark.parametrize(("moment", "session"), [
    ("2026-09-18 15:30:00", "2026-09-18"), ("2026-09-18 15:30:01", "2026-09-21"), ("2026-09-18 15:31:00", "2026-09-21"), ("2026-09-19 09:00:00", "2026-09-21"), ("2026-09-23 16:00:00", "2026-09-25"), ("2026-09-24 10:00:00", "2026-09-25"), ("2026-09-25 18:00:00", "2026-09-28"), ("2026-09-29 10:00:00", "2026-09-29"), ("2026-09-12 10:00:00", "2026-09-18"),
])
def test_sessions(spark, days, moment, session):
    m = spark.createDataFrame([(dt.datetime.fromisoformat(moment) - dt.timedelta(minutes=330),)], "m timestamp")
    assert str(calendar.with_session(m, "m", days).first().session_date) == session


def test_previous_sessions(days):
    got = {r.day: r.previous_session for r in days.collect()}
    assert [str(got[dt.date(2026, 9, d)]) for d in (25, 24, 21, 29, 28)] == ["2026-09-23", "2026-09-23", "2026-09-18", "2026-09-28", "2026-09-25"]


def walk(spark, n, seed=7, until=None):
    r, rows, price = random.Random(seed), [], 100.0
    for i in range(n):
        open_ = price * (1 + r.uniform(-0.05, 0.05))
        price = open_ * (1 + r.gauss(0, 0.03))
        rows.append(("A", dt.date(2020, 1, 1) + dt.timedelta(i), open_, max(open_, price) * 1.01, min(open_, price) * 0.99, price, int(r.uniform(100, 1000) * (5 if r.random() < 0.05 else 1))))
    return spark.createDataFrame(rows[:until], "symbol string, date date, open double, high double, low double, close double, volume long")


RULES = [SignalRule("x", "ma_cross", {"fast": 5, "slow": 20, "cross": "above"}, "bullish"), SignalRule("r", "rsi_cross", {"length": 14, "level": 60, "cross": "above"}), SignalRule("v", "volume_spike", {"window": 20, "multiple": 2.0}), SignalRule("b", "range_breakout", {"window": 30, "side": "high"}, "bullish", 10), SignalRule("g", "gap", {"threshold": 3.0, "side": "up"})]


def test_rules_do_not_look_ahead(spark):
    whole = {(r.date, r.signal, round(r.value, 9)) for r in firings(walk(spark, 220), RULES).collect()}
    assert {s for _, s, _ in whole} == {"x", "r", "v", "b", "g"}
    for until in (80, 137, 200):
        part = {(r.date, r.signal, round(r.value, 9)) for r in firings(walk(spark, 220, until=until), RULES).collect()}
        assert part == {x for x in whole if x[0] < dt.date(2020, 1, 1) + dt.timedelta(until)}


def test_cooldown_and_strict_limits(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1000 if i < 25 else 2000) for i in range(27)]
    b = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")
    got = {(r.signal, r.bar) for r in firings(b, [SignalRule("v", "volume_spike", {"window": 20, "multiple": 2.0}), SignalRule("b", "range_breakout", {"window": 5, "side": "high"}, cooldown=20)]).collect()}
    assert got == {("b", 6), ("b", 27)}


def test_intervals(spark):
    """Any partitions and order give one interval, that of a plain version with the same draws; the law is the bootstrap's."""
    x = np.random.default_rng(3).normal(0.02, 0.05, 300)
    rows = spark.createDataFrame([("s", 1, i, float(v)) for i, v in enumerate(x)] + [("t", 1, 0, 1.0), ("t", None, 1, 2.0), ("t", None, 2, 3.0)], "signal string, horizon int, k int, edge double")
    of = lambda df, **how: {(r.signal, r.horizon): (r.n, r.ci_low, r.ci_high) for r in study.intervals(df, ["signal", "horizon"], "edge", ["k"], **how).collect()}
    got = of(rows.repartition(5), samples=2000)
    assert got == of(rows.orderBy(F.desc("k")).coalesce(1), samples=2000)
    p = np.array([r[0] for r in rows.where("signal = 's'").orderBy("k").select(F.xxhash64("k")).collect()], np.int64).view(np.uint64)
    w = study.draws(p, 2000)
    means = (w * x[:, None]).sum(axis=0) / w.sum(axis=0)
    assert got[("s", 1)][0] == 300 and np.allclose(got[("s", 1)][1:], np.percentile(means, [2.5, 97.5]), atol=1e-8)
    assert got[("t", 1)] == (1, None, None) and 2 <= got[("t", None)][1] <= got[("t", None)][2] <= 3
    rng = np.random.default_rng(study.SEED)
    classic = np.percentile(x[rng.integers(0, 300, (10_000, 300))].mean(axis=1), [2.5, 97.5])
    assert np.allclose(of(rows)[("s", 1)][1:], classic, atol=0.001)


def test_frozen_rules():
    rules = [SignalRule("a", "gap", {"threshold": 2.0, "side": "up"}, label="A"), SignalRule("b", "gap", {"side": "up", "threshold": 3.0}), SignalRule("c", "rsi_cross", {"level": 30})]
    of = digest(rules[:2])
    assert frozen(rules[::-1], {"a", "b"}, of) == [rules[1], rules[0]]
    with pytest.raises(ValueError, match="changed"):
        frozen([replace(rules[0], params={"threshold": 2.5, "side": "up"}), rules[1]], {"a", "b"}, of)
    with pytest.raises(ValueError, match="not configured"):
        frozen(rules[1:], {"a", "b"}, of)


def test_draws_are_poisson():
    w = study.draws(np.arange(500, dtype=np.uint64), 2000)
    shares = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6, 24]), atol=0.002)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.08 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15


@pytest.mark.parametrize(("n", "low", "high", "said"), [(29, 1.0, 2.0, study.TOO_FEW), (30, 0.1, 0.2, study.BETTER), (30, -0.2, -0.1, study.WORSE), (30, -0.1, 0.1, study.NONE)])
def test_verdicts(spark, n, low, high, said):
    assert spark.range(1).select(study.verdict(F.lit(n), F.lit(low), F.lit(high))).first()[0] == said


def test_claims(spark):
    r = spark.createDataFrame([("d", 5, 50, 0.1, 0.2), ("d", 20, 50, -0.1, 0.2), ("u", 1, 50, -0.3, -0.1), ("w", 1, 5, -0.3, -0.1)], "signal string, horizon int, n long, ci_low double, ci_high double")
    c = spark.createDataFrame([("H1", "d", 5, "above"), ("H1", "d", 20, "above"), ("H2", "u", 1, "below"), ("H3", "w", 1, "below"), ("H4", "none", 1, "below")], "key string, signal string, horizon int, side string")
    t = study.hypotheses(c, r)
    assert {(x.key, x.horizon): x.held for x in t.collect()} == {("H1", 5): True, ("H1", 20): False, ("H2", 1): True, ("H3", 1): False, ("H4", 1): False}
    assert {x.key: x.holds for x in study.upheld(t).collect()} == {"H1": False, "H2": True, "H3": False, "H4": False}


def test_partitions_are_replaced_and_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "s string, v int"), path, "s")
    sinks.replace_partition(spark.createDataFrame([("a", 9)], "s string, v int"), path, "s", ["a", "b"])
    assert {(r.s, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("c", 3)}


def test_alert_texts(spark):
    bad = spark.createDataFrame([("a recommendation to buy now",), ("the buyback and the sell-off",)], "text string")
    assert alerts.refused(bad.where("text like 'the%'")).count() == 1
    with pytest.raises(Exception, match="reads like advice"):
        alerts.refused(bad).collect()


def test_scoring(spark):
    rows = spark.createDataFrame([(1, "good good bad"), (2, "bad"), (3, "meh"), (4, None)], "id int, t string")
    s = scoring.WordScorer({"good"}, {"bad"})
    got = {r.id: (r.label, round(r.score, 3)) for r in scoring.scored(rows, "t", s).collect()}
    assert got == {1: ("positive", 0.25), 2: ("negative", -0.5), 3: ("neutral", 0.0), 4: ("neutral", 0.0)}
    stored = spark.createDataFrame([(1, "words"), (2, "other")], "id int, model_name string")
    assert {r.id for r in scoring.pending(rows, stored, ["id"], s).collect()} == {2, 3, 4}


@pytest.mark.parametrize(("kind", "entries", "said"), [
    ("watchlist", [{"symbol": "A"}], "missing"), ("watchlist", [{"symbol": "A", "name": "x", "colour": 1}], "unknown"), ("watchlist", [{"symbol": "A", "name": "x"}, {"symbol": "a", "name": "y"}], "repeats"), ("watchlist", [{"symbol": "A", "name": 3}], "wrong type"), ("study", [{"horizons": [1]}], "missing"),
])
def test_registries_are_checked(kind, entries, said):
    with pytest.raises(registries.RegistryError, match=said):
        registries.checked(entries, kind)


def test_registries(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"symbol": "A", "name": "Acme Ltd", "aliases": ["Acme"], "conditional": [{"names": ["Old"], "context": ["car"], "from": "2025-10-01"}]}]))
    firm = registries.companies(registries.read(tmp_path / "w.json"))[0]
    assert firm.search == ("Acme Ltd",) and firm.conditional[0].since == dt.date(2025, 10, 1)
    (tmp_path / "h.yaml").write_text("- day: 2026-01-26\n- day: 2026-08-15\n")
    assert [r.day for r in registries.table(spark, registries.read(tmp_path / "h.yaml"), "holidays").collect()] == ["2026-01-26", "2026-08-15"]
    rule = registries.signal_rules([{"name": "g", "type": "gap", "params": {"threshold": 3.0, "side": "up"}}])[0]
    assert rule.direction == "from_price" and rule.label == "g"
    for bad in ({"type": "moon", "params": {}}, {"type": "gap", "params": {"side": "up"}}, {"type": "gap", "params": {"threshold": 1.0, "side": "up"}, "direction": "up"}):
        with pytest.raises(registries.RegistryError):
            registries.signal_rules([{"name": "x", **bad}])
    assert registries.terms("A + B - C = D") == [(0, 1, "A"), (0, 1, "B"), (0, -1, "C"), (1, 1, "D")]
    for bad in ("A + B", "A = B = C", "A * B = C"):
        with pytest.raises(registries.RegistryError):
            registries.terms(bad)
    o = {"symbol": "A", "quarter": "FY27Q1", "basis": "standalone", "metric": "eps", "value": 2, "source": "x", "check": "A = B", "reason": "r"}
    assert registries.checks(spark, [o]).count() == 2 and registries.table(spark, [o], "overrides").first().value == 2.0


def test_numbers_of_rows(spark):
    lines = ["Profit (Refer note 8) 18187 49 11275,87 (7) 12%", "no numbers here", "Total 5 of 7", "(12.5) 3"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(text.last_numbers(F.col("t"))).collect()]
    assert got == [[18187.49, 11275.87, -7.0, 12.0], [], [7.0], [-12.5, 3.0]]


def test_contradicting_sections_and_foreign_ones(spark):
    page = lambda v, unit="(Rs in crore)": f"<p>Standalone Financial Results for the quarter ended June 30, 2026</p><p>{unit}</p><table><tr><td>Revenue from operations</td><td>{v}</td><td>9.00</td></tr></table>"
    files = [("same", page("5.00") + page("5.00")), ("other", page("5.00") + page("6.00")), ("us", page("5.00", "(US $ in crore)")), ("none", "<p>hello</p>"), ("minus", page("(5.00</td><td>)"))]
    f = spark.createDataFrame([(n, bytearray(h.encode())) for n, h in files], "file string, content binary")
    got = {r.file: (r.value, r.problem) for r in parsers.merged_sections(parsers.table_metrics(parsers.page_lines(f), "sec")).collect()}
    assert got == {"same": (5.0, None), "other": (5.0, "revenue"), "minus": (-5.0, None)}
    undated = page("5.00").replace("Standalone", "Consolidated") + "<p>Results of Acme Limited (Standalone Information)</p><p>(in crore)</p>" + page("7.00").split("</p>")[-1]
    got = parsers.table_metrics(parsers.page_lines(spark.createDataFrame([("u", bytearray(undated.encode()))], "file string, content binary")), "sec").collect()
    assert {(r.basis, str(r.period_end), r.value) for r in got} == {("consolidated", "2026-06-30", 5.0), ("standalone", "2026-06-30", 7.0)}
    assert {r.kind for r in parsers.xbrl_rows(spark.createDataFrame([("a", bytearray(b"<x")), ("b", bytearray(b"<y/>"))], "file string, content binary")).collect()} == {"error"}


def test_kinds_of_files_and_companies(spark):
    rows = [(bytearray(b"%PDF-1.4"), "Acme Limited"), (bytearray(b"<?xml version='1.0'?><xbrl/>"), "ZED WORKS LTD results"), (bytearray(b"\n<DOCUMENT><TYPE>6-K"), "Acme holds"), (bytearray(b"hello"), "")]
    got = spark.createDataFrame(rows, "c binary, t string").select(parsers.file_kind(F.col("c")), parsers.company_of(F.col("t"), {"A": "Acme Ltd", "Z": "Zed Works Limited"})).collect()
    assert [tuple(r) for r in got] == [("pdf", "A"), ("xbrl", "Z"), ("html", None), ("unknown", None)]


def test_flags(spark):
    d = spark.createDataFrame([("a", "Q1", "s", "revenue", 60.0, 10.0), ("b", "Q1", "s", "net_profit", -10.0, 10.0), ("c", "Q1", "s", "revenue", -10.0, 10.0), ("d", "Q1", "s", "revenue", 50.0, 10.0), ("e", "Q1", "s", "revenue", 5.0, None)], "symbol string, fiscal_quarter string, basis string, metric string, value double, prev_q double")
    ack = spark.createDataFrame([("b", "Q1", "s", "net_profit", "sign change (profit/loss swing?) - check", "looked"), ("a", "Q1", "s", "revenue", "other text", "no")], "symbol string, fiscal_quarter string, basis string, metric string, flag string, reason string")
    got = {r.symbol: (r.flag, r.flag_reviewed) for r in results.flagged(d, ack).collect()}
    assert got["a"] == ("6.0x vs previous quarter", None) and got["b"][1] == "looked" and "stay positive" in got["c"][0] and got["d"] == got["e"] == (None, None)
