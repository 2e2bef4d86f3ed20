"""How often texts are read for their hits, and in what parts the hits come."""

import datetime as dt

import pandas as pd

from tessera.functions import linking
from tessera.functions.linking import Company, TermAutomaton

DAY = dt.date(2024, 1, 9)
ACME = [Company("ACM", aliases=("Acme",))]


def test_a_text_is_read_once(spark):
    """The filter on hits does not bring a second evaluation."""
    rows = spark.createDataFrame([(1, "Acme rose", None, "Acme", DAY), (2, "nobody", None, None, DAY)], "id int, title string, summary string, body string, day date")
    m = linking.mentions(rows, ACME)
    assert m._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.id, r.symbol, r.mention_count) for r in m.collect()] == [(1, "ACM", 2)]


def test_hits_come_in_parts(spark):
    """All rows come, in order, and no part has the hits of many more characters than TOGETHER."""
    n, body = 12, "Acme fell. " * (linking.TOGETHER // 44)
    column = lambda v: pd.Series([v] * n)
    parts = list(linking.hits(ACME).func(iter([(column("Acme"), column(None), column(body), column(DAY))])))
    assert len(parts) > 2 and sum(map(len, parts)) == n and max(map(len, parts)) * len(body) < 2 * linking.TOGETHER


def test_tokens_in_lower_case():
    """Letters that change with those beside them, or in number, and a zero byte."""
    a = TermAutomaton()
    for term in ("οδος", "end"):
        a.add(term, term, any_case=True)
    a.link()
    for text in ("ΟΔΟΣ end", "x ΟΔΟΣ\0end", "İSTAN, End", ""):
        plain = [t.lower() for t in linking.TOKEN.findall(text)]
        assert [of for _, _, of in a.find(text)] == [t for t in plain if t in ("οδος", "end")]
