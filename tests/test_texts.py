"""Companies in texts, titles that tell the same, filings and forum posts: the rules, case by case."""

import datetime as dt
import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import actions as A
from tessera.functions import linking, posts, similarity
from tessera.functions.linking import Company, Conditional, Registry, Sentences
from tessera.operators import actions, components, stories

DAY = dt.date(2026, 9, 20)
BANK = Company("NORBANK", "North Bank Ltd", aliases=("North Bank", "NBK"), excludes=("NBK Life", "North Bank Arena"))
OIL = Company("SOLARIS", "Solaris Ltd", ambiguous=("Solaris",))
CARS = Company("VELOX", "Velox Ltd", aliases=("Velox Passenger Cars",), conditional=(Conditional(("Velox Motors",), ("car", "EV", "Nimbus"), dt.date(2025, 10, 1)),))
ALL = [BANK, OIL, CARS]


def named(company, text, day=DAY):
    return [h[1] for h in Registry([company]).hits(text, day)[0]]


@pytest.mark.parametrize(("company", "text", "names"), [
    (BANK, "north bank and NBK rise", ["North Bank", "NBK"]), (BANK, "nbk rises, North Banks fall", []), (BANK, "NBK Life sells cover at the North Bank Arena", []), (BANK, "NORBANK up", ["NORBANK"]), (BANK, "Norbank up", []),
    (OIL, "Solaris shares fell", ["Solaris"]), (OIL, "SOLARIS profit", ["SOLARIS"]), (OIL, "solaris shares fell", []), (OIL, "Solaris is a film. Shares fell.", []), (OIL, "Solaris Ltd. shares fell", ["Solaris"]),
    (CARS, "Velox Motors sells a car", ["Velox Motors"]), (CARS, "Velox Motors sells trucks", []), (CARS, "Velox Passenger Cars", ["Velox Passenger Cars"]), (CARS, "Velox Motors. A car.", []), (CARS, "Velox Motors and its nimbus", []), (CARS, "Velox Motors and its NIMBUS", ["Velox Motors"]),
])
def test_names(company, text, names):
    assert named(company, text) == names


def test_conditional_names_count_before_their_day():
    assert named(CARS, "Velox Motors sells trucks", dt.date(2025, 9, 30)) == ["Velox Motors"]


def test_sentences():
    s = Sentences('One Ltd. rose. Two fell!\nthree Rs. 5 now. "Four" ends')
    assert [s.at(i) for i in (0, 16, 26, 33)] == ["One Ltd. rose.", "Two fell!", "three Rs. 5 now.", "three Rs. 5 now."] and s.at(48) == '"Four" ends'


def test_one_pass_for_a_large_registry():
    """The time goes with the text, not with the companies or the square of the text."""
    few = [Company(f"SYM{i}", aliases=(f"Firm {i} Works", f"F{i}"), ambiguous=(f"Orb{i}",), excludes=(f"Firm {i} Works Club",)) for i in range(5000)]
    text = "Firm 77 Works rose with Orb4000 shares. The Firm 12 Works Club met. F4999 and firm  9 works fell, not F5000. "
    want = [("SYM9", "Firm 9 Works"), ("SYM77", "Firm 77 Works"), ("SYM4000", "Orb4000"), ("SYM4999", "F4999")]
    registry = Registry(few)
    took = []
    for n in (20, 40, 80):
        began = time.perf_counter()
        got, _ = registry.hits(text * n, DAY)
        took.append(time.perf_counter() - began)
        assert [(few[h[0]].symbol, h[1]) for h in got] == [w for w in want for _ in range(n)]
    assert took[2] < 12 * took[0] + 0.2
    began = time.perf_counter()
    assert Sentences("One rose. Two fell in it. " * 20_000).number(520_000 - 3) == 39_999 and time.perf_counter() - began < 5


def plain_hits(company, text, day):
    """By regular expressions, one company at a time."""
    bound = lambda x: rf"(?<!\w)(?:{x})(?!\w)"
    spaced = lambda t, end="": r"\s+".join(map(re.escape, t.split())) + end

    def term(t, any_case=False, end=""):
        if t.isupper():
            return bound(spaced(t, end))
        return bound(f"(?i:{spaced(t, end)})") if any_case or t[0].islower() else bound(f"{spaced(t, end)}|{spaced(t.upper(), end.upper())}")

    for x in sorted(company.excludes, key=len, reverse=True):
        text = re.sub(term(x, True), lambda m: " " * len(m[0]), text)
    ways = [(n, 0, (), None) for n in (*company.aliases, company.symbol)] + [(n, 1, c.context, c.since) for c in company.conditional for n in c.names] + [(n, 2, linking.FINANCE, None) for n in company.ambiguous]
    ways.sort(key=lambda n: (-len(n[0]), n[1]))
    s = Sentences(text)
    for m in re.finditer("|".join(f"({term(n[0], n[1] < 2)})" for n in ways), text):
        name, kind, context, since = ways[m.lastindex - 1]
        if not kind or (kind == 1 and since and day < since) or any(re.search(term(c, end="(?:s|es)?"), s.at(m.start())) for c in context):
            yield name, m.start(), m.end()


@given(st.lists(st.sampled_from(["North", "north", "Bank", "BANK", "NBK", "nbk", "Life", "Arena", "Solaris", "SOLARIS", "solaris", "Velox", "Motors", "Passenger", "Cars", "car", "EVs", "Nimbus", "shares", "Price", "Q1", "NSE", "nse", "Ltd", "-", ".", ". ", "! ", "\n", "  ", ", ", "_", "é"]), max_size=25), st.booleans())
def test_hits_are_those_of_plain_patterns(words, glued):
    text = ("" if glued else " ").join(words)
    got, _ = Registry(ALL).hits(text, DAY)
    assert [(ALL[h[0]].symbol, h[1], h[4], h[5]) for h in got] == [(c.symbol, *h) for c in ALL for h in plain_hits(c, text, DAY)]


def test_confidence(spark):
    long = "x " * 800
    cases = [
        ("North Bank profit up", None, None, "NORBANK", "title", 0.95), ("Solaris shares fall", None, None, "SOLARIS", "title", 0.8), ("News", "NBK opens", None, "NORBANK", "summary", 0.75), ("News", "Solaris stock", None, "SOLARIS", "summary", 0.65),
        ("News", None, "NBK. NBK. NBK " + long, "NORBANK", "body", 0.7), ("News", None, "NBK and NBK " + long, "NORBANK", "body", 0.55), ("News", None, "NBK " + long, "NORBANK", "body", 0.3), ("News", None, "NBK", "NORBANK", "body", 0.55), ("News", None, "Solaris stock " + long, "SOLARIS", "body", 0.2),
        ("Sensex falls; North Bank among losers", None, None, "NORBANK", "title", 0.475), ("North Bank leads as Sensex rises", None, None, "NORBANK", "title", 0.95), ("Nifty slips; North Bank jumps 2%", None, None, "NORBANK", "title", 0.95), ("Nifty ends flat: Acme, North Bank fall", None, None, "NORBANK", "title", 0.475),
    ]
    rows = [(i, t, s, b, DAY) for i, (t, s, b, *_) in enumerate(cases)]
    got = linking.mentions(spark.createDataFrame(rows, "id int, title string, summary string, body string, day date"), ALL).collect()
    assert {(r.id, r.symbol, r.location, r.confidence) for r in got} == {(i, *c[3:]) for i, c in enumerate(cases)}
    text = linking.mentions(spark.createDataFrame([(1, "North Bank news", "NBK rose. It was fine. NBK rose. North Bank fell", None, DAY)], "id int, title string, summary string, body string, day date"), ALL).select(linking.scored_text(F.col("title"), F.col("sentences"), 2)).first()[0]
    assert text == "North Bank news NBK rose. North Bank fell"


def test_labelled_headlines(spark):
    labelled = [("North Bank raises rates", ["NORBANK"]), ("A walk by the north bank of the river", ["NORBANK"]), ("Solaris Q2 profit doubles", ["SOLARIS"]), ("Watching Solaris again", []), ("Velox Motors unveils an EV", ["VELOX"]), ("Velox Motors trucks recalled", []), ("NBK Life IPO opens", []), ("NBK, Solaris shares gain", ["NORBANK", "SOLARIS"]), ("Rain expected", []), ("VELOX hits record", ["VELOX"])]
    rows = spark.createDataFrame([(i, t, None, None, DAY) for i, (t, _) in enumerate(labelled)], "id int, title string, summary string, body string, day date")
    expected = spark.createDataFrame([(i, s) for i, (_, ss) in enumerate(labelled) for s in ss], "id int, symbol string")
    got = linking.quality(linking.mentions(rows, ALL).where(f"confidence >= {linking.THRESHOLD}"), expected, ["id", "symbol"]).first()
    assert got.precision >= 0.9 and got.recall >= 0.9
    none = rows.where("id < 0").selectExpr("id", "title AS symbol")
    assert tuple(linking.quality(none, none, ["id", "symbol"]).first()) == (1.0, 1.0)


def test_similarity():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
        return row[-1]

    for a, b in [("", ""), ("a", ""), ("kitten", "sitting"), ("abcabcabc", "cba"), ("news sentiment " * 9, "new sentiments " * 8)]:
        assert similarity.common_length(a, b) == plain(a, b)
    assert similarity.set_ratio("a b c d", "d c b a e") == 100 and similarity.sorted_ratio("b a", "a b") == 100 and similarity.set_ratio("a b", "c d") < 60 and similarity.set_ratio("", "a") == 0


def article(i, title, hours=0.0, story=None, published=True):
    at = dt.datetime(2026, 9, 20, 10) + dt.timedelta(hours=hours)
    return (i, title, at if published else None, at, story)


def story_of(spark, rows, companies=None):
    d = spark.createDataFrame(rows, "id string, title string, published_at timestamp, first_seen_at timestamp, story_id string")
    return {r.id: r.story_id for r in stories.grouped(d, companies).collect()}


LONG = "Acme wins a very large order for river turbines from the port"


@pytest.mark.parametrize(("other", "same"), [
    (LONG.upper() + "!", True), ("Acme wins a very large order for river turbines from the port, says the ministry", True), (LONG.replace("turbines", "turbine"), True),
    ("Rain is expected in the north on most days of the week", False), (LONG + " on Friday", True),
])
def test_titles(spark, other, same):
    got = story_of(spark, [article("a", LONG), article("b", other, 3)])
    assert got == {"a": "a", "b": "a" if same else "b"}


def test_stories(spark):
    got = story_of(spark, [article("a", LONG + " Friday"), article("b", LONG + " Monday", 1)])
    assert got == {"a": "a", "b": "b"}
    assert story_of(spark, [article("a", LONG + " 12 crore"), article("b", LONG + " 13 crore", 1)]) == {"a": "a", "b": "b"}
    assert story_of(spark, [article("a", LONG), article("b", LONG, 49)]) == {"a": "a", "b": "b"}
    assert story_of(spark, [article("a", LONG), article("b", LONG, 47), article("c", LONG, 90)]) == dict.fromkeys("abc", "a")
    assert story_of(spark, [article("a", LONG, story=None), article("b", LONG, 2, story="old", published=False), article("c", "Acme up", 1), article("d", "Acme down", 1)]) == {"a": "old", "b": "old", "c": "c", "d": "d"}
    firms = {"ACME": stories.company_pattern(["acme"]), "ZED": stories.company_pattern(["zed works"])}
    assert story_of(spark, [article("a", LONG), article("b", LONG.replace("Acme", "Zed Works"), 1)], firms) == {"a": "a", "b": "b"}
    assert story_of(spark, []) == {}


def test_no_similar_title_is_missed(spark):
    """Every pair of titles within 48 hours that is alike to 90 per cent is a candidate, and groups are those of all pairs."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeiou") for _ in range(r.randint(1, 8))) for _ in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(40)] + ["a b c d e f g h i", "a b c d e f g h j", "a"]
    titles = []
    for t in base:
        titles.append(t)
        for _ in range(5):
            w = t.split()
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(w))
                w[k] = r.choice([w[k] + "s", w[k][1:] or "z", r.choice(words), w[k] + " " + r.choice(words)])
            r.shuffle(w)
            titles.append(" ".join(w + r.choices(words, k=r.choice([0, 0, 0, 1, 6]))))
    rows = [(i, t, [k for k in t.split() if k == "bee"], float(r.randrange(0, 400) * 1800)) for i, t in enumerate(titles)]
    at = {i: (t, s) for i, t, _, s in rows}
    like = lambda a, b: (similarity.set_ratio if min(len(a.split()), len(b.split())) >= 6 else similarity.sorted_ratio)(a, b) >= 90
    want = {(i, j) for i in at for j in at if i < j and abs(at[i][1] - at[j][1]) <= 48 * 3600 and like(at[i][0], at[j][0])}
    df = spark.createDataFrame(rows, "id long, norm string, keys array<string>, seconds double")
    found = stories.candidate_titles(df.select("id", "norm", F.array(F.floor(F.col("seconds") / (48 * 3600))).alias("blocks")))
    got = {(x.a, x.b) for x in found.collect()}
    assert len(want) > 100 and want <= got and len(got) < 0.7 * len(rows) ** 2 / 2
    links = {(x.a, x.b) for x in stories.matching_pairs(df).collect()}
    groups = lambda pairs: {frozenset(v) for v in _components(len(rows), pairs)}
    assert groups(links) == groups(want)


def _components(n, pairs):
    of = {i: {i} for i in range(n)}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for i in of[b]:
                of[i] = of[a]
    return of.values()


def test_regrouping_changes_little(spark):
    rows = [article("a", LONG, story="a"), article("b", LONG, 30, story="a"), article("c", LONG, 60), article("d", "Rain is expected in the north on most days", 61), article("z", LONG, -300, story="z")]
    d = spark.createDataFrame(rows, "id string, title string, published_at timestamp, first_seen_at timestamp, story_id string")
    assert {r.id: r.story_id for r in stories.regrouped(d).collect()} == {"c": "a", "d": "d"}


def test_components_of_a_chain(spark):
    got = {r.id: r.component for r in components.components(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 80: 80, 90: 80}


@pytest.mark.parametrize(("text", "day"), [
    ("14 Oct 2025", (2025, 10, 14)), ("14th October, 2025", (2025, 10, 14)), ("October 14, 2025", (2025, 10, 14)), ("3rd of March 2024", (2024, 3, 3)), ("05-02-2024", (2024, 2, 5)), ("5/2/2024", (2024, 2, 5)), ("5.12.2024", (2024, 12, 5)), ("Sept. 1 2024", None), ("31 Feb 2024", None), ("soon", None),
])
def test_day_first_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(A.day_first(F.col("t"))).first()[0]
    assert got == (day and dt.date(*day)) or (text.startswith("Sept") and got == dt.date(2024, 9, 1))


@pytest.mark.parametrize(("kind", "text", "ratio", "factor", "ex", "assumed"), [
    ("bonus", "bonus issue in the ratio of 1:4, record date 14 March 2024", "1:4", 0.8, "2024-03-14", True), ("bonus", "a 2:1 bonus", "2:1", 1 / 3, None, False), ("bonus", "three (3) fully paid-up bonus equity shares for every two held", "3:2", 0.4, None, False),
    ("split", "from face value of Rs. 10 each into shares of Rs. 2 each; ex-date: Friday, 5 February 2024", "1:5", 0.2, "2024-02-05", False), ("split", "face value of Rs 2 to a value of Rs 10", None, None, None, False), ("rights", "one rights equity share for every five shares", "1:5", None, None, False), ("buyback", "buyback", None, None, None, False),
])
def test_extraction(spark, kind, text, ratio, factor, ex, assumed):
    parts = A.extracted(F.lit(kind), F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in parts.items()]).first()
    assert got.ratio == ratio and (got.price_factor is None if factor is None else abs(got.price_factor - factor) < 1e-12) and str(got.ex_date or "") == (ex or "") and got.assumed == assumed


@pytest.mark.parametrize(("text", "kind", "tags"), [
    ("Outcome of board meeting: dividend and audited results", "results", ["board_meeting", "dividend", "results"]), ("Board meeting intimation to consider dividend", "board_meeting", ["board_meeting", "dividend"]), ("Dividend distribution policy", "other", ["other"]),
    ("Meeting of the board will be held", "board_meeting", ["board_meeting"]), ("Stock split and media release", "corporate_action", ["corporate_action", "press_release"]), ("ICRA note", "credit_rating", ["credit_rating"]),
])
def test_classification(spark, text, kind, tags):
    k, t, _ = A.classified(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(k.alias("k"), t.alias("t")).first()
    assert (got.k, got.t) == (kind, tags)


def test_status_of_actions(spark):
    bars = spark.createDataFrame([("A", dt.date(2026, 1, 5) + dt.timedelta(i), o, c) for i, (o, c) in enumerate([(100.0, 100.0), (101.0, 100.0), (50.0, 51.0), (51.0, 52.0)])], "symbol string, date date, open double, close double")
    known = spark.createDataFrame([("A", dt.date(2026, 2, 1))], "symbol string, ex_date date")
    cases = [("buyback", None, "no_adjustment"), ("bonus", None, "undated"), ("bonus", dt.date(2026, 2, 3), "recorded"), ("bonus", dt.date(2026, 3, 9), "upcoming"), ("bonus", dt.date(2026, 1, 6), "adjusted"), ("split", dt.date(2026, 1, 7), "needs_review"), ("split", dt.date(2026, 1, 5), "needs_review"), ("split", dt.date(2026, 1, 20), "needs_review")]
    a = spark.createDataFrame([("A", k, d, False, i + 1) for i, (k, d, _) in enumerate(cases)], "symbol string, action_type string, ex_date date, assumed boolean, n_filings long")
    got = {r.n_filings: (r.status, r.note) for r in actions.with_status(a, known, bars, dt.date(2026, 2, 28)).collect()}
    assert [got[i + 1][0] for i in range(len(cases))] == [c[2] for c in cases] and "-50.0%" in got[6][1]


def test_undated_mentions_fold_into_dated_ones(spark):
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    rows = [(1, "A", at(0), "bonus", None), (2, "A", at(5), "bonus", dt.date(2026, 2, 1)), (3, "A", at(6), "bonus", dt.date(2026, 2, 1)), (4, "A", at(400), "split", None), (5, "A", at(0), "split", dt.date(2026, 2, 1))]
    f = spark.createDataFrame([(i, s, t, "x", k, f"{i}:1" if i == 3 else None, None, None, d, False) for i, s, t, k, d in rows], "id long, symbol string, filed_at timestamp, subject string, action_type string, ratio string, price_factor double, record_date date, ex_date date, assumed boolean")
    got = {(r.action_type, r.ex_date, r.ratio, r.filing_id, r.n_filings) for r in actions.gathered(f).collect()}
    assert got == {("bonus", dt.date(2026, 2, 1), "3:1", 1, 3), ("split", None, None, 4, 1), ("split", dt.date(2026, 2, 1), None, 5, 1)}


def test_posts(spark):
    html = '<p>Hello <a href="http://x" onclick="y">the  page</a></p><blockquote>quoted</blockquote><img src="z"><p class="k" id="3">more<br>lines</p>'
    one = spark.createDataFrame([(html,)], "h string").select(posts.sanitised(F.col("h")).alias("s"))
    assert one.first()[0] == '<p>Hello <a>the  page</a></p><blockquote>quoted</blockquote><p class="k">more<br>lines</p>'
    assert one.select(posts.own_text(F.col("s"))).first()[0] == "Hello ⟦the page⟧\nmore\nlines"
    text = "One two\nthree.\nfour ⟦x⟧ https://a.b/c\nMarkets fall sharply today - The Gazette my view"
    s = spark.createDataFrame([(text,)], "t string").select(posts.without_shared(("The Gazette",))(F.col("t")).alias("s")).select("s.*", posts.joined_lines(F.col("s.text")).alias("j")).first()
    assert s.text == "One two\nthree.\nfour\nmy view" and s.shared and s.j == "One two three.\nfour my view"
    key = spark.createDataFrame([(7,), (None,)], "u long").select(posts.author_key(b"k", "forum")(F.col("u"))).collect()
    assert len(key[0][0]) == 32 and key[1][0] is None
    assert spark.range(1).select(posts.first_sentences(F.lit("A one. B two! C three"), 2)).first()[0] == "A one. B two!"
