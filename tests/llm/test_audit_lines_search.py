"""Filter audit, line dedup and ranked search against plain versions, on odd tables too."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ROWS, SCHEMA, words

from tessera.llm import filter_audit, line_dedup, ranked_search

R = random.Random(12)
LINES = [" ".join(R.choice(["aa", "Bb", "c", "ü", "0"]) for _ in range(R.randint(1, 4))) for _ in range(40)]
MANY = ["\n".join(R.choice([x, " " + x + "\t", x.upper(), "", "  "]) for x in R.choices(LINES, k=R.randint(1, 9))) for _ in range(60)] + ["a\nb\n", "\n\n", " ", "# 100% $"] * 2
ODD = ROWS + [(200 + i, t, "en", ["a", "", "b"][i % 3], 0, 1, 2) for i, t in enumerate(MANY)] + [(200, MANY[0], "en", "c", 0, 1, 2)]
LABELS = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 260, 2)] + [(5, None, 1), (None, 1, 1), (200, 1, None), (200, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(7) for c in ("part", "mask", "n", "good", "line", "hi", "lo", "term", "score", "rank", "_text", "_words", "values", "bit", "first")}).repartition(3)


def plain_masks():
    first = {}
    for r in ODD:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, t in LABELS if t == 1 and i is not None}
    for r in ODD:
        t, w = r[1] or "", words(r[1])
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), r[0] is not None and first[t] < r[0])
        yield r[3] or "", {x for x, f in zip("ABCDE", fails) if f}, r[0] in good, r[0] in toxic


def test_filter_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    want = Counter()
    of = defaultdict(list)
    for part, fails, good, toxic in plain_masks():
        of[part].append((fails, good, toxic))
    for part, rows in of.items():
        shapley = {x: sum(Fraction(120, len(f)) for f, _, _ in rows if x in f) for x in "ABCDE"}
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                left = [r for r in rows if not r[0] & set(order[:k])]
                here = [r for r in left if x in r[0]]
                want[(part, "".join(order), k + 1, len(left) - len(here), len(here), sum(x in r[0] for r in rows) - len(here), sum(r[0] == {x} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), int(shapley[x]))] += 1
    out = filter_audit.audit(docs, labels)
    assert Counter(map(tuple, out.collect())) == want
    assert [t for _, t in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    empty = docs.limit(0)
    assert filter_audit.audit(empty, labels).count() == 0
    none = filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert none[:2] == (0, 0) and none[2] > 0


def test_orders_add_up_to_shapley(spark, docs):
    """What the orders remove sums to what the polynomial's integral gives, for other filters too."""
    filters = {"X": lambda: F.col("_words") < 3, "Y": lambda: F.length("_text") % 2 == 0}
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters).collect()
    assert {r.filter_order for r in rows} == {"".join(p) for p in permutations("XYE")}
    sums = Counter()
    for r in rows:
        sums[(r.part, r.filter_order[r.step - 1])] += r.removed
    assert all(sums[(r.part, r.filter_order[r.step - 1])] == r.shapley for r in rows)


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def plain_lines(inserted, asked, least):
    held = Counter(k for _, t in inserted for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for i, t in asked:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"fingerprint_bits": 3, "shard_keys": 4}, {"fingerprint_bits": 4, "shard_keys": 5, "filter_bytes": 0, "part_lines": 20}])
def test_line_dedup(spark, docs, options):
    index = line_dedup.LineIndex(spark, least=4, **options)
    got = lambda asked: Counter(map(tuple, index.deduplicated(asked).collect()))
    a, b = docs.where("coalesce(doc_id, 1) % 2 = 0"), docs.where("coalesce(doc_id, 1) % 2 <> 0")
    assert got(docs) == plain_lines([], pairs(docs), 4)
    index.insert(a)
    assert got(docs) == plain_lines(pairs(a), pairs(docs), 4)
    before = (sorted(map(tuple, index.counts().collect())), index.frequent)
    index.insert(b)
    assert got(docs) == plain_lines(pairs(docs), pairs(docs), 4) and index.frequent > before[1]
    index.delete(b)
    assert (sorted(map(tuple, index.counts().collect())), index.frequent) == before
    assert got(docs) == plain_lines(pairs(a), pairs(docs), 4)
    with pytest.raises(ValueError, match="not inserted"):
        index.delete(docs.where("doc_id = 7"))
    assert sorted(map(tuple, index.counts().collect())) == before[0]
    index.delete(a)
    assert index.counts().count() == 0 and index.frequent == 0
    assert got(docs) == plain_lines([], pairs(docs), 4) and index.deduplicated(docs.limit(0)).count() == 0
    index.drop()


def test_line_counts_are_added_up(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "TABLES", 2)
    index = line_dedup.LineIndex(spark, least=3)
    parts = [docs.where(f"pmod(coalesce(doc_id, 1), 5) = {k}") for k in range(5)]
    for p in parts:
        index.insert(p)
    assert len(index.tables) <= 2
    assert Counter(map(tuple, index.deduplicated(docs).collect())) == plain_lines(pairs(docs), pairs(docs), 3)


def test_line_summary(docs):
    want = Counter((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for (i, n, d, k), c in plain_lines(pairs(docs), pairs(docs), 10).items() for _ in range(c))
    assert Counter(map(tuple, line_dedup.summary(docs).collect())) == want and any(d for _, _, d, _ in want)
    assert line_dedup.summary(docs.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**63, (2, 3000)).astype(np.uint64)
    of = line_dedup.CuckooFilter(line_dedup.CuckooFilter.buckets_for(3000))
    assert of.insert(hi, lo) and of.contains(hi, lo).all()
    of.delete(hi[:1000], lo[:1000])
    assert of.contains(hi[1000:], lo[1000:]).all() and of.contains(hi[:1000], lo[:1000]).sum() < 5
    of.delete(hi[1000:], lo[1000:])
    assert not of.slots.any()
    assert not line_dedup.CuckooFilter(2).insert(hi[:50], lo[:50])


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_search(rows, items, top):
    held = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = set()
    for item, of in asked.items():
        scored = []
        for i, c in held:
            m = 50 + (50 * c.total() * n_docs) // length
            s = sum(ranked_search.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in of if c[t])
            scored += [(-s, i is None, i, s)] if s else []
        out |= {(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scored)[:top])}
    return out


ITEMS = [(1, "aa bb"), (2, "C, ü; 0!"), (2, "aa"), (3, None), (None, "aa c"), (4, "... "), (5, "nowhere"), (6, " ".join(sorted({w for r in ODD[5:12] for w in words(r[1])})[:60])), (7, "aa aa AA")]


@pytest.mark.parametrize("top, block, shard", [(50, 4_000_000, 16_384), (5, 40, 9), (3, 4_000_000, 1)])
def test_ranked_search(spark, docs, top, block, shard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    index = ranked_search.build_index(docs, shard_docs=shard)
    got = ranked_search.search(index, items, top, block).collect()
    assert {tuple(r) for r in got} == plain_search(pairs(docs), ITEMS, top) and len(got) == len({tuple(r) for r in got})
    assert max(r["n"] for r in index.where("term is null").select(F.size("ids").alias("n")).collect()) <= shard


def test_ranked_search_of_nothing(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs.where("text is null"), items).count() == 0


def test_wand_skips_and_loses_nothing():
    rng = np.random.default_rng(4)
    n, skipped = 20_000, 0
    for _ in range(20):
        lists = []
        for share, worth in ((0.7, 20), (0.3, 90), (0.02, 900), (0.005, 1500)):
            at = np.flatnonzero(rng.random(n) < share)
            lists.append((at, rng.integers(0, worth, len(at))))
        total = np.zeros(n, np.int64)
        for at, impacts in lists:
            total[at] += impacts
        order = np.lexsort((np.arange(n), -total))[:50]
        best, scores, scored = ranked_search.wand(lists, n)
        assert best.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
        skipped += n - scored
    assert skipped > 20 * 0.8 * n
