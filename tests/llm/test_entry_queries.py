"""Every query of the package on a folder with nulls, repeated rows and ids, clashing columns, empty and long texts, and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import PII, ROWS, SCHEMA, TEXTS, VOCABULARY, groups, plain_repeats, plain_spans, words
from tokenizers import Tokenizer

import __spark_entry__ as entry

CLASHES = ["size", "k", "slot", "rank", "piece", "length", "token", "component", "digest", "norm", "best", "kept", "_text", "_words", "key", "seed", "batch", "base", "spans", "lang_pred", "file", "ordinal", "tokens", "n"]
MORE = [(100 + i, t, "de", "b", 0, 1, 2) for i, t in enumerate(PII)]
ALL = ROWS + MORE
NAMES = [n for n in entry.queries() if n.startswith("op")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows in (("odd", ALL), ("empty", [])):
        at = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
        docs.write.parquet(f"{at}/documents.parquet")
        labels = [(r[0], int(r[0] % 3 != 0), int(r[0] % 4 == 0)) for r in rows if r[0] is not None] + [(None, 1, 1), (0, None, 1)] * bool(rows)
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("p_toxic", F.lit(1)).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string").withColumn("rank", F.lit(1)).write.parquet(f"{at}/benchmark.parquet")
        out[name] = str(at)
    return out


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_empty_tables(spark, folders, name):
    assert entry.queries()[name](spark, folders["empty"]).count() == 0


def rows_of(spark, folders, number):
    name = next(n for n in NAMES if n.startswith(f"op{number}_"))
    return entry.queries()[name](spark, folders["odd"]).collect()


def test_op1(spark, folders):
    got = rows_of(spark, folders, 1)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in ALL) and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=5)


def test_op2(spark, folders):
    t, want = Tokenizer.from_file(VOCABULARY), Counter()
    for r in ALL:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(r[0], k // 4096, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_of(spark, folders, 2)) == want


def test_op3(spark, folders):
    assert Counter(map(tuple, rows_of(spark, folders, 3))) == groups(ALL, 4, 85)


def test_op4(spark, folders):
    got = Counter((r.doc_id, r.base_sha256) for r in rows_of(spark, folders, 4))
    assert got == Counter((r[0], hashlib.sha256(plain_spans(r[1]).encode()).hexdigest()) for r in ALL)


def test_op5(spark, folders):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in rows_of(spark, folders, 5))
    assert got == Counter({(i, n, g, hashlib.sha256(k).hexdigest()): c for (i, n, g, k), c in plain_repeats(ALL, 200).items()})


def test_op6(spark, folders):
    got = rows_of(spark, folders, 6)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ALL) and all(isinstance(r.toxic, bool) for r in got)


def test_op7(spark, folders):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    of = defaultdict(list)
    for r in ALL:
        of[norm(r[1])].append((-len(r[1] or ""), float("inf") if r[0] is None else r[0], r[0]))
    want = Counter((r[0], min(of[norm(r[1])])[2], len(of[norm(r[1])])) for r in ALL)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows_of(spark, folders, 7)) == want


def test_op8(spark, folders):
    want = Counter()
    for r in ALL:
        w = words(r[1])
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
        want[(r[0], len(w), len(again), len(w) < 50 or 2 * len(again) > len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in rows_of(spark, folders, 8)) == want


def test_op9(spark, folders):
    got = rows_of(spark, folders, 9)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ALL) and all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got) and len(TEXTS) < len(got)


def test_op10(spark, folders):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    assert Counter(map(tuple, rows_of(spark, folders, 10))) == Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ALL)


def test_pipeline(spark, folders):
    """On odd tables: what is packed is whole, and of good documents only."""
    good = {r[0] for r in ALL if len(words(r[1])) >= 50}
    got = entry.queries()["pipeline"](spark, folders["odd"]).collect()
    assert got and {r.doc_id for r in got} <= good
    for used in [[r for r in got if r.sequence_id == k] for k in {r.sequence_id for r in got}]:
        at = sorted((r.offset, r.length) for r in used)
        assert [o for o, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))] and sum(n for _, n in at) <= 4096
    by_doc = Counter((r.doc_id, r.piece) for r in got)
    assert all(by_doc[(i, 0)] == n for (i, _), n in by_doc.items())


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(entry.oracle_sql())))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{entry.SMALL}/{table}.parquet'")
    got, want = entry.queries()[name](spark, entry.SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cells = lambda df: Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.reindex(sorted(df.columns), axis=1).astype(object).itertuples(index=False))
    assert cells(got) == cells(want)
