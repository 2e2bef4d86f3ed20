"""The ten operators and the pipeline on small tables with nulls, empty and long texts, ties and repeated
rows, held against plain versions."""

import hashlib
import random
import re
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, language_id, mixing, ngram_join, packing, personal_data, quality_rules, repeats, token_counts, toxicity
from tessera.llm.common import materialise
from tessera.llm.components import components
from tessera.llm.tokens import WordEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, start int"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(260)
LONG = prose(30_000)
TEXTS = [None, "", "   ", "one", "Two words", BASE, BASE, BASE.replace(" ", "\n"), BASE + " more words", BASE.upper(), prose(120), "x" * 3000, LONG, LONG[:9000] + prose(40), "äöü € 𝄞 " + prose(60)] + [BASE.replace(WORDS[i], "changed", 1) for i in range(6)] + [prose(80) for _ in range(8)]
ROWS = [(i, t, "en", [None, "a", "b", "ü"][i % 4], None, 1, 2) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", "a", 0, 1, 2), (None, prose(60), None, "b", 0, 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS) and sorted(got["size"]) == sorted(len(words(r[1])) for r in ROWS)
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1 and (g["taken"] <= 2 * g["size"]).all()
    assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("doc_id < 3")).agg({"taken": "sum"}).first()[0] == 0


def test_packing(docs, empty):
    t = Tokenizer.from_file(VOCABULARY)
    want, rows = Counter(), [*ROWS, (70, "hello <|endoftext|> and <|startoftext|> World, a<|endoftext|>b <|ENDOFTEXT|> it's", "en", "a", 0, 1, 2)]
    docs = docs.union(docs.sparkSession.createDataFrame(rows[-1:], SCHEMA))
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[(r[0], k // 4096, k, array("I", ids[k : k + 4096]).tobytes())] += 1
    got = packing.pack(packing.token_pieces(docs, VOCABULARY)).toPandas()
    assert Counter((None if d != d else d, p, s, i) for d, p, s, i in zip(got["doc_id"].astype(object), got["piece"], got["start"], map(bytes, got["ids"]))) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096
    assert packing.pack(packing.token_pieces(empty, VOCABULARY)).count() == 0
    clash = packing.token_pieces(docs, VOCABULARY, with_ids=False).selectExpr("*", "1 AS _part", "2 AS _rank", "'x' AS offset", "4 AS _row")
    out = packing.pack(clash)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank", "_row", "sequence_id", "offset"]
    assert Counter((r.start, r.ids_crc32, r._part, r._rank, r._row) for r in out.collect()) == Counter((s, zlib.crc32(i), 1, 2, 4) for (_, _, s, i), n in want.items() for _ in range(n))


@pytest.mark.parametrize("special", [False, True])
def test_encoder_is_the_plain_tokenizer(special):
    t, r = Tokenizer.from_file(VOCABULARY), random.Random(2)
    t.encode_special_tokens = special
    texts = ["".join(r.choice("aB.,'s<|> \n!İé\u0301ßΣ1中_-") for _ in range(r.randint(0, 60))) for _ in range(500)] + TEXTS + ["<|endoftext|> A<|startoftext|>.b", "It's, I'LL. 'tis x.y"]
    encoder = WordEncoder(VOCABULARY, special, words=100)
    for at in range(0, len(texts), 100):
        ids, begin = encoder.encode(pa.array(texts[at : at + 100], pa.string()))
        for k, x in enumerate(texts[at : at + 100]):
            assert ids[begin[k] : begin[k + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    for seed in range(5):
        r = random.Random(seed)
        counts = Counter(r.choice([r.randint(1, 4096), r.randint(1, 300), 4096, 7]) for _ in range(2000))
        plan, used = packing.plan(dict(counts)), Counter()
        for n, lengths in plan:
            assert sum(x * k for x, k in lengths.items()) <= 4096
            for x, k in lengths.items():
                used[x] += n * k
        assert used == counts
        assert sum(n for n, _ in plan) <= 1.03 * sum(x * k for x, k in counts.items()) / 4096 + 2


def groups(rows, n, percent):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for k, r in enumerate(rows):
        w = words((r[1] or "").translate(low))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k in sets:
        ids[find(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in ids[find(k)] if i is not None), default=None)) for k in sets)


def test_ngram_join(docs, empty):
    got = Counter(map(tuple, ngram_join.similar_groups(docs).collect()))
    assert got == groups(ROWS, 4, 85)
    assert Counter(map(tuple, ngram_join.similar_groups(docs, long=3).collect())) == got
    assert ngram_join.similar_groups(empty).count() == 0


def test_all_links(spark, docs):
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(400)]
    texts = list(TEXTS)
    for _ in range(40):  # a group of near copies, some linked with the pivot only
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = [words((t or "").translate(low)) for t in texts]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []) for w in split]
    of = {}
    for i, x in enumerate(sets):
        of.setdefault(x, i)
    want = {(max(of[x], of[y]), min(of[x], of[y])) for x in of for y in of if x != y and x and y and 100 * len(x & y) >= 85 * len(x | y)}
    for long in (1000, 7):
        found, members = ngram_join.all_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), long=long)
        assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 150
    assert Counter(map(tuple, members.collect())) == Counter((of[x], i, len(x)) for i, x in enumerate(sets) if x)


def test_a_common_shingle_is_dealt_out(spark):
    """A passage in every text: its lists are long, and no part of one has more than so many rows."""
    r, passage = random.Random(4), prose(12)
    texts = [" ".join([passage, *["".join(r.choice("klmno") for _ in range(8)) for _ in range(6)]]) for _ in range(120)]
    rows = [(i, t, "en", "a", 0, 1, 2) for i, t in enumerate(texts)]
    got = Counter(map(tuple, ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA), long=10).collect()))
    assert got == groups(rows, 4, 85)
    lists = spark.createDataFrame([(i, 120) for i in range(120)], "id long, rows long")
    parts = Counter(x.p for x in lists.select(ngram_join._part("id", 10).alias("p")).collect())
    assert set(parts) <= set(range(12)) and max(parts.values()) <= 25 and lists.select(F.size(ngram_join._parts(10))).first()[0] == 12


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50}


PII = ["a.b+c@x-y.example.com", "mail@x", "a@b.c_d@e.f", "1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824.", "+1 2", "𝄞 x@y.zz +44 20 7946 0958", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', None, "", "a" * 20000, "a@b" + ".c" * 9000, "1 " * 5000]


def plain_spans(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    luhn = lambda x: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(x[::-1])) % 10 == 0
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, k == 2 and 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, empty):
    rows = [(i, t) for i, t in enumerate(PII)]
    got = {r.doc_id: r for r in personal_data.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(plain_spans(t).encode()).hexdigest(), t
        assert set(filter(None, plain_spans(t).split(","))) <= set(got[i].spans.split(","))
    assert "secret:9:49" in got[9].spans
    many = [(1, "1.2.3.4 " * 32_000, "x"), (1, "1.2.3.4 " * 32_000, "x"), (2, "a@b.cc +1 743 555 3824 token=04dbebab91ab85687d33eeaaf9ac699e1188f962 " * 3000, "y")]
    clash = spark.createDataFrame(many, "doc_id long, text string, base string").withColumns({c: F.lit(1) for c in ("candidates", "runs", "spans")})
    began = time.perf_counter()
    out = personal_data.summary(clash).collect()
    assert time.perf_counter() - began < 60
    assert Counter((r.doc_id, r.n_ip, r.n_email, r.n_phone, r.base_sha256) for r in out) == Counter((i, *(len(re.findall(k, plain_spans(t))) for k in ("ip:", "email:", "phone:")), hashlib.sha256(plain_spans(t).encode()).hexdigest()) for i, t, _ in many)
    assert personal_data.summary(empty).count() == 0


def plain_repeats(rows, length):
    seen = Counter()
    raw = [(r[1] or "").encode() for r in rows]
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((r[0], len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize(("batches", "many"), [(2, 5000), (7, 1)])
def test_repeats(spark, docs, empty, batches, many):
    rows = ROWS
    clash = docs.withColumns({c: F.lit("x") for c in ("seed", "batch", "place", "context", "fp", "key", "packed")})
    got = repeats.without_repeats(clash, batches=batches, many=many).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s["to"] - s["from"] for s in r.spans), bytes(r.kept)) for r in got) == plain_repeats(rows, 200)
    if batches == 2:
        assert repeats.without_repeats(empty).count() == 0


def test_suffix_arrays_are_sorted_and_merge(spark, docs):
    family = repeats.SuffixFamily(spark)
    for b in range(7):
        family.add(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == b))
        for _, path in family.levels:
            files = family._level(path).select("seed", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
            of = defaultdict(list)
            for r in files:
                of[r.f].append(bytes(r.seed))
            assert all(x == sorted(x) for x in of.values())
    assert [n for n, _ in family.levels] == [4, 2, 1] and family.merges == 4


def test_toxicity(spark, empty):
    bad = ["vile", "awful", "nasty", "hateful"]
    rows = [(i, prose(60) + (" " + " ".join(R.sample(bad, 3)) if i % 5 == 0 else ""), int(i % 7 != 0), int(i % 5 == 0)) for i in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:200]] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxic_documents(d, labels).collect()}
    assert len(got) == 302 and sum(got[r[0]] == bool(r[3]) for r in rows[200:]) >= 95 and not got[900]
    assert not any(r.toxic for r in toxicity.toxic_documents(d, labels.limit(0)).collect())
    assert toxicity.toxic_documents(empty, labels).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda norm: norm.substr(1, 1)])
def test_exact_dedup(docs, empty, digest):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    of = defaultdict(list)
    for r in ROWS:
        of[norm(r[1])].append((-len(r[1] or ""), float("inf") if r[0] is None else r[0], r[0]))
    want = Counter((r[0], min(of[norm(r[1])])[2], len(of[norm(r[1])]), r[0] == min(of[norm(r[1])])[2], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in ROWS)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs, digest).collect())) == want
    assert exact_dedup.exact_groups(empty, digest).count() == 0


def test_exact_dedup_keeps_columns(docs):
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns and got.where("doc_id = 6").count() == 0 and got.where("doc_id is null").count() == 1


def test_quality_rules(docs, empty):
    got = {r._row.doc_id: r for r in quality_rules.judged(docs).collect()}
    for r in ROWS:
        w = words(r[1])
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(again))
        assert g.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (g.kept and g.base_failed)
    assert quality_rules.judged(empty).count() == 0 and quality_rules.keep_good(docs).columns == docs.columns


def test_language_id(spark, empty):
    en, fr = "the and of with this that from here there people".split(), "le les des avec pour dans une sont cette gens".split()
    rows = [(i, " ".join(R.choice(en if i % 2 else fr) for _ in range(20)), "en" if i % 2 else "fr") for i in range(120)] + [(200, None, "en"), (201, "123 !", None), (202, "", "fr")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:120]) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202))
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert language_id.identify(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def segmentations(word, known):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if k == 1 or word[:k] in known:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], known))


def test_forward_sums_and_counts_all_segmentations():
    known = ["▁", "a", "b", "ab", "▁a", "aba", "ba"]
    pieces, r = language_id.Pieces.of(known), np.random.default_rng(1)
    at = {p: int(np.searchsorted(pieces.hashes, language_id._prefixes(language_id._codes([p]))[0, -1])) for p in known}
    table = r.random((len(known) + 2, 2))
    table[-2], table[-1] = 0, 1e-3
    all_words, language, times = ["▁ababa", "▁abxab", "▁ba", "▁x"], np.array([0, 1, 1, 0]), np.array([1.0, 2, 3, 4])
    want = np.zeros_like(table)
    for w, of, n in zip(all_words, language, times):
        each = [([at.get(p, len(known) + 1) for p in s]) for s in segmentations(w, known)]
        p = [np.prod(table[ids, of]) for ids in each]
        assert np.isclose(language_id.likelihoods(pieces, table, [w])[0, of], np.log(sum(p)))
        for ids, q in zip(each, p):
            for i in ids:
                want[i, of] += n * q / sum(p)
    assert np.allclose(language_id.expected_counts(pieces, table, all_words, language, times), want)


def test_no_word_is_too_long(spark):
    rows = [(i, " ".join(R.choice("the and of with this".split() if i % 2 else "le les des avec pour".split()) for _ in range(20)), "en" if i % 2 else "fr", "x") for i in range(60)]
    odd = ["the " + "\u13a0" * 38 + " of with", "les " + "\ua66e" * 4000 + " avec", "a" * 100_000 + " the of with and", "\u13a0" * 500 + " " + "\ua66e" * 500]
    # A language that is far rarer than the others in a corpus of more than the sample.
    rows += [(100 + i, "ein der die und mit von", "de", "x") for i in range(3)]
    docs = spark.createDataFrame(rows + [(900 + i, t, None, "x") for i, t in enumerate(odd)] + rows[:2], "doc_id long, text string, lang string, lang_pred string")
    got = language_id.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), sample=20).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.lang_pred for r in got}
    assert [of[900], of[901], of[101]] == ["en", "fr", "de"] and {of[902], of[903]} <= {"en", "fr", "de"}


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    want = Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    for block in (7, 1 << 16):
        assert Counter(map(tuple, token_counts.document_tokens(docs, VOCABULARY, block=block).collect())) == want
    assert token_counts.document_tokens(empty, VOCABULARY).count() == 0


def test_flat_files(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 9, 8], "<u2").tofile(tmp_path / "a.bin")
    for whole in (1 << 20, 8, 4):  # by Spark, and in ranges
        got = token_counts.count_tokens(token_counts.file_blocks(spark, str(tmp_path), block=2, whole=whole), end=9)
        assert [(r.ordinal, r.n_tokens) for r in got.orderBy("ordinal").collect()] == [(0, 2), (1, 0), (2, 1), (3, 1)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(60 + i) if i % 6 else BASE + " " * i, "en", "ab"[i % 2], 1) for i in range(30)] + [(40, BASE + " tail", "en", "a", 1), (41, "short", "en", "a", 1), (42, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = materialise(corpus_pipeline.quality(spark, docs, ""), "stage")
    assert {r.doc_id for r in good.collect()} == {r[0] for r in rows} - {41, 42}
    exact = materialise(corpus_pipeline.exact_copies(spark, good, ""), "stage")
    assert {r.doc_id for r in exact.collect()} == {r[0] for r in rows if r[0] % 6 or r[0] == 24} - {41, 42} | {40}
    near = materialise(corpus_pipeline.near_copies(spark, exact, ""), "stage")
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in exact.collect()} - {40}
    mixed = materialise(corpus_pipeline.source_mix(spark, near, ""), "stage")
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, 0) for r in mixed.collect())
