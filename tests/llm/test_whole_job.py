"""What the round's findings asked for: the pipeline against a plain one, and rows that ids do not tell apart."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from test_llm import VOCABULARY, groups, words
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, mixing, ngram_join, toxicity

NAMES = iter(range(10**6))

def new_words(n):
    """Words that no other text has."""
    r = random.Random(11)
    return ["".join(r.choice("abcdefgh") for _ in range(3)) + "".join("klmnopqrst"[int(c)] for c in str(next(NAMES))) for _ in range(n)]

def shifted(n, k, times=2):
    """Texts of n shingles of five words, each k words on: neighbours have (n - k) of n + k in common."""
    w = new_words(n + 4 + k * (times - 1))
    return [" ".join(w[i * k : i * k + n + 4]) for i in range(times)]

def plain_good(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) for j in range(3) if windows[tuple(w[i : i + 3])] > 1}
    chars, upper, symbols, copies = sum(map(len, w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    return not (len(w) < 50 or 2 * len(again) > len(w) or 10 * symbols > len(w) or chars < 2 * len(w) or chars > 20 * len(w) or 2 * upper > chars or (copies >= 3 and 10 * copies > 3 * len(lines)))

def plain_exact(rows):
    best = {}
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[norm] = min(best.get(norm, (0, math.inf, None)), (-len(r[1]), r[0], r))
    return [r for _, _, r in best.values()]

def plain_mix(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[3]].append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], len(words(r[1]))))
    size = {s: sum(x[2] for x in g) for s, g in of.items()}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(of, key=lambda s: (s is None, s)))}
    left, target, free = 1.5 * sum(size.values()), {}, set(of)
    while full := {s for s in free if 2 * size[s] < weight[s] * left / sum(weight[x] for x in free)}:
        target |= {s: 2 * size[s] for s in full}
        left, free = left - sum(2 * size[s] for s in full), free - full
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    times = Counter()
    for s, g in of.items():
        start, upto = 0, math.floor(target[s] + 0.5)
        for _, i, n in sorted(g):
            taken = sum(max(0, min(n, t - start)) for t in (upto, upto - size[s]))
            times[i] += math.floor(taken / n + 0.5)
            start += n
    return +times

def test_pipeline_against_a_plain_one(spark, tmp_path):
    import corpus_pipeline

    planted = {"0.79": shifted(179, 21), "0.80": shifted(90, 10), "0.82": shifted(91, 9), "0.85": shifted(185, 15), "chain": shifted(90, 10, 4)}
    texts = [t for p in planted.values() for t in p] + [" ".join(new_words(60 + i)) for i in range(12)]
    texts += [texts[0].replace(" ", "\n"), texts[-1] + "  ", "short", "a b c " * 40, texts[5].upper(), None]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    exact = plain_exact([r for r in rows if plain_good(r[1])])
    kept = {i for i, _, of in groups(exact, 5, 80) if i == of}
    assert [len(kept & {i for i in range(at, at + n)}) for at, n in [(2, 2), (4, 2), (6, 2), (8, 4)]] == [1, 1, 1, 1] and 1 in kept
    t = Tokenizer.from_file(VOCABULARY)
    want = Counter({(i, 0, 0, len(t.encode(texts[i], add_special_tokens=False).ids) + 1): n for i, n in plain_mix([r for r in exact if r[0] in kept]).items()})
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want

def test_copies_that_ids_do_not_tell_apart(spark):
    a, b, c, d = (" ".join(new_words(60)) for _ in range(4))
    rows = [(5, a, 0), (5, a, 0), (5, b, 0), (4, b, 1), (7, c, 2), (7, c + "  ", 3), (8, c, 4), (None, d, 5), (None, d, 5), (None, a, 6), (None, None, 7), (None, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int").repartition(3)
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter([(5, a), (4, b), (7, c + "  "), (None, d), (None, "")])
    near = [(2, a + " tail"), (2, c), (None, a), (None, b), (None, b + " tail"), (3, b + " other"), (None, d), (None, d + " tail"), (1, None), (1, "")]
    got = ngram_join.keep_one(spark.createDataFrame(near, "doc_id long, text string").repartition(2), words=5, percent=80)
    assert Counter((r.doc_id, (r.text or "")[:100]) for r in got.collect() if r.text and not r.text.startswith(d)) == Counter([(2, (a + " tail")[:100]), (2, c[:100]), (3, (b + " other")[:100])])
    assert got.count() == 6

def test_mix_in_the_order_of_its_slots(spark):
    rows = [(i, " ".join(["w"] * (40 + 7 * i % 90)), "abc"[i % 3 if i > 20 else 0]) for i in range(60)] + [(5, " ".join(["w"] * 333), "a"), (None, "w " * 100, "b"), (None, "w " * 300, "b")]
    got = [(r.doc_id, len(words(r.text))) for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    of = defaultdict(list)
    for i, t, s in rows:
        of[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, len(words(t)), i))
    targets = [r.asDict() for r in mixing.source_targets(spark.createDataFrame([(s, x[2]) for s, g in of.items() for x in g], "source string, size long")).orderBy("k").collect()]
    blocks = sum(-(-t["words"] // 256) for t in targets)
    n_slots, want = blocks + blocks // 64 + 256, []
    for t in targets:
        mine = [slot for slot in range(n_slots) if t["low"] <= slot * mixing.GOLDEN % 2**32 < t["high"]]
        assert len(mine) >= -(-t["words"] // 256)  # no block of the fixture is late
        upto, start = math.floor(t["target"] + 0.5), 0
        for _, _, n, i in sorted(of[t["source"]]):
            taken = [max(0, min(n, upto - e * t["source_size"] - start)) for e in (0, 1)]
            for e in range(math.floor(sum(taken) / n + 0.5)):
                block = (start + e * t["source_size"]) // 256
                want.append((mine[block], start, (i, n)))
            start += n
    assert [x for _, _, x in sorted(want)] == got and len({x[0] for x in want}) > 10

def test_toxicity_learns_each_category_from_its_own_labels(spark):
    r = random.Random(5)
    rows = [(i, " ".join(new_words(20)) + (" " + " ".join(r.sample(["vile", "awful", "nasty", "hateful"], 3)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    for quality in (lambda i: 1, lambda i: None, lambda i: None if i % 4 == 0 else i % 2):
        labels = spark.createDataFrame([(i, quality(i), x) for i, _, x in rows[:120]], "doc_id long, quality int, toxic int")
        got = toxicity.toxic_documents(docs, labels).collect()
        assert sum(g.toxic == bool(rows[g.doc_id][2]) for g in got) >= 195 and all(g.p_toxic is not None for g in got)
        assert all((g.p_low_quality is None) == (quality(1) == quality(2)) for g in got)
    # A table of labels that mostly names other documents leaves the sample whole.
    many = labels.select("doc_id", "quality", "toxic").union(spark.range(1000, 13_000).selectExpr("id", "1", "0"))
    assert sum(g.toxic for g in toxicity.toxic_documents(docs, many, sample=120).collect()) >= 45
