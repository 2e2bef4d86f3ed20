"""The classifier chain against plain versions of its parts, and rows that are easily lost."""

import math
import random
from collections import Counter

import numpy as np
import regex
from test_llm import prose

from tessera.llm import toxicity

BAD = ["vile", "awful", "nasty", "hateful"]


def features(text):
    return {f for w in set(regex.findall(r"\p{L}+", (text or "").lower())) for f in [w, *[f"{w[:n]}-" for n in toxicity.STEMS if len(w) > n]]}


def test_logistic_is_at_its_optimum():
    r = np.random.default_rng(4)
    x = (r.random((400, 30)) < 0.2).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + 0.3 * r.standard_normal(400) > 0.5).astype(np.float32)
    w = toxicity._logistic(x, y, rounds=4000).astype(float)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = np.append(x.T @ (p - y), (p - y).sum()) / len(y) + 1e-4 * w
    inner, zero = slope[:-1], w[:-1] == 0
    assert abs(slope[-1]) < 1e-4 and zero.any() and (abs(inner[zero]) <= 2e-4 + 1e-5).all()
    assert (abs(inner[~zero] + 2e-4 * np.sign(w[:-1][~zero])) < 1e-4).all()


def test_later_models_see_out_of_fold_odds():
    r = np.random.default_rng(5)
    x, fold = (r.random((300, 20)) < 0.3).astype(np.float32), r.integers(0, 3, 300)
    first = (x[:, 0] > 0).astype(np.float32)
    second = np.where(r.random(300) < 0.1, np.nan, first * x[:, 1]).astype(np.float32)
    got = toxicity.chain_weights(x, fold, [first, second])
    odds = np.zeros(300, np.float32)
    for i in range(300):
        other = fold != fold[i]
        w = toxicity._logistic(x[other], first[other]) if i == 0 or fold[i] not in fold[:i] else models[fold[i]]
        models = {**(models if i else {}), fold[i]: w}
        odds[i] = np.clip(float(x[i] @ w[:-1] + w[-1]), -8, 8)
    known = ~np.isnan(second)
    assert np.allclose(got[0], toxicity._logistic(x, first))
    assert np.allclose(got[1], toxicity._logistic(np.hstack([x, odds[:, None]])[known], second[known]), atol=1e-3)


def test_chosen_features_and_scores(spark):
    r = random.Random(6)
    rows = [(i, prose(30) + (" " + " ".join(r.sample(BAD, 2)) if i % 3 == 0 else ""), int(i % 4 != 0), int(i % 3 == 0)) for i in range(150)]
    labelled = spark.createDataFrame([(i, t, 1 - q, x) for i, t, q, x in rows], "doc_id long, text string, low_quality int, toxic int")
    chain = toxicity.fit(labelled, ["low_quality", "toxic"], features=20)
    score, n = {}, len(rows)
    for k, of in enumerate(([1 - q for _, _, q, _ in rows], [x for *_, x in rows])):
        have = Counter(f for _, t, *_ in rows for f in features(t))
        yes = Counter(f for (_, t, *_), y in zip(rows, of) if y for f in features(t))
        base = sum(of) / n
        g = {f: (yes[f] + 0.5) * math.log((yes[f] + 0.5) / (m * base + 0.5)) + (m - yes[f] + 0.5) * math.log((m - yes[f] + 0.5) / (m * (1 - base) + 0.5)) for f, m in have.items() if m >= toxicity.LEAST_ROWS}
        score[k] = sorted(g, key=lambda f: (-round(g[f], 9), f))[:20]
    assert set(score[1][:4]) <= set(chain.features) and set(score[0][:4]) <= set(chain.features) and len(chain.features) <= 40
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    for got in toxicity.predict(chain, docs).collect():
        text = dict((x[0], x[1]) for x in rows).get(got.doc_id)
        at, before = [chain.features[f] for f in features(text) if f in chain.features], []
        for c, w in zip(("p_low_quality", "p_toxic"), chain.weights):
            odds = max(-8, min(8, sum(w[i] for i in at) + sum(a * b for a, b in zip(w[len(chain.features) : -1], before)) + w[-1]))
            before.append(odds)
            assert abs(got[c] - 1 / (1 + math.exp(-odds))) < 1e-5


def test_repeated_rows_labels_and_clashing_columns(spark):
    r = random.Random(7)
    rows = [(i, prose(40) + (" " + " ".join(r.sample(BAD, 3)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(160)]
    rows[120] = (120, prose(50_000) + " vile awful nasty", 1)
    docs = spark.createDataFrame([(i, t, "x", 9, 9) for i, t, _ in rows + rows[:10]] + [(None, "vile awful nasty hateful", "x", 9, 9)], "doc_id long, text string, toxic string, p_toxic int, features int")
    labels = spark.createDataFrame([(i, i % 2, x) for i, _, x in rows[:100]] + [(0, None, 0), (0, 1, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter((g.doc_id, g.toxic) for g in toxicity.toxic_documents(docs, labels).collect())
    assert sum(got.values()) == 171 and all(n == 1 + (i is not None and i < 10) for (i, _), n in got.items())
    assert sum((i, bool(x)) in got for i, _, x in rows[100:]) >= 57 and (None, True) in got
