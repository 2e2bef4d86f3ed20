"""The trained scorer: held-out labels, probabilities and calibration against plain sums, saved models, odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sentiment as M
from tessera.operators.scoring import LABELS, scored

TOLD = {"positive": ["gains", "record", "beats"], "negative": ["fraud", "loss", "probe"], "neutral": ["notice", "meeting", "filing"]}
SCHEMA = "id long, text string, label string"


def rows(n=900, seed=3):
    """Rare negative ones; a tenth of the labels is wrong."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choices(LABELS, (6, 1, 3))[0]
        text = " ".join([r.choice(TOLD[kind]).upper() if r.random() < 0.3 else r.choice(TOLD[kind])] + [f"w{chr(97 + r.randrange(26))}" for _ in range(r.randrange(1, 30))])
        out.append((i, text, r.choice(LABELS) if r.random() < 0.1 else kind))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    table = spark.createDataFrame([*rows(), (None, None, None), (-1, "gains", "unheard of"), (-2, None, "neutral"), (-3, "", None)], SCHEMA).repartition(4, "id").cache()
    return table, M.fit(table, "text", "label", "id")


def test_held_out_labels(spark, fitted):
    table, scorer = fitted
    got = {r.label: r for r in M.held_out(table, "text", "label", "id", scorer).collect()}
    mine = [r for r in rows() if zlib.crc32(str(r[0]).encode()) % M.FOLDS == 0]
    of = {r.id: r.label for r in scored(table.select("id", "text"), "text", scorer).collect()}
    for kind in LABELS:
        assert got[kind].n == sum(r[2] == kind for r in mine) + (kind == "neutral" and zlib.crc32(b"-2") % M.FOLDS == 0)
        assert got[kind].found == sum(r[2] == kind == of[r[0]] for r in mine) + (kind == "neutral" == of[-2] and zlib.crc32(b"-2") % M.FOLDS == 0)
    assert sum(g.found for g in got.values()) >= 0.85 * len(mine)
    assert got["positive"].calibration_error < 0.1


def test_probabilities_and_temperature(fitted):
    table, scorer = fitted
    w, b = scorer.model.coefficientMatrix.toArray(), scorer.model.interceptVector.toArray()
    probabilities = scored(table.where("label in ('positive', 'negative', 'neutral')").select("id", "text"), "text", scorer).collect()
    places = {r.id: r._features.indices for r in M._features(table.where("id is not null"), "text").collect()}
    margin = lambda i: w[:, places[i]].sum(axis=1) + b

    def softmax(m, t):
        e = np.exp((m - m.max()) / t)
        return e / e.sum()

    for r in probabilities[:200]:
        p = softmax(margin(r.id), scorer.temperature)
        assert np.allclose([r.p_positive, r.p_negative, r.p_neutral], p) and math.isclose(r.score, p[0] - p[1], abs_tol=1e-9) and r.model_version == scorer.version
    truth = {r.id: r.label for r in table.where("label is not null and id is not null").collect()}
    calibrating = [(margin(i), LABELS.index(k)) for i, k in truth.items() if k in LABELS and zlib.crc32(str(i).encode()) % M.FOLDS == 1]
    loss = [sum(-math.log(max(softmax(m, t)[k], M.LEAST)) for m, k in calibrating) for t in M.TEMPERATURES]
    assert scorer.temperature == M.TEMPERATURES[int(np.argmin(loss))]


def test_words(spark):
    texts = ["Ä b B\nb_c", "don't 12x", "", None, "x" * 100_000 + " y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.words(F.col("t")).alias("w")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert r.w == list(dict.fromkeys(re.findall(r"[^\W\d_]+", (t or "").lower())))


def test_a_saved_model_is_the_same_or_refused(spark, fitted, tmp_path):
    table, scorer = fitted
    version = scorer.save(f"{tmp_path}/m")
    back = M.load(spark, f"{tmp_path}/m", version)
    few = table.where("id < 50").select("id", "text")
    assert sorted(map(str, scored(few, "text", back).collect())) == sorted(map(str, scored(few, "text", scorer).collect()))
    with pytest.raises(ValueError, match="version"):
        M.load(spark, f"{tmp_path}/m", "0" * 16)


def test_no_rows_and_one_label(spark):
    with pytest.raises(ValueError, match="no labelled rows"):
        M.fit(spark.createDataFrame([], SCHEMA), "text", "label", "id")
    alone = M.fit(spark.createDataFrame([(i, "fraud", "negative") for i in range(40)], SCHEMA), "text", "label", "id")
    r = {x.id: x for x in scored(spark.createDataFrame([(1, "fraud"), (2, None)], "id long, text string"), "text", alone).collect()}
    assert r[1].label == "negative" and all(math.isclose(x.p_positive + x.p_negative + x.p_neutral, 1) for x in r.values())
