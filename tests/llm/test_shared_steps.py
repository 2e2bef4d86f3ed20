"""Sets that are made once, of many texts at a time, and components that are gone on with."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import ngram_join
from tessera.llm.components import components, joined


def test_shingles_of_many_texts_are_those_of_each():
    r = random.Random(3)
    texts = [None, "", " ", "a", " a b ", "A B c D", "\x0ba\tb\nc\rd e\x0cf ", "a b c d " * 4, "\x1fa\x1cb c d", "é É ß x y", *(" ".join(r.choices("abcXYZ", k=r.randrange(12))) for _ in range(200))]
    for n in (1, 4, 5):
        shingler, column = ngram_join.Shingler(n), pa.array(["x y z u v w", *texts], pa.string()).slice(1)
        hashes, begin = shingler.of_texts(column)
        assert all(np.array_equal(hashes[begin[i] : begin[i + 1]], shingler(t)) for i, t in enumerate(texts)) and begin[-1] == len(hashes)
        assert [len(x) for x in shingler.of_texts(pa.array([], pa.string()))] == [0, 1]


def test_sets_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda *a, of=ngram_join.shingle_sets, **k: made.append(a) or of(*a, **k))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text + " tail"), (2, "other words"), (4, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (58, 1), 3: (57, 1), 2: (1, 2), 4: (0, 4)} and len(made) == 1


def test_components_with_further_links(spark):
    r = random.Random(7)
    of = lambda links: spark.createDataFrame(links, "a long, b long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    old, new = [(r.randrange(60), r.randrange(60)) for _ in range(25)], [(r.randrange(80), r.randrange(80)) for _ in range(15)] + [(70, 70)]
    first = components(of(old))
    assert rows(joined(first, of(new))) == rows(components(of(old + new)))
    assert rows(joined(first, of([]))) == rows(first) and rows(joined(components(of([])), of(new))) == rows(components(of(new)))
