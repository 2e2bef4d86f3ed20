"""What story groups send through the driver."""

import random

from pyspark.sql import functions as F

from tessera.functions.similarity import WIDTH, possible_pairs, set_ratio, sorted_ratio
from tessera.operators import components as components_module
from tessera.operators import stories
from tessera.operators.components import components


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_that_grows_is_broadcast(spark):
    """Joins of titles, grams and links are dealt out, however small they are or are said to be."""
    titles = spark.range(60).select("id", F.format_string("results of %d and some other words", F.col("id") % 20).alias("norm"), F.array(F.floor(F.col("id") / 9)).alias("blocks"))
    keyed = titles.select("id", "norm", F.array().cast("array<string>").alias("keys"), (F.col("id") * 3600.0).alias("seconds"))
    articles = titles.select("id", F.col("norm").alias("title"), F.timestamp_seconds(F.col("id") * 3600).alias("published_at"), F.timestamp_seconds(F.lit(0)).alias("first_seen_at"), F.lit(None).cast("long").alias("story_id"))
    for df in (stories.candidate_titles(titles), stories.matching_pairs(keyed), stories.grouped(articles)):
        assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)
    links = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(links).collect()} == {0}


def test_components_plan_their_links_once(spark, monkeypatch):
    """What makes the links may be long; the driver has it in one place of a plan, not one for each direction."""
    plans, cut = [], components_module.cut
    monkeypatch.setattr(components_module, "cut", lambda df: plans.append(plan(df)) or cut(df))
    got = components(spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert plans[0].count("Range (") == 1 and {r.component for r in got.collect()} == {0}


def test_a_title_that_comes_often_is_not_gone_through_for_each_that_is_like_it(spark):
    """The runs of paired classes that have rows within the span of each other, against all pairs of their rows; edges of the span included."""
    r, span = random.Random(11), 100
    rows = [("a", i, 60.0 * i) for i in range(200)] + [(c, 1000 + 10 * k + i, r.randrange(0, 140) * 100 + r.choice([0.0, 0.25])) for k, c in enumerate("bcdef") for i in range(8)]
    pairs, runs, met = [("a", c) for c in "bcdef"] + [("b", "c")], [], set()
    for c in "abcdef":
        for _, i, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[2]):
            if runs and runs[-1][0] == c and t - runs[-1][3] <= span:
                runs[-1][3] = t
            else:
                runs.append([c, i, t, t])
    head = {i: h for c, h, s, e in runs for d, i, t in rows if c == d and s <= t <= e}
    for x, y in pairs:
        met |= {tuple(sorted((head[i], head[j]))) for c, i, t in rows if c == x for d, j, u in rows if d == y and abs(t - u) <= span}
    got = stories._runs_that_meet(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(runs, "class string, head long, begin double, end double"), span).collect()
    assert sorted(map(tuple, got)) == sorted(met) and len(got) > 10


def _alike(a, b, similar):
    return (set_ratio if min(len(a.split()), len(b.split())) >= stories.SHORT else sorted_ratio)(a, b) >= similar


def _candidates(spark, titles, blocks, **how):
    df = spark.createDataFrame([(i, t, [b]) for i, (t, b) in enumerate(zip(titles, blocks))], "id long, norm string, blocks array<long>")
    return {(x.a, x.b) for x in stories.candidate_titles(df, **how).collect()}


def _titles(r, n):
    """Titles of one language: few syllables, so that any two share grams; every tenth is like the one before it."""
    parts = ["th", "en", "er", "io", "an", "on", "es", "le", "ou", "ha"]
    out = []
    for i in range(n):
        w = out[-1].split() if i % 10 == 9 else ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(8)]
        if i % 10 == 9:
            w[r.randrange(8)] += r.choice("sz")
        out.append(" ".join(w))
    return out


def test_few_titles_are_compared_that_are_not_alike(spark):
    """Titles that share a gram, as all of a language do, are no candidates for that."""
    titles = _titles(random.Random(4), 200)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if _alike(titles[i], titles[j], 90)}
    got = _candidates(spark, titles, [0] * 200)
    assert len(want) >= 20 and want <= got and len(got) < 4 * len(want)


def test_tiles_meet_those_of_their_block_and_the_next(spark):
    r = random.Random(6)
    titles, blocks = _titles(r, 150), [r.choice([-2, -1, 0, 1, 5]) for _ in range(150)]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if abs(blocks[i] - blocks[j]) <= 1 and _alike(titles[i], titles[j], 90)}
    got = _candidates(spark, titles, blocks, tile=7)
    assert want and want <= got and all(abs(blocks[a] - blocks[b]) <= 1 for a, b in got) and got == _candidates(spark, titles, blocks)


def test_no_alike_titles_are_ruled_out():
    """Bounds hold at any threshold, for short and empty titles, other letters, and where members share columns."""
    r, found = random.Random(3), 0
    for k in range(60):
        words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, r.choice([1, 3, 9])))) for _ in range(r.choice([6, 30]))]
        titles = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(8)]
        titles += [" ".join(r.sample(t.split(), len(t.split())) + r.choices(words, k=r.choice([0, 1, 5]))) for t in titles] + [t[1:].strip() for t in titles]
        similar, short = r.choice([60.0, 90.0, 95.0, 100.0]), r.choice([0, 2, 6])
        got = set(possible_pairs(titles, titles, similar, short, r.choice([8, 64, WIDTH])).tolist())
        for i, a in enumerate(titles):
            for j, b in enumerate(titles):
                if (set_ratio if min(len(a.split()), len(b.split())) >= short else sorted_ratio)(a, b) >= similar:
                    found += i != j
                    assert i * len(titles) + j in got
    assert found > 1000
