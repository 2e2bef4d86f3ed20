"""The stream of news against the same rows taken at once: late copies, repeated ids, a stop in the middle of a batch."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.operators.calendar import calendar
from tessera.operators.scoring import WordScorer
from tessera.streaming.news import Desk

SCHEMA = "id long, title string, story_id long, published_at timestamp, first_seen_at timestamp"


def at(day, hour=5):
    return dt.datetime(2024, 1, day, hour)


# Three deliveries: the second has a copy of story 1 from an earlier session, an id that has come before and one twice; the third nobody's news,
# a row without moments and one without id.
DELIVERIES = [
    [(1, "Acme good", 1, at(4), at(4, 6)), (2, "Acme bad bad", None, at(4), at(4, 7)), (3, "Bolt good Acme", 3, None, at(5))],
    [(4, "Acme bad", 1, at(3), at(5, 8)), (1, "Acme bad bad bad", 1, at(8), at(8)), (5, "Bolt bad", 3, at(9), at(9)), (5, "Bolt good", 3, at(9), at(9, 9)), (6, "Acme good", 6, at(6), at(8))],
    [(7, "nobody", None, at(10), at(10)), (8, "Acme", 8, None, None), (None, "Acme good", None, at(9), at(9)), (9, "Acme good", 6, at(12, 11), at(12, 12)), (10, None, None, at(9), at(9))],
]


def link(rows):
    named = F.filter(F.array(F.lit("Acme"), F.lit("Bolt")), lambda s: F.contains("title", s))
    return rows.select("id", F.explode(named).alias("symbol"), F.lit(0.9).alias("confidence"), F.col("title").alias("text"))


def desk(spark, folder, kind=Desk):
    days = calendar(spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4, 5, 8, 9)], "day date"), dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    return kind(spark, folder, days, link, WordScorer({"good"}, {"bad"}))


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, d, arrived):
    d.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrived)).awaitTermination()


def result(d):
    cells = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    return sorted(cells(r) for r in d.sentiment().collect())


def at_once(spark, rows):
    """The plain way: first of each id, copies to stories, stories to sessions."""
    seen, told = set(), {}
    holiday = lambda day: day.weekday() > 4
    for delivery in rows:
        new = sorted((r for r in delivery if r[0] is not None and r[0] not in seen), key=lambda r: (r[4] is not None, r[4] or at(1)))
        for i, title, story, published, first in new:
            if i in seen:
                continue
            seen.add(i)
            moments = [m for m in (published, first) if m]
            if not moments:
                continue
            local = min(moments) + dt.timedelta(minutes=330)
            day = local.date() + dt.timedelta(days=local.time() > dt.time(15, 30))
            while holiday(day):
                day += dt.timedelta(days=1)
            for symbol in ("Acme", "Bolt"):
                if symbol in (title or ""):
                    good, bad = title.split().count("good"), title.split().count("bad")
                    told.setdefault((symbol, i if story is None else story), []).append((day, (good - bad) / (good + bad + 1), i, first))
    days = {}
    for (symbol, _), copies in told.items():
        days.setdefault((symbol, min(c[0] for c in copies)), []).append((sum(c[1] for c in copies) / len(copies), len({c[2] for c in copies}), max(c[3] for c in copies)))
    mean = lambda s: round(sum(x[0] for x in s) / len(s), 9)
    return sorted((k[0], len(s), sum(x[1] for x in s), mean(s), mean(s), sum(x[0] <= -0.5 for x in s), max(x[2] for x in s), k[1]) for k, s in days.items())


def test_batches_give_what_all_rows_give(spark, tmp_path):
    arrived, d = f"{tmp_path}/arrived", desk(spark, f"{tmp_path}/desk")
    for k, rows in enumerate(DELIVERIES):
        deliver(spark, arrived, rows)
        run(spark, d, arrived)
        assert result(d) == at_once(spark, DELIVERIES[: k + 1])
    assert len(result(d)) == 5


class Failing(Desk):
    """Stops in one batch, once its mentions are stored, or before it is marked as done."""

    def take(self, rows, batch):
        super().take(rows, batch)
        if batch == 1 and self.where == "after":
            raise RuntimeError("lost")

    def rebuild(self, schema, batch):
        if batch == 1 and self.where == "between":
            raise RuntimeError("lost")
        super().rebuild(schema, batch)


@pytest.mark.parametrize("where", ["between", "after"])
def test_a_stopped_stream_goes_on(spark, tmp_path, where):
    arrived = f"{tmp_path}/arrived"
    deliver(spark, arrived, DELIVERIES[0])
    run(spark, desk(spark, f"{tmp_path}/desk"), arrived)
    deliver(spark, arrived, DELIVERIES[1])
    failing = desk(spark, f"{tmp_path}/desk", Failing)
    failing.where = where
    with pytest.raises(StreamingQueryException):
        run(spark, failing, arrived)
    deliver(spark, arrived, DELIVERIES[2])
    d = desk(spark, f"{tmp_path}/desk")
    run(spark, d, arrived)
    assert result(d) == at_once(spark, DELIVERIES)
    stored = spark.read.parquet(d.mentions)
    assert stored.where("article_id is not null").groupBy("article_id", "symbol").count().where("count > 1").isEmpty()


def test_nothing_arrives(spark, tmp_path):
    d = desk(spark, f"{tmp_path}/desk")
    deliver(spark, f"{tmp_path}/arrived", [])
    run(spark, d, f"{tmp_path}/arrived")
    assert result(d) == []
