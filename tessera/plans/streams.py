"""Streams over the derived tables, run until they have taken all there is."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import linking
from tessera.operators.lineage import shared_folder
from tessera.operators.scoring import WordScorer
from tessera.plans import entities, sessions
from tessera.plans.registry import Area
from tessera.sources import tables as T
from tessera.streaming.news import Desk

AREA = Area("streams")
query = AREA.query
GOOD, BAD = {"that", "which", "people", "und", "de"}, {"there", "were", "this", "der", "la"}
#: Into how many batches the articles are dealt, whatever their number.
BATCHES = 4

_COUNT = lambda words: f"len(list_filter(w, lambda x: x IN ({str(sorted(words))[1:-1]})))"


def link(articles: DataFrame) -> DataFrame:
    """Mentions of the companies; what is scored is the title."""
    rows = articles.select("id", "title", "summary", F.col("text").alias("body"), F.coalesce("published_at", "first_seen_at").cast("date").alias("day"))
    return linking.mentions(rows, entities.COMPANIES, finance=entities.FINANCE, market=entities.MARKET).select("id", "symbol", "confidence", F.col("title").alias("text"))


@query(f"""WITH {sessions._K}, {entities._LINKED}, words AS (SELECT id, string_split(lower(title), ' ') AS w FROM articles), scores AS (SELECT id, (g - b) / (g + b + 1) AS score FROM (SELECT id, {_COUNT(GOOD)} AS g, {_COUNT(BAD)} AS b FROM words)),
  sc AS (SELECT a.id AS article_id, l.symbol, s.score, l.confidence, coalesce(a.story_id, a.id) AS story, a.first_seen_at, make_timestamp(coalesce(least(a.published_at, a.first_seen_at), a.first_seen_at) * 1000000) + INTERVAL 330 MINUTE AS local
    FROM linked l JOIN articles a ON a.id = l.id JOIN scores s ON s.id = l.id WHERE l.confidence >= 0.5),
  ss AS (SELECT sc.*, {sessions._SESSION} AS session_date FROM sc JOIN cal ON cal.day = local::DATE),
  st AS (SELECT symbol, story, min(session_date) AS session_date, avg(score) AS score, max(confidence) AS confidence, count(DISTINCT article_id) AS articles, max(first_seen_at) AS seen FROM ss GROUP BY ALL)
  SELECT symbol, session_date, count(*) AS story_count, sum(articles)::BIGINT AS article_count, round(avg(score), 9) AS mean_score, round(sum(score * confidence) / sum(confidence), 9) AS weighted_score, count(*) FILTER (score <= -0.5) AS strong_negative_stories, max(seen) AS latest_first_seen_at
  FROM st GROUP BY ALL""")
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, in batches that each have some of every day's: linked, scored, and the sessions made anew as late copies come in."""
    folder = f"{shared_folder(spark)}/news-{uuid.uuid4().hex}"
    files = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    articles = T.articles(spark, sf_dir).select("id", "title", "summary", "text", "story_id", "published_at", "first_seen_at")
    articles.repartition(files, "id").write.parquet(f"{folder}/arrived")
    arrived = spark.readStream.schema(articles.schema).option("maxFilesPerTrigger", math.ceil(files / BATCHES)).parquet(f"{folder}/arrived")
    # The desk leaves out what has no session: moments behind the calendar's last one get one that is null again in the end.
    later = F.lit("9999-12-31").cast("date")
    days = sessions.days(spark, sf_dir).withColumn("next_session", F.coalesce("next_session", later))
    desk = Desk(spark, f"{folder}/desk", days, link, WordScorer(GOOD, BAD))
    desk.start(arrived).awaitTermination()
    return desk.sentiment().withColumns({"session_date": F.nullif("session_date", later), "mean_score": F.round("mean_score", 9), "weighted_score": F.round("weighted_score", 9), "latest_first_seen_at": T.seconds("latest_first_seen_at")})
