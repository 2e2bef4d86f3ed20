"""News and forum queries: sessions, linking, sentiment aggregates, incremental joins, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.ranking import ranked
from tessera.sources.tables import table

CLOSE = "15:30:00"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored mentions: article, symbol, story, score, confidence, moment (UTC)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("article_id"), F.col("event_type").alias("symbol"), (F.col("event_id") % 997).alias("story_id"), (F.pmod(F.col("event_id") * 37, F.lit(201)) / 100 - 1).alias("score"), (F.pmod(F.col("event_id") * 13, F.lit(51)) / 100 + 0.5).alias("confidence"), F.col("ts").cast("timestamp").alias("moment"))


def session_of(moment: F.Column) -> F.Column:
    """The session a moment (UTC) belongs to: after the close it is the next day's; weekends go to Monday."""
    local = F.from_utc_timestamp(moment, "Asia/Kolkata")
    day = F.when(F.date_format(local, "HH:mm:ss") > CLOSE, F.date_add(local.cast("date"), 1)).otherwise(local.cast("date"))
    return F.date_add(day, F.when(F.weekday(day) >= 5, 7 - F.weekday(day)).otherwise(0))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy(session_of(F.col("moment")).alias("session_date")).agg(F.count("*").alias("n"))


def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies to stories, stories to sessions: the mean of story means, weighted by confidence too."""
    m = mentions(spark, sf_dir).withColumn("session_date", session_of(F.col("moment")))
    story = m.groupBy("symbol", "story_id").agg(F.min("session_date").alias("session_date"), F.avg("score").alias("score"), F.max("confidence").alias("confidence"), F.count_distinct("article_id").alias("articles"))
    return story.groupBy("symbol", "session_date").agg(F.count("*").alias("story_count"), F.sum("articles").alias("article_count"), F.avg("score").alias("mean_score"), F.try_divide(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")).alias("weighted_score"), F.count_if(F.col("score") <= -0.5).alias("strong_negative_stories"))


def sentiment_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story-weighted means of 7 and 30 calendar days, and whether they are 0.3 apart on 3 stories or more."""
    d = daily_sentiment(spark, sf_dir).withColumn("day", F.unix_date("session_date"))
    over = lambda n: W.partitionBy("symbol").orderBy("day").rangeBetween(1 - n, 0)
    mean = lambda n: F.try_divide(F.sum(F.col("weighted_score") * F.col("story_count")).over(over(n)), F.sum("story_count").over(over(n)))
    d = d.select("symbol", "session_date", mean(7).alias("avg_7"), mean(30).alias("avg_30"), F.sum("story_count").over(over(7)).alias("stories_7"))
    return d.withColumn("shifted", (F.col("stories_7") >= 3) & (F.abs(F.col("avg_7") - F.col("avg_30")) >= 0.3))


def pending_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of enough confidence that no score exists for yet."""
    m = mentions(spark, sf_dir)
    scored = m.where("article_id % 3 = 0").select("article_id", "symbol")
    return m.where("confidence >= 0.8").join(scored, ["article_id", "symbol"], "left_anti").select("article_id", "symbol", "confidence")


def stock_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions of one symbol, with their score if its model gave one: the filter stands inside the join's side."""
    m = mentions(spark, sf_dir)
    scored = m.where("article_id % 3 = 0 and symbol = 'click'").select("article_id", "score")
    return m.where("symbol = 'click'").select("article_id", "story_id").join(scored, "article_id", "left")


def story_first_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each story: the first non-null value of each column in time order, copies and other symbols."""
    m = mentions(spark, sf_dir).withColumn("note", F.when(F.col("article_id") % 4 != 0, F.concat(F.lit("n"), F.col("article_id"))))
    at = F.struct("moment", "article_id")
    return m.groupBy("story_id").agg(F.min_by("article_id", at).alias("article_id"), F.min_by("note", F.when(F.col("note").isNotNull(), at)).alias("note"), F.count("*").alias("copies"), F.array_size(F.array_distinct(F.collect_set("symbol"))).alias("symbols"), F.avg("score").alias("score"))


def top_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("symbol").orderBy("score", "article_id")
    return mentions(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 5").select("symbol", "article_id", "score", "r")


def by_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by symbol and status, zeros filled; rows without symbol drop out."""
    m = mentions(spark, sf_dir).where("symbol is not null").withColumn("status", F.when(F.col("score") > 0.3, "positive").when(F.col("score") < -0.3, "negative").otherwise("neutral"))
    return m.groupBy("symbol").pivot("status", ["positive", "negative", "neutral"]).count().na.fill(0)


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages round-robin over their hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"))
    return ranked(p, "host", "page_id", "round")


def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("norm_url"), text.url_id(F.col("url")).alias("id"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_tags(F.col("html")).alias("text"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their number of words and their kind: too short, or an opinion."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    n = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return c.select("conv_id", "turn", n.alias("n_words"), F.when(n < 6, "short").otherwise("opinion").alias("kind"))


def document_tokens_that_distinguish(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return d.select("doc_id", F.array_join(text.distinguishing_tokens(F.col("title")), ",").alias("tokens"))


def linking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro precision and recall of predicted pairs against expected ones; empty denominators give 1."""
    m = mentions(spark, sf_dir).select("article_id", "symbol", "confidence", "score")
    predicted = m.where("confidence >= 0.7").select("article_id", "symbol", F.lit(1).alias("p"))
    expected = m.where("score > -0.5").select("article_id", "symbol", F.lit(1).alias("e"))
    both = predicted.join(expected, ["article_id", "symbol"], "full")
    hit = F.sum(F.coalesce(F.col("p") * F.col("e"), F.lit(0)))
    return both.agg(F.coalesce(F.try_divide(hit, F.sum("p")), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(hit, F.sum("e")), F.lit(1.0)).alias("recall"))


_ALL = (sessions, daily_sentiment, sentiment_shift, pending_mentions, stock_news, story_first_copy, top_headlines, by_source_status, interleaved_pages, page_ids, page_texts, posts, document_tokens_that_distinguish, linking_quality)
QUERIES = {f"news_{f.__name__}": f for f in _ALL}

_M = """m AS (SELECT event_id AS article_id, event_type AS symbol, event_id % 997 AS story_id, ((event_id * 37) % 201) / 100.0::DOUBLE - 1 AS score,
  ((event_id * 13) % 51) / 100.0::DOUBLE + 0.5::DOUBLE AS confidence, ts + INTERVAL 330 MINUTE AS local, ts AS moment FROM events),
a AS (SELECT *, CASE WHEN strftime(local, '%H:%M:%S') > '15:30:00' THEN local::DATE + 1 ELSE local::DATE END AS day FROM m),
s AS (SELECT *, day + CASE isodow(day) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS session_date FROM a)"""
_D = f"""{_M}, story AS (SELECT symbol, story_id, min(session_date) AS session_date, avg(score) AS score, max(confidence) AS confidence, count(DISTINCT article_id) AS articles FROM s GROUP BY ALL),
d AS (SELECT symbol, session_date, count(*) AS story_count, sum(articles)::BIGINT AS article_count, avg(score) AS mean_score, sum(score * confidence) / nullif(sum(confidence), 0) AS weighted_score,
  count(*) FILTER (score <= -0.5) AS strong_negative_stories FROM story GROUP BY ALL)"""
_R = lambda n: f"OVER (PARTITION BY symbol ORDER BY session_date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"

ORACLES = {
    "news_sessions": f"WITH {_M} SELECT session_date, count(*) AS n FROM s GROUP BY ALL",
    "news_daily_sentiment": f"WITH {_D} SELECT * FROM d",
    "news_sentiment_shift": f"""WITH {_D}, r AS (SELECT symbol, session_date, sum(weighted_score * story_count) {_R(7)} / sum(story_count) {_R(7)} AS avg_7, sum(weighted_score * story_count) {_R(30)} / sum(story_count) {_R(30)} AS avg_30,
        (sum(story_count) {_R(7)})::BIGINT AS stories_7 FROM d) SELECT *, stories_7 >= 3 AND abs(avg_7 - avg_30) >= 0.3 AS shifted FROM r""",
    "news_pending_mentions": f"WITH {_M} SELECT article_id, symbol, confidence FROM m WHERE confidence >= 0.8 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.article_id % 3 = 0 AND x.article_id = m.article_id AND x.symbol = m.symbol)",
    "news_stock_news": f"WITH {_M} SELECT m.article_id, m.story_id, x.score FROM m LEFT JOIN (SELECT * FROM m WHERE article_id % 3 = 0 AND symbol = 'click') x ON x.article_id = m.article_id WHERE m.symbol = 'click'",
    "news_story_first_copy": f"""WITH {_M}, n AS (SELECT *, CASE WHEN article_id % 4 <> 0 THEN 'n' || article_id END AS note FROM m)
        SELECT story_id, (array_agg(article_id ORDER BY moment, article_id))[1] AS article_id, (array_agg(note ORDER BY moment, article_id) FILTER (note IS NOT NULL))[1] AS note,
               count(*) AS copies, count(DISTINCT symbol)::INT AS symbols, avg(score) AS score FROM n GROUP BY story_id""",
    "news_top_headlines": f"WITH {_M}, r AS (SELECT symbol, article_id, score, row_number() OVER (PARTITION BY symbol ORDER BY score, article_id) AS r FROM m) SELECT * FROM r WHERE r <= 5",
    "news_by_source_status": f"WITH {_M} SELECT symbol, count(*) FILTER (score > 0.3) AS positive, count(*) FILTER (score < -0.3) AS negative, count(*) FILTER (score BETWEEN -0.3 AND 0.3) AS neutral FROM m WHERE symbol IS NOT NULL GROUP BY symbol",
    "news_interleaved_pages": "WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages) SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS round FROM p",
    "news_page_ids": r"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), c AS (
        SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
               list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|fbclid|gclid|ref|src)='))) AS q FROM b),
        n AS (SELECT page_id, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS norm_url FROM c)
        SELECT page_id, norm_url, substr(sha256(norm_url), 1, 32) AS id FROM n""",
    "news_page_texts": r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), '') AS text FROM pages",
    "news_posts": "WITH c AS (SELECT conv_id, turn, len(list_filter(string_split(trim(coalesce(text, '')), ' '), lambda w: w <> ''))::INT AS n_words FROM conversations) SELECT *, CASE WHEN n_words < 6 THEN 'short' ELSE 'opinion' END AS kind FROM c",
    "news_document_tokens_that_distinguish": r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9%]+', ' ', 'g')), ' ') AS w FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '^(mon|tues|wednes|thurs|fri|satur|sun)day$')))), ',') AS tokens FROM t""",
    "news_linking_quality": f"""WITH {_M}, p AS (SELECT article_id, symbol, 1 AS p FROM m WHERE confidence >= 0.7), e AS (SELECT article_id, symbol, 1 AS e FROM m WHERE score > -0.5)
        SELECT coalesce(sum(coalesce(p * e, 0)) / nullif(sum(p), 0), 1)::DOUBLE AS precision, coalesce(sum(coalesce(p * e, 0)) / nullif(sum(e), 0), 1)::DOUBLE AS recall FROM p FULL JOIN e USING (article_id, symbol)""",
}
