"""Reads of stored tables and keyed writes: scans, key look-ups, joins, updates and deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sinks
from tessera.plans.registry import Area
from tessera.sources import tables as T
from tessera.sources.tables import seconds

AREA = Area("store")
query = AREA.query
S = 1704067200


def moments(df: DataFrame, *columns: str) -> DataFrame:
    """Moments as seconds, -1 for none, so that a query's rows do not depend on a time zone."""
    return df.withColumns({c: F.coalesce(seconds(c), F.lit(-1)) for c in columns})


@query(f"WITH {T.BARS}, i AS (SELECT symbol, date, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma_20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)) SELECT symbol, date, round(sma_20, 4) AS sma_20 FROM i WHERE symbol = '2-HIGH' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def indicators_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored indicators of one symbol between two dates; the symbol's filter reaches the scan, the dates' can't pass the window."""
    from tessera.operators.series import full

    b = T.bars(spark, sf_dir).where("symbol = '2-HIGH'")
    return b.select("symbol", "date", F.round(full(F.avg, "close", 20), 4).alias("sma_20")).where("date between date '1996-01-01' and date '1996-12-31'").orderBy("date")


@query(f"WITH {T.ALERTS} SELECT symbol, alert_type, subject, alert_date, severity FROM alerts WHERE alert_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def alerts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.alerts(spark, sf_dir).where("alert_date between date '2024-01-05' and date '2024-01-12'")
    return a.select("symbol", "alert_type", "subject", "alert_date", "severity").orderBy("alert_date", "severity", "symbol", "subject")


@query(f"WITH {T.ALERTS} SELECT symbol, subject, alert_date FROM alerts WHERE sent_at IS NULL AND alert_date <= DATE '2024-01-20' AND severity = 'high'")
def unsent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.alerts(spark, sf_dir).where("sent_at is null and alert_date <= date '2024-01-20' and severity = 'high'").select("symbol", "subject", "alert_date")


@query(f"WITH {T.RUNS} SELECT started_at, exit_code, failures FROM runs")
def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(T.runs(spark, sf_dir), "started_at").orderBy("started_at")


@query(f"WITH {T.STORED_ACTIONS} SELECT * FROM stored_actions WHERE symbol = '1-URGENT'")
def corporate_actions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's recorded actions by date."""
    return T.stored_actions(spark, sf_dir).where("symbol = '1-URGENT'").orderBy("ex_date", "action_type")


@query(f"WITH {T.ARTICLES} SELECT id, title, coalesce(story_id, -1) AS story_id, coalesce(published_at, first_seen_at) AS event_time FROM articles WHERE coalesce(published_at, first_seen_at) >= {S} + 100000")
def articles_for_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).withColumn("event_time", seconds(F.coalesce("published_at", "first_seen_at")))
    return a.where(F.col("event_time") >= S + 100000).select("id", "title", F.coalesce("story_id", F.lit(-1)).alias("story_id"), "event_time")


@query(f"WITH {T.ARTICLES} SELECT min(coalesce(published_at, first_seen_at)) AS earliest FROM articles WHERE story_id IS NULL")
def earliest_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).where("story_id is null").agg(seconds(F.min(F.coalesce("published_at", "first_seen_at"))).alias("earliest"))


@query(f"WITH {T.ARTICLES}, {T.POSTS} SELECT id::VARCHAR AS id, 'article' AS kind FROM articles WHERE linked_at IS NULL UNION ALL SELECT id, 'post' FROM posts WHERE linked_at IS NULL")
def to_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and posts that no linking has seen."""
    of = lambda df, kind: df.where("linked_at is null").select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"))
    return of(T.articles(spark, sf_dir), "article").unionByName(of(T.posts(spark, sf_dir), "post"))


@query(f"WITH {T.ARTICLES} SELECT id, url, text_attempts FROM articles WHERE text_status = 'pending' AND text_attempts < 3 ORDER BY first_seen_at, id LIMIT 40")
def pending_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 oldest articles whose text is still to be fetched."""
    return T.articles(spark, sf_dir).where("text_status = 'pending' and text_attempts < 3").orderBy("first_seen_at", "id").limit(40).select("id", "url", "text_attempts")


@query(f"WITH {T.ARTICLES} SELECT id, url, length(text) AS n_chars FROM articles WHERE text_status = 'ok' AND text IS NOT NULL")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).where("text_status = 'ok' and text is not null").select("id", "url", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {T.BARS} SELECT DISTINCT date FROM bars")
def trading_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().orderBy("date")


@query(f"WITH {T.FILINGS} SELECT id, symbol, filed_at, subject FROM filings WHERE symbol = '2-HIGH'")
def filings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's filings, newest first."""
    return moments(T.filings(spark, sf_dir).where("symbol = '2-HIGH'").select("id", "symbol", "filed_at", "subject"), "filed_at").orderBy(F.desc("filed_at"))


@query(f"WITH {T.FILINGS} SELECT id, symbol, attachment_path FROM filings WHERE category = 'Financial Results' AND attachment_path IS NOT NULL")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.filings(spark, sf_dir).where("category = 'Financial Results' and attachment_path is not null").select("id", "symbol", "attachment_path")


@query(f"WITH {T.RESULTS} SELECT symbol, period_end, basis, metric, value FROM results WHERE symbol IN ('N3', 'N17')")
def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.results(spark, sf_dir).where("symbol in ('N3', 'N17')").select("symbol", "period_end", "basis", "metric", "value").orderBy("symbol", "period_end", "basis", "metric")


@query(f"WITH {T.NEWS} SELECT symbol, count(*) AS n, round(sum(score), 6) AS total FROM article_sentiment WHERE model_name = '{T.MODEL}' GROUP BY symbol")
def sentiment_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.article_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query(f"WITH {T.FILINGS}, new AS (SELECT sha256(text) AS sha, 'new' || doc_id AS name FROM documents WHERE doc_id % 3 = 0) SELECT new.name, f.id FROM new JOIN (SELECT attachment_sha256, min(id) AS id FROM filings GROUP BY ALL) f ON f.attachment_sha256 = new.sha")
def filing_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files that are stored already, and as what: by the hash of their content."""
    new = T.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha"), F.format_string("new%d", "doc_id").alias("name"))
    stored = T.filings(spark, sf_dir).where("attachment_sha256 is not null").groupBy(F.col("attachment_sha256").alias("sha")).agg(F.min("id").alias("id"))
    return new.join(stored, "sha").select("name", "id")


@query(f"WITH {T.POSTS} SELECT topic_id, count(*) AS n, max(post_number) AS last_post FROM posts WHERE topic_id = 4 GROUP BY topic_id")
def topic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.posts(spark, sf_dir).where("topic_id = 4").groupBy("topic_id").agg(F.count("*").alias("n"), F.max("post_number").alias("last_post"))


@query(f"WITH {T.POSTS} SELECT id, coalesce(checked_at, -1) AS checked_at FROM posts ORDER BY checked_at NULLS FIRST, id LIMIT 50")
def posts_to_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 posts whose last check is longest ago."""
    return moments(T.posts(spark, sf_dir).select("id", "checked_at").orderBy(F.asc_nulls_first("checked_at"), "id").limit(50), "checked_at")


@query(f"WITH {T.RESULTS}, c AS (SELECT filing_id, symbol, string_agg(DISTINCT basis, '+' ORDER BY basis) AS bases FROM results GROUP BY ALL) SELECT filing_id, symbol, array_to_string(string_split(bases, '+'), ',') AS bases, len(string_split(bases, '+')) AS n FROM c")
def checked_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bases a checked filing has, stored as text that is split again."""
    stored = T.results(spark, sf_dir).groupBy("filing_id", "symbol").agg(F.array_join(F.array_sort(F.collect_set("basis")), "+").alias("bases"))
    split = F.split("bases", r"\+")
    return stored.select("filing_id", "symbol", F.array_join(split, ",").alias("bases"), F.size(split).cast("long").alias("n"))


# --- writes ------------------------------------------------------------------------


@query(f"WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, ts FROM events) SELECT event_id, value, floor(epoch(ts - INTERVAL 330 MINUTE))::BIGINT AS seen_at, (ts)::DATE AS day FROM e")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write makes of NaN, of moments with an offset and of exchange dates."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30")).alias("seen_at"))
    e = e.withColumn("day", F.col("seen_at"))
    return moments(sinks.normalised(e, ["seen_at"], ["day"]), "seen_at")


@query(f"WITH {T.BARS}, new AS (SELECT symbol, date, close * 2 AS close FROM bars WHERE date >= DATE '1998-01-01'), old AS (SELECT * FROM bars WHERE date < DATE '1999-01-01') SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.date, n.date) AS date, CASE WHEN n.symbol IS NULL THEN o.close ELSE n.close END AS close, coalesce(o.volume, -1) AS volume, CASE WHEN n.symbol IS NULL THEN 1 ELSE 2 END AS fetched FROM old o FULL JOIN n_ n ON n.symbol = o.symbol AND n.date = o.date".replace("n_ n", "new n"))
def prices_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later bars again: columns that come replace the stored ones, others stay; when a row was fetched has a default."""
    b = T.bars(spark, sf_dir)
    old = b.where("date < date '1999-01-01'").select("symbol", "date", "close", "volume", F.lit(1).alias("fetched"))
    new = sinks.with_default(b.where("date >= date '1998-01-01'").select("symbol", "date", (F.col("close") * 2).alias("close")), "fetched", F.lit(2))
    return sinks.upsert(old, new, ["symbol", "date"]).withColumn("volume", F.coalesce("volume", F.lit(-1)))


@query(f"WITH {T.NEWS} SELECT article_id, symbol, model_name, score FROM article_sentiment WHERE NOT (model_name = 'older' AND symbol IN ('1-URGENT', '2-HIGH')) UNION ALL SELECT article_id, symbol, 'older', 9.0 FROM article_sentiment WHERE model_name = '{T.MODEL}' AND symbol = '1-URGENT' AND article_id % 10 = 1")
def scope_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of two symbols and a model are replaced; the new table has none for one of them, which is cleared."""
    stored = T.article_sentiment(spark, sf_dir)
    new = stored.where((F.col("model_name") == T.MODEL) & (F.col("symbol") == "1-URGENT") & (F.col("article_id") % 10 == 1)).withColumn("model_name", F.lit("older")).withColumn("score", F.lit(9.0))
    return sinks.replace_scope(stored, new, spark.createDataFrame([("1-URGENT", "older"), ("2-HIGH", "older")], "symbol string, model_name string"), ["symbol", "model_name"])


@query(f"WITH {T.ALERTS}, new AS (SELECT symbol, alert_type, subject, event_id, row_number() OVER (PARTITION BY symbol, alert_type, subject ORDER BY event_id) AS r FROM (SELECT {T.pick_sql(T.SYMBOLS, 'event_id % 4')} AS symbol, {T.pick_sql(T.TYPES, 'event_id % 3')} AS alert_type, (event_id // 2 * 12) || ':' || event_type AS subject, event_id FROM events)) SELECT symbol, count(*) AS n FROM new WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM alerts a WHERE a.symbol = new.symbol AND a.alert_type = new.alert_type AND a.subject = new.subject) GROUP BY symbol")
def new_alerts_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many alerts a write puts in, by symbol: keys that are stored, or come twice, count once."""
    k = F.col("event_id")
    new = T.table(spark, sf_dir, "events").select(T.pick(T.SYMBOLS, k % 4).alias("symbol"), T.pick(T.TYPES, k % 3).alias("alert_type"), F.format_string("%d:%s", (k / 2).cast("long") * 12, F.col("event_type")).alias("subject"), "event_id")
    return sinks.inserted(T.alerts(spark, sf_dir), new, ["symbol", "alert_type", "subject"], ["event_id"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {T.NEWS} SELECT 'mention' AS what, article_id, symbol FROM article_mentions WHERE article_id % 10 <> 3 UNION ALL SELECT 'mention', id, '2-HIGH' FROM articles WHERE id % 20 = 3 UNION ALL SELECT 'sentiment', article_id, symbol FROM article_sentiment WHERE article_id % 10 <> 3")
def mentions_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that were linked anew: their mentions are replaced and their sentiment goes."""
    again = T.articles(spark, sf_dir).where("id % 10 = 3").select(F.col("id").alias("article_id"))
    mentions, sentiment = T.article_mentions(spark, sf_dir).select("article_id", "symbol"), T.article_sentiment(spark, sf_dir).select("article_id", "symbol")
    new = again.where("article_id % 20 = 3").withColumn("symbol", F.lit("2-HIGH"))
    kept = sinks.replace_scope(mentions, new, again, ["article_id"])
    return kept.select(F.lit("mention").alias("what"), "*").unionByName(sinks.delete_keys(sentiment, again, ["article_id"]).select(F.lit("sentiment").alias("what"), "*"))


@query(f"WITH {T.ARTICLES} SELECT id, CASE WHEN id % 6 = 0 THEN 'ok' ELSE text_status END AS text_status, CASE WHEN id % 6 = 0 THEN text_attempts + 1 ELSE text_attempts END AS text_attempts, coalesce(CASE WHEN id % 6 <> 0 THEN linked_at END, -1) AS linked_at FROM articles")
def texts_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched texts: the rows' status and attempts change, and they are to be linked again."""
    a = moments(T.articles(spark, sf_dir).select("id", "text_status", "text_attempts", "linked_at"), "linked_at")
    return sinks.update(a, a.where("id % 6 = 0").select("id", F.lit("ok").alias("text_status")), ["id"], {"text_attempts": F.col("text_attempts") + 1, "linked_at": F.lit(-1).cast("long")})


@query(f"WITH {T.ALERTS} SELECT subject, coalesce(CASE WHEN alert_date = DATE '2024-01-07' AND sent_at IS NULL THEN 1 ELSE sent_at END, -1) AS sent_at FROM alerts")
def alerts_marked_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = moments(T.alerts(spark, sf_dir).select("symbol", "alert_type", "subject", "alert_date", "sent_at"), "sent_at")
    due = a.where("alert_date = date '2024-01-07' and sent_at = -1").select("symbol", "alert_type", "subject", F.lit(1).cast("long").alias("sent_at"))
    return sinks.update(a, due, ["symbol", "alert_type", "subject"]).select("subject", "sent_at")


@query(f"WITH {T.FORUM} SELECT 'post' AS what, id FROM posts WHERE topic_id <> 2 UNION ALL SELECT 'mention', post_id FROM post_mentions JOIN posts ON id = post_id WHERE topic_id <> 2 UNION ALL SELECT 'sentiment', post_id FROM post_sentiment JOIN posts ON id = post_id WHERE topic_id <> 2")
def posts_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic that is gone: its posts go with their mentions and sentiment."""
    p = T.posts(spark, sf_dir)
    gone = p.where("topic_id = 2").select(F.col("id").alias("id"))
    of = lambda df, what: sinks.delete_keys(df, gone, ["id"]).select(F.lit(what).alias("what"), "id")
    named = lambda df: df.select(F.col("post_id").alias("id"))
    return of(p.select("id"), "post").unionByName(of(named(T.post_mentions(spark, sf_dir)), "mention")).unionByName(of(named(T.post_sentiment(spark, sf_dir)), "sentiment"))


@query(f"WITH {T.ALERTS} SELECT symbol, subject FROM alerts WHERE NOT (sent_at IS NULL AND alert_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12')")
def unsent_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.alerts(spark, sf_dir).where("not (sent_at is null and alert_date between date '2024-01-05' and date '2024-01-12')").select("symbol", "subject")


@query(f"WITH {T.FILINGS}, new AS (SELECT sha256(text) AS sha, 'file-' || left(sha256(text), 40) AS id, min(doc_id) AS name FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL) SELECT id, sha, name FROM new WHERE sha NOT IN (SELECT attachment_sha256 FROM filings WHERE attachment_sha256 IS NOT NULL)")
def files_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings that new files become; a content that is stored, or comes twice, gives one."""
    new = T.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("name"))
    new = sinks.inserted(T.filings(spark, sf_dir).select(F.col("attachment_sha256").alias("sha")), new, ["sha"], ["name"])
    return new.select(F.concat(F.lit("file-"), F.substring("sha", 1, 40)).alias("id"), "sha", "name")


# --- joins -------------------------------------------------------------------------


@query(f"WITH {T.NEWS} SELECT m.article_id, m.symbol, m.confidence, a.title, a.source FROM article_mentions m JOIN articles a ON a.id = m.article_id")
def mentions_with_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "title", "source")
    return T.article_mentions(spark, sf_dir).join(a, "article_id").select("article_id", "symbol", "confidence", "title", "source")


@query(f"WITH {T.FORUM} SELECT m.post_id, m.symbol, p.topic_id FROM post_mentions m JOIN posts p ON p.id = m.post_id WHERE m.confidence >= 0.5 AND m.post_kind = 'opinion' AND NOT EXISTS (SELECT 1 FROM post_sentiment s WHERE s.post_id = m.post_id AND s.symbol = m.symbol AND s.model_name = '{T.MODEL}')")
def post_mentions_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions of enough confidence that the model has not scored."""
    p = T.posts(spark, sf_dir).select(F.col("id").alias("post_id"), "topic_id")
    scored = T.post_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).select("post_id", "symbol")
    m = T.post_mentions(spark, sf_dir).where("confidence >= 0.5 and post_kind = 'opinion'")
    return m.join(p, "post_id").join(scored, ["post_id", "symbol"], "left_anti").select("post_id", "symbol", "topic_id")


@query(f"WITH {T.NEWS} SELECT m.article_id, m.symbol, m.confidence FROM article_mentions m JOIN articles a ON a.id = m.article_id WHERE m.confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM article_sentiment s WHERE s.article_id = m.article_id AND s.symbol = m.symbol AND s.model_name = '{T.MODEL}')")
def article_mentions_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = T.article_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).select("article_id", "symbol")
    a = T.articles(spark, sf_dir).select(F.col("id").alias("article_id"))
    return T.article_mentions(spark, sf_dir).where("confidence >= 0.5").join(a, "article_id").join(scored, ["article_id", "symbol"], "left_anti").select("article_id", "symbol", "confidence")


@query(f"WITH {T.NEWS} SELECT s.article_id, s.symbol, s.score, m.confidence, coalesce(a.story_id, -1) AS story_id, coalesce(a.published_at, -1) AS published_at, a.first_seen_at FROM article_sentiment s JOIN article_mentions m ON m.article_id = s.article_id AND m.symbol = s.symbol JOIN articles a ON a.id = s.article_id WHERE s.model_name = '{T.MODEL}'")
def scored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(scored(spark, sf_dir), "published_at", "first_seen_at").withColumn("story_id", F.coalesce("story_id", F.lit(-1)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored mentions of the model with their article's story and times."""
    a = T.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "story_id", "published_at", "first_seen_at")
    s = T.article_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).drop("model_name")
    return s.join(T.article_mentions(spark, sf_dir).select("article_id", "symbol", "confidence"), ["article_id", "symbol"]).join(a, "article_id").select("article_id", "symbol", "score", "confidence", "story_id", "published_at", "first_seen_at")


@query(f"WITH {T.FORUM}, t AS (SELECT i AS topic_id, 'Topic ' || i AS topic_title FROM range(4) r(i)) SELECT m.post_id, m.symbol, t.topic_title, s.score FROM post_mentions m JOIN posts p ON p.id = m.post_id LEFT JOIN t ON t.topic_id = p.topic_id LEFT JOIN post_sentiment s ON s.post_id = m.post_id AND s.symbol = m.symbol AND s.model_name = '{T.MODEL}' WHERE m.confidence >= 0.5 AND m.symbol = '3-MEDIUM'")
def linked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's posts with their topic and score, where there are any."""
    t = spark.range(4).select(F.col("id").alias("topic_id"), F.format_string("Topic %d", "id").alias("topic_title"))
    s = T.post_sentiment(spark, sf_dir).where((F.col("model_name") == T.MODEL) & (F.col("symbol") == "3-MEDIUM")).select("post_id", "symbol", "score")
    m = T.post_mentions(spark, sf_dir).where("confidence >= 0.5 and symbol = '3-MEDIUM'").join(T.posts(spark, sf_dir).select(F.col("id").alias("post_id"), "topic_id"), "post_id")
    return m.join(t, "topic_id", "left").join(s, ["post_id", "symbol"], "left").select("post_id", "symbol", "topic_title", "score")


@query(f"WITH {T.NEWS} SELECT DISTINCT story_id, source FROM articles WHERE story_id IN (SELECT a.story_id FROM articles a JOIN article_mentions m ON m.article_id = a.id WHERE m.symbol = '2-HIGH')")
def story_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who carried the stories that one symbol is in."""
    a = T.articles(spark, sf_dir).where("story_id is not null")
    own = a.join(T.article_mentions(spark, sf_dir).where("symbol = '2-HIGH'").select(F.col("article_id").alias("id")), "id", "left_semi").select("story_id").distinct()
    return a.join(own, "story_id", "left_semi").select("story_id", "source").distinct()


@query(f"WITH {T.BARS}, i AS (SELECT symbol, date, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS sma FROM bars WHERE date < DATE '1999-01-01') SELECT b.symbol, b.date, b.close, round(i.sma, 4) AS sma FROM bars b LEFT JOIN i ON i.symbol = b.symbol AND i.date = b.date")
def prices_with_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar, with the indicators that are stored for it."""
    from tessera.operators.series import by_date

    b = T.bars(spark, sf_dir)
    i = b.where("date < date '1999-01-01'").select("symbol", "date", F.round(F.avg("close").over(by_date().rowsBetween(-19, 0)), 4).alias("sma"))
    return b.select("symbol", "date", "close").join(i, ["symbol", "date"], "left")


@query(f"WITH {T.ARTICLES} SELECT coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE source END, '(unknown)') AS source, count(*) AS n FROM articles GROUP BY ALL")
def articles_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select(F.when(F.col("id") % 5 != 0, F.col("source")).alias("source"))
    return a.groupBy(F.coalesce("source", F.lit("(unknown)")).alias("source")).agg(F.count("*").alias("n"))


@query(f"WITH {T.BARS} SELECT s.symbol, coalesce(l.last_date::VARCHAR, 'none') AS last_date FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('9-NEVER')) s(symbol) LEFT JOIN (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol) l ON l.symbol = s.symbol WHERE l.last_date IS NULL OR l.last_date < (SELECT max(date) FROM bars)")
def missing_session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a registry that have no bar of the last session."""
    registry = spark.createDataFrame([(s,) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NEVER")], "symbol string")
    last = T.bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("last_date"))
    out = registry.join(last, "symbol", "left").crossJoin(last.agg(F.max("last_date").alias("session")))
    return out.where("last_date is null or last_date < session").select("symbol", F.coalesce(F.col("last_date").cast("string"), F.lit("none")).alias("last_date"))
