"""Reports for people: sentiment by session, headlines, URLs and texts in one form, counts of signals as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions.text import TRACKING
from tessera.plans import alerting, market
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("overview")
query = AREA.query


@query(f"WITH {alerting._DAILY}, l AS (SELECT DISTINCT session_date FROM daily ORDER BY session_date DESC LIMIT 7) SELECT session_date, " + ", ".join(f"coalesce(max(printf('%.2f', round(weighted_score, 6)) || ' (' || story_count || ')') FILTER (symbol = '{s}'), '-') AS s{s[0]}" for s in T.SYMBOLS) + " FROM daily JOIN l USING (session_date) GROUP BY session_date")
def sentiment_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven sessions by symbols: score and stories, a dash for none."""
    d = alerting.daily(spark, sf_dir).select("symbol", "session_date", F.format_string("%.2f (%d)", F.round("weighted_score", 6), "story_count").alias("cell"))
    last = d.select("session_date").distinct().orderBy(F.desc("session_date")).limit(7)
    wide = d.join(last, "session_date", "left_semi").groupBy("session_date").pivot("symbol", list(T.SYMBOLS)).agg(F.first("cell"))
    return wide.select("session_date", *[F.coalesce(F.col(f"`{s}`"), F.lit("-")).alias(f"s{s[0]}") for s in T.SYMBOLS])


@query(f"WITH {T.NEWS}, s AS (SELECT a.title, x.symbol, x.score, row_number() OVER (PARTITION BY a.title, x.symbol ORDER BY x.score, a.id) AS d FROM article_sentiment x JOIN articles a ON a.id = x.article_id WHERE model_name = '{T.MODEL}'), u AS (SELECT title, symbol, score, row_number() OVER (ORDER BY score, title, symbol) AS lo, row_number() OVER (ORDER BY score DESC, title, symbol) AS hi FROM s WHERE d = 1) SELECT title, symbol, round(score, 6) AS score, lo <= 5 AS lowest FROM u WHERE lo <= 5 OR hi <= 5")
def extreme_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most and least positive headlines, each title and symbol once."""
    a = T.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "title")
    s = T.article_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).join(a, "article_id").groupBy("title", "symbol").agg(F.min("score").alias("score"))
    low = s.orderBy("score", "title", "symbol").limit(5).withColumn("lowest", F.lit(True))
    high = s.orderBy(F.desc("score"), "title", "symbol").limit(5).withColumn("lowest", F.lit(False))
    return low.unionByName(high).select("title", "symbol", F.round("score", 6).alias("score"), "lowest")


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), c AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS q FROM b) SELECT page_id, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || '%20' AS url FROM c""")
def exact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with their queries decoded and encoded again."""
    return T.table(spark, sf_dir, "pages").select("page_id", F.concat(urls.exact_url(F.col("url")), F.lit("%20")).alias("url"))


@query("SELECT doc_id, 'A & B <c> ' || doc_id AS text FROM documents WHERE doc_id % 3 <> 0")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 != 0, F.format_string("<p>A &amp; B<br>&lt;c&#62;\n  %d</p>", "doc_id")).otherwise("<p> </p>")
    return d.select("doc_id", urls.clean_text(text).alias("text")).where("text is not null")


@query(f"WITH {market._FIRED} SELECT signal || ': ' || count(*) || ' in ' || count(DISTINCT symbol) || ' symbols, ' || count(DISTINCT year(date)) || ' years' AS line FROM fired GROUP BY signal")
def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each signal."""
    f = market.rule_firings(T.bars(spark, sf_dir)).groupBy("signal").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("s"), F.count_distinct(F.year("date")).alias("y"))
    return f.select(F.format_string("%s: %d in %d symbols, %d years", "signal", "n", "s", "y").alias("line"))


@query(f"WITH {T.BARS}, y AS (SELECT symbol, year(date) AS year, sum(volume) AS volume FROM bars GROUP BY ALL) SELECT coalesce(symbol, 'all') AS symbol, coalesce(year, 0) AS year, sum(volume)::BIGINT AS volume FROM y GROUP BY ROLLUP (symbol, year)")
def volume_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes by symbol and year, with totals."""
    b = T.bars(spark, sf_dir).rollup("symbol", F.year("date").alias("year")).agg(F.sum("volume").alias("volume"))
    return b.select(F.coalesce("symbol", F.lit("all")).alias("symbol"), F.coalesce("year", F.lit(0)).alias("year"), "volume")


@query(f"WITH {T.BARS}, r AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) SELECT symbol, date, close FROM r WHERE r <= 3")
def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.bars(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"))))
    return b.where("r <= 3").select("symbol", "date", "close")


@query(f"WITH {market._FIRED} SELECT date, signal, direction, round(value, 6) AS value FROM fired WHERE symbol = '2-HIGH'")
def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's signals; the symbol's filter reaches the scan."""
    s = market.rule_firings(T.bars(spark, sf_dir).where("symbol = '2-HIGH'"))
    return s.select("date", "signal", "direction", F.round("value", 6).alias("value")).orderBy("date", "signal")
