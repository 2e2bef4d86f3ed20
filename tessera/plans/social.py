"""Forum posts and pages: payloads, cleaning, kinds, links, daily sentiment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import posts as P
from tessera.functions import text as X
from tessera.operators.calendar import known_moment, with_session
from tessera.plans import sessions
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("social")
query = AREA.query
KEY = b"key of the tests"
S = T.START


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of posts, made of the conversations."""
    c, k, t = T.table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    html = F.concat(F.lit("<p>"), F.coalesce(F.regexp_replace("text", "[<>&\"\\\\\n\r\t]", " "), F.lit("")), F.lit('</p><aside class="quote">gone</aside><p>see <a href="https://x.example/1">the page</a></p>'))
    post = F.struct(
        (k * 100 + t).alias("id"), t.alias("post_number"), F.when(k % 11 == 0, 3).otherwise(1).alias("post_type"), F.when(k % 13 != 0, html).alias("cooked"), (1 + k % 3).cast("int").alias("version"),
        F.when(k % 7 != 0, F.date_format(F.timestamp_seconds(S + k * 3600 + t * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("created_at"), k.alias("user_id"), F.when(t % 2 == 0, (k % 9).cast("int")).alias("like_count"),
        (k % 17 == 0).alias("hidden"), F.array(F.struct(F.lit(1).alias("id"), F.lit(4).alias("count")), F.struct(F.lit(2).alias("id"), (k % 5).cast("int").alias("count"))).alias("actions_summary"),
    )
    return c.select("conv_id", "turn", F.to_json(post).alias("json"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(spark, sf_dir).withColumn("p", F.from_json("json", P.PAYLOAD))
    p = p.withColumn("raw_html", P.sanitised(F.col("p.cooked"))).withColumn("text", P.own_text(F.col("raw_html")))
    return p.withColumn("skipped", P.skip_reason(F.col("text")))


_PARSED = "p AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, CASE WHEN conv_id % 11 = 0 THEN 'not a regular post' WHEN conv_id % 17 = 0 THEN 'deleted or hidden' WHEN conv_id % 7 = 0 THEN 'no created_at' WHEN conv_id % 13 = 0 THEN 'no text after cleaning' ELSE '-' END AS skipped, CASE WHEN turn % 2 = 0 THEN conv_id % 9 ELSE conv_id % 5 END AS likes FROM conversations)"


@query(f"WITH {_PARSED} SELECT id, skipped, likes FROM p")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payload's id, likes, and why it is not stored."""
    return parsed(spark, sf_dir).select(F.col("p.id").alias("id"), F.coalesce("skipped", F.lit("-")).alias("skipped"), P.likes().cast("long").alias("likes"))


@query(f"WITH {_PARSED} SELECT 'forum:' || id AS id, 'https://forum.example/t/topic/' || conv_id || '/' || turn AS url, {S} + conv_id * 3600 + turn * 60 AS created_at, 32 AS n_hash FROM p WHERE skipped = '-'")
def post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that are stored: keys, moments, authors as keyed hashes."""
    p = parsed(spark, sf_dir).where("skipped is null")
    author = P.author_key(KEY, "forum")(F.col("p.user_id"))
    return p.select(F.format_string("forum:%d", "p.id").alias("id"), F.format_string("https://forum.example/t/topic/%d/%d", F.col("conv_id"), F.col("p.post_number")).alias("url"), F.unix_seconds(F.to_timestamp("p.created_at")).alias("created_at"), F.length(author).alias("n_hash"))


_CLEAN = "regexp_replace(regexp_replace(coalesce(text, ''), '[<>&\"\\\\\n\r\t]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"


@query(f"SELECT conv_id * 100 + turn AS id, trim(trim({_CLEAN}) || chr(10) || 'see ⟦the page⟧', chr(10)) AS text FROM conversations WHERE conv_id % 13 <> 0")
def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poster's own words: quotes gone, links marked, a line for each block."""
    return parsed(spark, sf_dir).where("text is not null").select(F.col("p.id").alias("id"), "text")


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id % 3 AS k, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda w: w <> '')) AS n FROM conversations)
    SELECT id, CASE WHEN k = 0 THEN 'share' WHEN n >= 6 THEN 'opinion' WHEN k = 1 THEN 'share' ELSE 'short' END AS kind FROM c""")
def post_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinions, shared links or headlines, and short replies, by the poster's own words."""
    c, k = T.table(spark, sf_dir, "conversations"), F.col("conv_id") % 3
    own = F.coalesce(F.regexp_replace("text", "[ \t\r\n]+", " "), F.lit(""))
    text = F.when(k == 0, F.lit(f"{P.OPEN}a page{P.SHUT}\nAn old headline of the day - The Gazette")).when(k == 1, F.concat(own, F.lit(f" {P.OPEN}a page{P.SHUT}"))).otherwise(own)
    c = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), P.without_shared(("The Gazette",))(text).alias("s"))
    return c.select("id", P.kind(P.joined_lines(F.col("s.text")), F.col("s.shared")).alias("kind"))


@query("SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 4 = 1 THEN 'edited' WHEN conv_id % 4 = 2 THEN 'recleaned' ELSE 'unchanged' END AS outcome FROM conversations")
def rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second look at a post finds: an edit that the platform reports, a text that only our rules change, or nothing."""
    c, k = T.table(spark, sf_dir, "conversations"), F.col("conv_id") % 4
    edited = P.is_edited(F.when(k < 2, F.lit(2)), F.when(k >= 2, F.lit(5)), F.when(k == 0, F.lit(2)).when(k == 1, F.lit(1)), F.lit(5))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), P.outcome(edited, F.concat(F.coalesce("text", F.lit("")), F.when(k == 2, "x").otherwise("")), F.coalesce("text", F.lit(""))).alias("outcome"))


@query(f"WITH {T.POSTS}, s AS (SELECT topic_id, list_sort(list(post_number)) AS stream, CASE WHEN topic_id % 2 = 0 THEN NULL ELSE 2000 END AS last FROM posts GROUP BY topic_id) SELECT topic_id, unnest(CASE WHEN last IS NULL THEN stream[-10:] ELSE list_filter(stream, lambda i: i > 2000) END) AS post FROM s")
def new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which posts of a topic are to be fetched: after the last stored one, or the newest ten."""
    s = T.posts(spark, sf_dir).groupBy("topic_id").agg(F.array_sort(F.collect_list("post_number")).alias("stream"))
    return s.select("topic_id", F.explode(P.new_ids(F.col("stream"), F.when(F.col("topic_id") % 2 != 0, F.lit(2000)), 10)).alias("post"))


@query(f"WITH {T.ARTICLES} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN text_attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END WHEN id % 3 = 1 THEN 'ok' ELSE 'paywalled' END AS text_status, text_attempts + 1 AS text_attempts FROM articles")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an attempt to fetch a text leaves of it."""
    k = F.col("id") % 3
    return T.articles(spark, sf_dir).select("id", P.next_status(F.when(k == 0, "retry").when(k == 1, "ok").otherwise("paywalled"), F.col("text_attempts") + 1, 3).alias("text_status"), (F.col("text_attempts") + 1).alias("text_attempts"))


@query(r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'failed' WHEN regexp_matches(html, '(?i)paywall') THEN 'paywalled' WHEN length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) < 600 THEN 'retry' ELSE 'ok' END AS outcome FROM pages")
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetched page gives: not a page, paid, too short, or a text."""
    p = T.table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").otherwise("text/html")
    return p.select("page_id", X.page_outcome(kind, F.col("html"), X.without_tags(F.col("html")), "paywall", 600).alias("outcome"))


@query("SELECT doc_id, n_lines FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(?:The|Le|Der)'))) AS n_lines, len(string_split(text, chr(10))) AS n FROM documents) WHERE n_lines < n")
def recleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts that the rules of today change, by the lines that are left."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text", X.without_boilerplate(F.col("text"), "The|Le|Der").alias("clean"))
    changed = d.where(~F.col("clean").eqNullSafe(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: ~F.trim(line).rlike("^(?:The|Le|Der)"))
    return changed.select("doc_id", F.size(lines).cast("long").alias("n_lines"))


_ITEMS = f"""{sessions._K}, {T.FORUM}, it AS (SELECT p.id AS post_id, p.platform, m.symbol, p.author, m.confidence, s.score, p.first_seen_at, make_timestamp(least(p.created_at, p.first_seen_at) * 1000000) + INTERVAL 330 MINUTE AS local, least(p.created_at, p.first_seen_at) AS moment
  FROM post_mentions m JOIN posts p ON p.id = m.post_id LEFT JOIN post_sentiment s ON s.post_id = m.post_id AND s.symbol = m.symbol AND s.model_name = '{T.MODEL}' WHERE m.confidence >= 0.2), items AS (SELECT it.*, {sessions._SESSION} AS session_date FROM it JOIN cal ON cal.day = local::DATE)"""


def linked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked posts with their moment, session, and score if there is one."""
    p = T.posts(spark, sf_dir).select(F.col("id").alias("post_id"), "platform", "author", "created_at", "first_seen_at")
    s = T.post_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).select("post_id", "symbol", "score")
    m = T.post_mentions(spark, sf_dir).where("confidence >= 0.2").join(p, "post_id").join(s, ["post_id", "symbol"], "left")
    return with_session(m.withColumn("moment", known_moment("created_at", "first_seen_at")), "moment", sessions.days(spark, sf_dir), how="inner")


@query(f"WITH {_ITEMS} SELECT post_id, symbol, moment, session_date FROM items")
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_items(spark, sf_dir).select("post_id", "symbol", T.seconds("moment").alias("moment"), "session_date").orderBy(F.desc("moment"))


@query(f"WITH {_ITEMS} SELECT platform, symbol, session_date, count(DISTINCT post_id) AS post_count, count(DISTINCT author) AS author_count, count(score) AS scored_count, round(coalesce(avg(score), 9), 9) AS mean_score, round(coalesce(sum(score * confidence) / sum(CASE WHEN score IS NOT NULL THEN confidence END), 9), 9) AS weighted_score, max(first_seen_at) AS latest FROM items GROUP BY ALL")
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, authors and sentiment by symbol and session; 9 where nothing is scored."""
    i = linked_items(spark, sf_dir)
    weighted = F.try_divide(F.sum(F.col("score") * F.col("confidence")), F.sum(F.when(F.col("score").isNotNull(), F.col("confidence"))))
    return i.groupBy("platform", "symbol", "session_date").agg(F.count_distinct("post_id").alias("post_count"), F.count_distinct("author").alias("author_count"), F.count("score").alias("scored_count"), F.round(F.coalesce(F.avg("score"), F.lit(9.0)), 9).alias("mean_score"), F.round(F.coalesce(weighted, F.lit(9.0)), 9).alias("weighted_score"), F.max(T.seconds("first_seen_at")).alias("latest"))


@query(f"WITH {_ITEMS} SELECT symbol, count(*) FILTER (session_date > DATE '2024-01-03' - 7 AND session_date <= DATE '2024-01-03') AS posts, count(DISTINCT author) FILTER (session_date > DATE '2024-01-03' - 7 AND session_date <= DATE '2024-01-03') AS authors FROM items GROUP BY symbol")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and authors of a week."""
    week = (F.col("session_date") > F.lit("2023-12-27").cast("date")) & (F.col("session_date") <= F.lit("2024-01-03").cast("date"))
    return linked_items(spark, sf_dir).groupBy("symbol").agg(F.count_if(week).alias("posts"), F.count_distinct(F.when(week, F.col("author"))).alias("authors"))


@query(f"WITH {_ITEMS}, d AS (SELECT symbol, session_date, count(DISTINCT post_id) || ' (' || count(DISTINCT author) || ')' AS cell FROM items GROUP BY ALL) SELECT session_date, " + ", ".join(f"coalesce(max(cell) FILTER (symbol = '{s}'), '-') AS s{s[0]}" for s in T.SYMBOLS) + " FROM d GROUP BY session_date")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sessions by symbols, a dash where nobody wrote."""
    d = linked_items(spark, sf_dir).groupBy("symbol", "session_date").agg(F.format_string("%d (%d)", F.count_distinct("post_id"), F.count_distinct("author")).alias("cell"))
    wide = d.groupBy("session_date").pivot("symbol", list(T.SYMBOLS)).agg(F.first("cell"))
    return wide.select("session_date", *[F.coalesce(F.col(f"`{s}`"), F.lit("-")).alias(f"s{s[0]}") for s in T.SYMBOLS])


@query(f"WITH {T.FORUM}, l AS (SELECT m.post_id, CASE WHEN p.topic_id = 1 AND p.created_at < {S} + 400000 THEN 'S1' ELSE m.symbol END AS symbol, CASE WHEN p.topic_id = 1 AND p.created_at < {S} + 400000 THEN 'thread' ELSE 'linker' END AS method, CASE WHEN p.topic_id = 1 AND p.created_at < {S} + 400000 THEN 0.9 WHEN p.topic_id = 2 THEN greatest(m.confidence, 0.6) ELSE m.confidence END::DOUBLE AS confidence FROM post_mentions m JOIN posts p ON p.id = m.post_id) SELECT * FROM l")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post is about its topic's own symbol; where a topic has none any more, about what its text names, and surer in that symbol's own topic."""
    from tessera.operators.linked import linked_posts

    topics = spark.createDataFrame([(1, "S1", S + 400000), (2, "any", None)], "topic_id long, symbol string, until long").withColumn("until", F.timestamp_seconds("until"))
    m = T.post_mentions(spark, sf_dir).select("post_id", "symbol", "confidence").withColumn("by_condition", F.lit(True))
    return linked_posts(T.posts(spark, sf_dir).select(F.col("id").alias("post_id"), "topic_id", "created_at"), m, topics)


@query(f"WITH {_ITEMS}, t AS (SELECT symbol, session_date, post_id, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, post_id) AS hi, row_number() OVER (PARTITION BY symbol ORDER BY score, post_id) AS lo FROM items WHERE score IS NOT NULL) SELECT symbol, post_id, hi <= 3 AS is_high, lo <= 3 AS is_low FROM t WHERE hi <= 3 OR lo <= 3")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most and least positive posts of each symbol."""
    i = linked_items(spark, sf_dir).where("score is not null")
    rank = lambda o: F.row_number().over(W.partitionBy("symbol").orderBy(o, "post_id"))
    i = i.withColumn("hi", rank(F.desc("score"))).withColumn("lo", rank(F.asc("score"))).where("hi <= 3 or lo <= 3")
    return i.select("symbol", "post_id", (F.col("hi") <= 3).alias("is_high"), (F.col("lo") <= 3).alias("is_low"))
