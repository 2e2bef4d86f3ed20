"""Input tables, and the tables derived from them that the queries run on, each with its SQL.

The inputs hold neither market data nor articles: symbols, titles, times and states are made of ids by rules, the same in
both languages. Moments are in UTC and leave a query as seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
BENCHMARK = "5-LOW"
START = 1704067200
MODEL = "words"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol, date, open, high, low, close, volume; a symbol's orders of a day are its trades."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))
    return o.groupBy("symbol", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").alias("volume"))


BARS = """bars AS (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY ALL)"""


def pick(values: tuple[str, ...], k: Column) -> Column:
    """values[k], k from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def pick_sql(values: tuple[str, ...], k: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({k})::INT + 1]"


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def seconds(moment: str | Column) -> Column:
    return F.unix_seconds(F.col(moment) if isinstance(moment, str) else moment)


STATES = ("ok", "pending", "failed", "paywalled")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, one for each document: id, title, summary, text, source, url, published_at, first_seen_at, story_id,
    fetched_via, text_status, text_attempts, linked_at."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    words = F.split(F.trim(F.regexp_replace(F.substring("text", 1, 400), "[ \t\r\n]+", " ")), " ")
    seen = START + k * 780 + (k % 5) * 1200 - 600
    return d.select(
        k.alias("id"), F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.when(k % 3 != 0, F.array_join(F.slice(words, 9, 12), " ")).alias("summary"), "text", "source",
        F.format_string("https://host%d.example/a/%d", k % 9, k).alias("url"), F.when(k % 7 != 0, at(START + k * 780)).alias("published_at"), at(seen).alias("first_seen_at"),
        F.when(k % 4 != 0, k - k % 3).alias("story_id"), pick(("feed", "search"), k % 2).alias("fetched_via"), pick(STATES, k % 4).alias("text_status"), (k % 5).alias("text_attempts"),
        F.when(k % 3 != 0, at(seen + 3600)).alias("linked_at"),
    )


ARTICLES = f"""articles AS (SELECT doc_id AS id, array_to_string(w[1:8], ' ') AS title, CASE WHEN doc_id % 3 <> 0 THEN array_to_string(w[9:20], ' ') END AS summary, text, source,
  'https://host' || doc_id % 9 || '.example/a/' || doc_id AS url, CASE WHEN doc_id % 7 <> 0 THEN {START} + doc_id * 780 END AS published_at, {START} + doc_id * 780 + (doc_id % 5) * 1200 - 600 AS first_seen_at,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 3 END AS story_id, {pick_sql(("feed", "search"), "doc_id % 2")} AS fetched_via, {pick_sql(STATES, "doc_id % 4")} AS text_status, doc_id % 5 AS text_attempts,
  CASE WHEN doc_id % 3 <> 0 THEN {START} + doc_id * 780 + (doc_id % 5) * 1200 + 3000 END AS linked_at
  FROM (SELECT *, string_split(trim(regexp_replace(left(text, 400), '[ \\t\\r\\n]+', ' ', 'g')), ' ') AS w FROM documents))"""


def article_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, symbol, location, mention_count, confidence: one or two symbols for each article."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    a = a.withColumn("j", F.explode(F.when(F.col("article_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k, j = F.col("article_id"), F.col("j")
    return a.select("article_id", pick(SYMBOLS, (k + j) % 4).alias("symbol"), pick(("title", "summary", "body"), (k + j) % 3).alias("location"), (1 + k % 4).alias("mention_count"), ((k * 7 + j * 31) % 100 / 100).alias("confidence"))


ARTICLE_MENTIONS = f"""article_mentions AS (SELECT article_id, {pick_sql(SYMBOLS, "(article_id + j) % 4")} AS symbol, {pick_sql(("title", "summary", "body"), "(article_id + j) % 3")} AS location,
  1 + article_id % 4 AS mention_count, ((article_id * 7 + j * 31) % 100) / 100.0::DOUBLE AS confidence
  FROM (SELECT doc_id AS article_id, unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS j FROM documents))"""


def article_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, symbol, model_name, score: the mentions that a model has scored; an older model has scored others."""
    m = article_mentions(spark, sf_dir).select("article_id", "symbol")
    k = F.col("article_id")
    score = ((k * 37 + F.ascii("symbol") * 11) % 201) / 100 - 1
    new = m.where(k % 5 != 0).select("article_id", "symbol", F.lit(MODEL).alias("model_name"), score.alias("score"))
    return new.unionByName(m.where(k % 4 == 0).select("article_id", "symbol", F.lit("older").alias("model_name"), (-score).alias("score")))


_SCORE = "((article_id * 37 + ascii(symbol) * 11) % 201) / 100.0::DOUBLE - 1"
ARTICLE_SENTIMENT = f"""article_sentiment AS (SELECT article_id, symbol, '{MODEL}' AS model_name, {_SCORE} AS score FROM article_mentions WHERE article_id % 5 <> 0
  UNION ALL SELECT article_id, symbol, 'older', -({_SCORE}) FROM article_mentions WHERE article_id % 4 = 0)"""
NEWS = f"{ARTICLES}, {ARTICLE_MENTIONS}, {ARTICLE_SENTIMENT}"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum posts, one for each turn: id, platform, topic_id, post_number, text, author, likes, created_at, first_seen_at,
    linked_at, checked_at, version."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    made = START + k * 3600 + t * 60
    return c.select(
        F.format_string("forum:%d", k * 100 + t).alias("id"), F.lit("forum").alias("platform"), (k % 6).alias("topic_id"), (k * 100 + t).alias("post_number"), "text",
        F.when((k % 5 != 0) | (F.col("role") == "user"), k % 40).alias("author"), F.when(t % 3 != 0, k % 9).alias("likes"), at(made).alias("created_at"), at(made + 600 * (t % 4) - 300).alias("first_seen_at"),
        F.when(k % 3 != 0, at(made + 7200)).alias("linked_at"), F.when(k % 4 != 0, at(made + 86400 * (k % 7))).alias("checked_at"), (1 + k % 2).alias("version"),
    )


POSTS = f"""posts AS (SELECT 'forum:' || (conv_id * 100 + turn) AS id, 'forum' AS platform, conv_id % 6 AS topic_id, conv_id * 100 + turn AS post_number, text, CASE WHEN conv_id % 5 <> 0 OR role = 'user' THEN conv_id % 40 END AS author,
  CASE WHEN turn % 3 <> 0 THEN conv_id % 9 END AS likes, made AS created_at, made + 600 * (turn % 4) - 300 AS first_seen_at, CASE WHEN conv_id % 3 <> 0 THEN made + 7200 END AS linked_at,
  CASE WHEN conv_id % 4 <> 0 THEN made + 86400 * (conv_id % 7) END AS checked_at, 1 + conv_id % 2 AS version FROM (SELECT *, {START} + conv_id * 3600 + turn * 60 AS made FROM conversations))"""
KINDS = ("opinion", "share", "short")


def post_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, symbol, method, confidence, post_kind."""
    p = posts(spark, sf_dir)
    n = F.col("post_number")
    return p.select(F.col("id").alias("post_id"), pick(SYMBOLS, n % 4).alias("symbol"), pick(("thread", "linker"), n % 2).alias("method"), ((F.col("topic_id") * 17 + n * 7) % 100 / 100).alias("confidence"), pick(KINDS, n % 3).alias("post_kind"))


def post_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, symbol, model_name, score of the opinions that a model has scored."""
    n = F.substring("post_id", 7, 20).cast("long")
    return post_mentions(spark, sf_dir).where((n % 5 != 0) & (F.col("post_kind") == "opinion")).select("post_id", "symbol", F.lit(MODEL).alias("model_name"), ((n * 37) % 201 / 100 - 1).alias("score"))


FORUM = f"""{POSTS}, post_mentions AS (SELECT id AS post_id, {pick_sql(SYMBOLS, "post_number % 4")} AS symbol, {pick_sql(("thread", "linker"), "post_number % 2")} AS method,
  ((topic_id * 17 + post_number * 7) % 100) / 100.0::DOUBLE AS confidence, {pick_sql(KINDS, "post_number % 3")} AS post_kind FROM posts),
post_sentiment AS (SELECT post_id, symbol, '{MODEL}' AS model_name, ((post_id[7:]::BIGINT * 37) % 201) / 100.0::DOUBLE - 1 AS score FROM post_mentions WHERE post_id[7:]::BIGINT % 5 <> 0 AND post_kind = 'opinion')"""

#: What filings say, by their number: category, subject, description.
SUBJECTS = (
    ("Board Meeting", "Board Meeting Intimation to consider a bonus issue", ""),
    ("Corporate Action", "Bonus issue in the ratio of 1:4", "The record date is 14 March 2024."),
    ("Corporate Action", "Sub-division of shares", "from face value of Rs. 10 into shares of face value to Rs. 2 each. Ex-date: 5 February 2024."),
    ("Outcome of Board Meeting", "Unaudited financial results for the quarter", ""),
    ("Company Update", "Interim dividend declared", "Record date 20-02-2024"),
    ("Company Update", "Scheme of demerger approved", "two equity shares for every three shares held, record date fixed 12th April, 2024"),
    ("Shareholding", "Shareholding pattern for the quarter", ""),
    ("Company Update", "Credit rating reaffirmed by CRISIL", ""),
    ("Company Update", "Trading window closure", ""),
    ("Analysts/Institutional Investor Meet", "Earnings call transcript", ""),
    ("Press Release", "Media release on the new plant", ""),
    ("Company Update", "Outcome of the Board Meeting: rights issue", "one rights equity share for every five shares, record date: March 1, 2024"),
    ("Company Update", "Buyback of equity shares closes", ""),
    ("General", "Change of address", ""),
    ("Corporate Action", "Bonus shares", "Allotment of three bonus equity shares for every two held"),
    ("Financial Results", "Integrated filing - financials", ""),
)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings, one for each document: id, exchange, symbol, filed_at, first_seen_at, category, subject, description,
    attachment_path, attachment_sha256."""
    k = F.col("doc_id")
    n = k % len(SUBJECTS)
    part = lambda i: F.nullif(pick(tuple(s[i] for s in SUBJECTS), n), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), pick(("NSE", "BSE", "SEC"), k % 3).alias("exchange"), pick(SYMBOLS, (k / len(SUBJECTS)).cast("long") % 4).alias("symbol"), at(START + k * 5400).alias("filed_at"), at(START + k * 5400 + (k % 6) * 3600).alias("first_seen_at"),
        part(0).alias("category"), part(1).alias("subject"), part(2).alias("description"), F.when(k % 3 != 0, F.format_string("files/%d.xml", k)).alias("attachment_path"), F.when(k % 3 != 0, F.sha2("text", 256)).alias("attachment_sha256"),
    )


def _part_sql(i: int) -> str:
    return f"nullif({pick_sql(tuple(s[i] for s in SUBJECTS), f'doc_id % {len(SUBJECTS)}')}, '')"


FILINGS = f"""filings AS (SELECT doc_id AS id, {pick_sql(("NSE", "BSE", "SEC"), "doc_id % 3")} AS exchange, {pick_sql(SYMBOLS, f"(doc_id // {len(SUBJECTS)}) % 4")} AS symbol, {START} + doc_id * 5400 AS filed_at,
  {START} + doc_id * 5400 + (doc_id % 6) * 3600 AS first_seen_at, {_part_sql(0)} AS category, {_part_sql(1)} AS subject, {_part_sql(2)} AS description,
  CASE WHEN doc_id % 3 <> 0 THEN 'files/' || doc_id || '.xml' END AS attachment_path, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS attachment_sha256 FROM documents)"""

TYPES = ("price_move", "results", "news_shift")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts, one for each event: symbol, alert_type, subject, alert_date, severity, text, created_at, sent_at."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int"))
    return e.select(
        pick(SYMBOLS, k % 4).alias("symbol"), pick(TYPES, k % 3).alias("alert_type"), F.format_string("%d:%s", k, F.col("event_type")).alias("subject"), day.alias("alert_date"),
        F.when(F.col("value") > 50, "high").otherwise("normal").alias("severity"), F.format_string("text %d", k).alias("text"), at(START + k).alias("created_at"), F.when(k % 2 == 0, at(START + k + 60)).alias("sent_at"),
    )


ALERTS = f"""alerts AS (SELECT {pick_sql(SYMBOLS, "event_id % 4")} AS symbol, {pick_sql(TYPES, "event_id % 3")} AS alert_type, event_id || ':' || event_type AS subject, DATE '2024-01-01' + (event_id % 30)::INT AS alert_date,
  CASE WHEN value > 50 THEN 'high' ELSE 'normal' END AS severity, 'text ' || event_id AS text, {START} + event_id AS created_at, CASE WHEN event_id % 2 = 0 THEN {START} + event_id + 60 END AS sent_at FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the pipeline: started_at, exit_code, failures (lines)."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").where(k % 25 == 0)
    return e.select(at(START + k * 260).alias("started_at"), (k / 25 % 3).cast("int").alias("exit_code"), F.when(k / 25 % 3 != 0, F.format_string("prices: error %d\nnews: late\n", k)).otherwise("").alias("failures"))


RUNS = f"""runs AS (SELECT {START} + event_id * 260 AS started_at, (event_id // 25 % 3)::INT AS exit_code, CASE WHEN event_id // 25 % 3 <> 0 THEN 'prices: error ' || event_id || chr(10) || 'news: late' || chr(10) ELSE '' END AS failures FROM events WHERE event_id % 25 = 0)"""

#: Corporate actions: symbol, ex-date, type, factor.
ACTIONS = "VALUES ('1-URGENT', DATE '1995-03-01', 'split', 0.5D), ('1-URGENT', DATE '1996-05-20', 'demerger', 0.8D), ('2-HIGH', DATE '1997-01-15', 'bonus', 0.25D)"


def corporate_actions(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {ACTIONS} AS t(symbol, ex_date, action_type, price_factor)")


CORPORATE_ACTIONS = f"corporate_actions AS (SELECT * FROM ({ACTIONS.replace('D)', ')')}) AS t(symbol, ex_date, action_type, price_factor))"


ACTION_KINDS = ("split", "bonus", "demerger")


def stored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded corporate actions, one for each part: symbol, ex_date, action_type, price_factor, note."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(pick(SYMBOLS, k % 4).alias("symbol"), F.date_add(F.lit("2000-01-01").cast("date"), (k * 7 % 2000).cast("int")).alias("ex_date"), pick(ACTION_KINDS, k % 3).alias("action_type"), (1 / (1 + k % 5)).alias("price_factor"), F.when(k % 2 == 0, F.concat(F.lit("part "), k.cast("string"))).alias("note"))


STORED_ACTIONS = f"""stored_actions AS (SELECT {pick_sql(SYMBOLS, "p_partkey % 4")} AS symbol, DATE '2000-01-01' + (p_partkey * 7 % 2000)::INT AS ex_date, {pick_sql(ACTION_KINDS, "p_partkey % 3")} AS action_type, 1 / (1 + p_partkey % 5) AS price_factor,
  CASE WHEN p_partkey % 2 = 0 THEN 'part ' || p_partkey END AS note FROM part)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly results, long: symbol, period_end, basis, metric, fiscal_quarter, value, source, filing_id. A nation's orders of a
    quarter are its business, those of status F its standalone one."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    from tessera.functions.dates import fiscal_quarter, quarter_end

    of = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.format_string("N%d", "c_nationkey").alias("symbol"), quarter_end(F.col("o_orderdate").cast("date")).alias("period_end"), F.explode(F.when(F.col("o_orderstatus") == "F", F.array(F.lit("standalone"), F.lit("consolidated"))).otherwise(F.array(F.lit("consolidated")))).alias("basis"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k"))
    total, k = F.sum(F.round(F.col("p") * 100).cast("long")), F.max("k")
    wide = of.groupBy("symbol", "period_end", "basis").agg((total / 100).alias("revenue"), ((total - 18_000_000 * F.count("*")) / 100).alias("net_profit"), F.count("*").cast("double").alias("eps"), F.when(k % 3 == 0, (k % 500).cast("double")).alias("x:ProfitLossFromDiscontinuedOperationsAfterTax"), k.alias("filing_id"))
    wide = wide.withColumn("source", pick(("xbrl", "sec", "pdf"), F.col("filing_id") % 3)).withColumn("fiscal_quarter", fiscal_quarter(F.col("period_end")))
    keys = ["symbol", "period_end", "basis", "fiscal_quarter", "source", "filing_id"]
    return wide.unpivot(keys, ["revenue", "net_profit", "eps", "x:ProfitLossFromDiscontinuedOperationsAfterTax"], "metric", "value").where("value is not null")


RESULTS = """results AS (SELECT symbol, period_end, basis, x.m AS metric, 'FY' || lpad(((year(period_end) + CASE WHEN month(period_end) > 3 THEN 1 ELSE 0 END) % 100)::VARCHAR, 2, '0') || 'Q' || CASE month(period_end) WHEN 3 THEN 4 WHEN 6 THEN 1 WHEN 9 THEN 2 ELSE 3 END AS fiscal_quarter,
  x.v AS value, ['xbrl', 'sec', 'pdf'][(filing_id % 3)::INT + 1] AS source, filing_id FROM (
    SELECT symbol, period_end, basis, filing_id, unnest([{'m': 'revenue', 'v': total / 100}, {'m': 'net_profit', 'v': (total - 18000000 * n) / 100}, {'m': 'eps', 'v': n::DOUBLE}, {'m': 'x:ProfitLossFromDiscontinuedOperationsAfterTax', 'v': CASE WHEN filing_id % 3 = 0 THEN (filing_id % 500)::DOUBLE END}]) AS x FROM (
      SELECT 'N' || c_nationkey AS symbol, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS period_end, basis,
             sum(round(o_totalprice * 100)::BIGINT) AS total, count(*) AS n, max(o_orderkey) AS filing_id
      FROM (SELECT *, unnest(CASE WHEN o_orderstatus = 'F' THEN ['standalone', 'consolidated'] ELSE ['consolidated'] END) AS basis FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE x.v IS NOT NULL)"""
