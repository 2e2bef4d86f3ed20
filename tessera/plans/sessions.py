"""Sessions and dates: the trading calendar, what moments count for, quarters and their deadlines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import calendar as C
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("sessions")
query = AREA.query
LOW, HIGH = dt.date(2023, 12, 1), dt.date(2024, 3, 31)
#: A weekday without a session, and the last known one.
HOLIDAY, LAST = "2024-01-17", "2024-01-24"

_K = f"""k AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE isodow(ts::DATE) < 6 AND ts::DATE <= DATE '{LAST}' AND ts::DATE <> DATE '{HOLIDAY}'),
spine AS (SELECT unnest(generate_series(DATE '{LOW}', DATE '{HIGH}', INTERVAL 1 DAY))::DATE AS day),
flags AS (SELECT day, CASE WHEN day BETWEEN (SELECT min(day) FROM k) AND (SELECT max(day) FROM k) THEN day IN (SELECT day FROM k) ELSE isodow(day) < 6 END AS is_session FROM spine),
cal AS (SELECT day, is_session, coalesce((SELECT min(k.day) FROM k WHERE k.day > f.day), (SELECT min(g.day) FROM flags g WHERE g.day > f.day AND g.is_session)) AS next_session,
  coalesce(CASE WHEN day <= (SELECT max(day) FROM k) THEN (SELECT max(k.day) FROM k WHERE k.day < f.day) END, (SELECT max(g.day) FROM flags g WHERE g.day < f.day AND g.is_session)) AS previous_session FROM flags f)"""
_SESSION = "CASE WHEN strftime(local, '%H:%M:%S.%f') > '15:30:00.000000' OR NOT is_session THEN next_session ELSE local::DATE END"


def known_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).where(f"weekday(day) < 5 and day <= date '{LAST}' and day <> date '{HOLIDAY}'").distinct()


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar from LOW to HIGH, as in the SQL: moments of other days have no session, and are left out."""
    return C.clipped(C.calendar(known_days(spark, sf_dir), LOW, HIGH), LOW, HIGH)


@query(f"WITH {_K} SELECT * FROM cal WHERE day BETWEEN DATE '2023-12-15' AND DATE '2024-02-15'")
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).where("day between date '2023-12-15' and date '2024-02-15'")


@query(f"WITH {_K}, e AS (SELECT event_id, event_type, ts + INTERVAL 330 MINUTE AS local FROM events) SELECT event_type, {_SESSION} AS session_date, count(*) AS n FROM e JOIN cal ON cal.day = local::DATE GROUP BY ALL")
def of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the session that they first count for; holidays go to the next one."""
    e = T.table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("moment"))
    return C.with_session(e, "moment", days(spark, sf_dir), how="inner").groupBy("event_type", "session_date").agg(F.count("*").alias("n"))


@query(f"WITH {_K}, e AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS local FROM events), d AS (SELECT event_id, CASE WHEN strftime(local, '%H:%M:%S') >= '16:00:00' THEN local::DATE ELSE local::DATE - 1 END AS day FROM e) SELECT event_id, CASE WHEN is_session THEN cal.day ELSE previous_session END AS session FROM d JOIN cal ON cal.day = d.day")
def latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last session that had closed at some moments."""
    now = T.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    key, closed = C.completed_session("now", days(spark, sf_dir))
    return now.withColumn("day", key).join(closed, "day").select("event_id", "session")


@query(f"WITH {T.ARTICLES} SELECT id, coalesce(least(published_at, first_seen_at), first_seen_at) AS known_at, make_timestamp(coalesce(published_at, first_seen_at) * 1000000)::DATE AS event_date, (make_timestamp(first_seen_at * 1000000) + INTERVAL 330 MINUTE)::DATE AS local_date FROM articles")
def article_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an article became public, its date for rules (UTC) and its date at the exchange."""
    a = T.articles(spark, sf_dir)
    return a.select("id", T.seconds(C.known_moment("published_at", "first_seen_at")).alias("known_at"), F.coalesce("published_at", "first_seen_at").cast("date").alias("event_date"), C.local_day(F.col("first_seen_at")).alias("local_date"))


@query(f"WITH {T.BARS}, d AS (SELECT DISTINCT date FROM bars WHERE date <= DATE '1998-06-30') SELECT date FROM d ORDER BY date DESC LIMIT 12")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).where("date <= date '1998-06-30'").distinct()
    return d.orderBy(F.desc("date")).limit(12)


@query(f"WITH {T.BARS} SELECT symbol, date, close FROM bars WHERE date <= DATE '1999-03-31' AND NOT (open = high AND high = low AND low = close AND volume <= 1)")
def completed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars up to the last completed session, without the flat ones that a provider fills holidays with."""
    b = T.bars(spark, sf_dir).where("date <= date '1999-03-31'")
    return b.where(~dates.is_filler(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume") - 1)).select("symbol", "date", "close")


@query("""WITH t AS (SELECT DISTINCT o_orderdate::DATE AS today FROM orders), q AS (SELECT last_day(DATE '1985-03-31' + to_months(3 * j::INT)) AS period_end FROM range(160) r(j)),
  d AS (SELECT today, period_end, row_number() OVER (PARTITION BY today ORDER BY period_end DESC) AS r FROM t JOIN q ON period_end + 60 <= today) SELECT today, period_end FROM d WHERE r <= 8""")
def last_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight quarters whose results are due, on each day with orders."""
    days = T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("today")).distinct()
    return days.select("today", F.explode(dates.last_quarters(F.col("today"), 8, 60)).alias("period_end"))


@query("SELECT o_orderkey AS k, strftime(CASE WHEN d - e <= 75 THEN e END, '%Y-%m-%d') AS window_quarter FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (date_trunc('quarter', o_orderdate)::DATE - 1) AS e FROM orders)")
def window_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter end whose 75 days of results hold a date."""
    o = T.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), dates.window_quarter(F.col("o_orderdate").cast("date"), 75).cast("string").alias("window_quarter"))


@query(f"WITH {T.RESULTS}, f AS (SELECT symbol, period_end, min(fiscal_quarter) AS fq, string_agg(DISTINCT basis, '+' ORDER BY basis) AS bases, min(filing_id) AS filing_id FROM results GROUP BY ALL) SELECT symbol, period_end, CASE WHEN filing_id % 3 = 0 THEN period_end + 20 WHEN filing_id % 3 = 1 THEN period_end + 30 ELSE period_end + 45 END AS filed_on, fq || ' ' || bases || ' results' || CASE WHEN filing_id % 3 = 2 THEN ' [date approx.]' ELSE '' END AS subject FROM f")
def filing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When results were filed: on the board's date, else on a known one, else 45 days after the quarter, which is said."""
    f = T.results(spark, sf_dir).groupBy("symbol", "period_end").agg(F.min("fiscal_quarter").alias("fq"), F.array_join(F.array_sort(F.collect_set("basis")), "+").alias("bases"), F.min("filing_id").alias("filing_id"))
    board, known = F.when(F.col("filing_id") % 3 == 0, F.date_add("period_end", 20)), F.when(F.col("filing_id") % 3 == 1, F.date_add("period_end", 30))
    filed_on, approximate = dates.filed_on(board, known, F.col("period_end"))
    return f.select("symbol", "period_end", filed_on.alias("filed_on"), F.concat("fq", F.lit(" "), "bases", F.lit(" results"), F.when(approximate, " [date approx.]").otherwise("")).alias("subject"))


@query(f"WITH {T.POSTS}, t AS (SELECT i AS topic_id, 'S' || i AS symbol, {T.START} + i * 200000 AS until FROM range(4) r(i)) SELECT p.id, coalesce(t.symbol, 'none') AS symbol FROM posts p LEFT JOIN t ON t.topic_id = p.topic_id AND p.created_at < t.until")
def default_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's own symbol, for posts before the day from which it no longer has one."""
    t = spark.range(4).select(F.col("id").alias("topic_id"), F.format_string("S%d", "id").alias("symbol"), F.timestamp_seconds(T.START + F.col("id") * 200000).alias("until"))
    out = T.posts(spark, sf_dir).select("id", "topic_id", "created_at").join(t, "topic_id", "left")
    return out.select("id", F.coalesce(F.when(F.col("created_at") < F.col("until"), F.col("symbol")), F.lit("none")).alias("symbol"))


@query(f"WITH {T.BARS}, b AS (SELECT * FROM bars WHERE (date - DATE '1990-01-01') % 17 <> 3), s AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM b GROUP BY symbol), d AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM s) SELECT d.symbol, d.date FROM d WHERE isodow(d.date) < 6 AND NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = d.symbol AND b.date = d.date)")
def missing_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays without a bar between the first and last of each symbol."""
    b = T.bars(spark, sf_dir).where("datediff(date, date '1990-01-01') % 17 <> 3").select("symbol", "date")
    span = b.groupBy("symbol").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return span.where("weekday(date) < 5").join(b, ["symbol", "date"], "left_anti")


@query("SELECT 's' || s_suppkey AS symbol, coalesce(max(l_shipdate)::DATE, DATE '2001-12-31' - 1825) AS start FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND s_suppkey % 3 <> 0 GROUP BY s_suppkey")
def fetch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when each watched symbol's bars are fetched: the last stored date again, or five years back where none is stored."""
    watched = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    stored = T.table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.max("l_shipdate").cast("date").alias("last_date"))
    return watched.join(stored, "k", "left").select(F.format_string("s%d", "k").alias("symbol"), dates.fetch_start(F.col("last_date"), F.lit("2001-12-31").cast("date")).alias("start"))
