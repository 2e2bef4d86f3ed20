"""Alerts on derived data: moves, signals, sentiment shifts, results, actions and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import alerts as A
from tessera.operators import results as R
from tessera.operators import sinks
from tessera.operators.calendar import known_moment, local_day, with_session
from tessera.operators.scoring import by_session
from tessera.plans import entities, market, reports, sessions
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("alerting")
query = AREA.query

_MOVES = f"""{T.BARS}, m AS (SELECT symbol, date, close, close / lag(close) OVER w - 1 AS move, open / lag(close) OVER w - 1 AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
gaps AS (SELECT symbol, date, CASE WHEN gap > 0.6 THEN 'gap_up' ELSE 'gap_down' END AS signal, gap * 100 AS value FROM m WHERE abs(gap) > 0.6 AND symbol <> '{T.BENCHMARK}'),
c AS (SELECT m.symbol, m.date, m.close, m.move, g.signal AS gap_signal, g.value AS gap_value, CASE WHEN coalesce(g.value, m.move) > 0 THEN 1 ELSE -1 END AS direction FROM m LEFT JOIN gaps g ON g.symbol = m.symbol AND g.date = m.date
  WHERE m.symbol <> '{T.BENCHMARK}' AND m.move IS NOT NULL AND (abs(m.move) > 0.5 OR g.signal IS NOT NULL)),
cand AS (SELECT *, count(*) OVER (PARTITION BY date, direction) AS same_way FROM c)"""


def gaps(b: DataFrame) -> DataFrame:
    m = A.day_moves(b).where("abs(gap) > 0.6")
    return m.select("symbol", "date", F.when(F.col("gap") > 0.6, "gap_up").otherwise("gap_down").alias("signal"), (F.col("gap") * 100).alias("value"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.bars(spark, sf_dir).where(F.col("symbol") != T.BENCHMARK)
    return A.candidate_moves(b, gaps(b), 0.5)


@query(f"WITH {_MOVES} SELECT symbol, date, round(move, 8) AS move, coalesce(gap_signal, '-') AS gap_signal, direction, same_way FROM cand")
def candidate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big moves and gaps, which way they go, and how many symbols went that way on the day."""
    return moves(spark, sf_dir).select("symbol", "date", F.round("move", 8).alias("move"), F.coalesce("gap_signal", F.lit("-")).alias("gap_signal"), "direction", "same_way")


@query(f"WITH {T.BARS} SELECT symbol, date, round(open / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 8) AS gap FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) > 1")
def open_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.day_moves(T.bars(spark, sf_dir)).where("gap is not null").select("symbol", "date", F.round("gap", 8).alias("gap"))


RULES = (("gap_up", "Gap up", [1], "not confirmed out of sample"), ("gap_down", "Gap down", [5, 20], None), ("volume_spike", "Volume spike", [5], None))
_STUDY = "VALUES ('gap_up', 1, 302, 'no clear difference'), ('gap_down', 5, 272, 'beats baseline (CI > 0)'), ('gap_down', 20, 12, 'too few events to judge')"


def said(spark: SparkSession) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "signal string, label string, horizons array<int>, status string")
    return A.notes(rules, spark.sql(f"SELECT * FROM {_STUDY} AS t(signal, horizon, n, note)"))


_NOTE = "CASE n % 5 WHEN 0 THEN 'too few events to judge' WHEN 1 THEN 'no clear difference' WHEN 2 THEN 'beats baseline (CI > 0)' WHEN 3 THEN 'worse than baseline (CI < 0)' ELSE 'other' END"
_AT = "w.horizon || ' trading day' || CASE WHEN w.horizon = 1 THEN '' ELSE 's' END"


@query(f"""WITH st AS (SELECT event_type AS signal, (1 + 4 * (event_id % 3))::INT AS horizon, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL), w AS (SELECT DISTINCT event_type AS signal, h AS horizon FROM events, (VALUES (1), (5), (20)) v(h)),
  c AS (SELECT w.signal, w.horizon, CASE WHEN n IS NULL THEN 'no backtest result at ' || {_AT} || ' yet' WHEN n % 5 = 0 THEN 'too few past events to judge (n=' || n || ')' WHEN n % 5 = 1 THEN 'historically no edge vs doing nothing at ' || {_AT} || ' (n=' || n || ')'
    WHEN n % 5 IN (2, 3) THEN 'historically moved ' || CASE WHEN n % 5 = 2 THEN 'further' ELSE 'less' END || ' in the signal''s direction than an average day at ' || {_AT} || ' (n=' || n || '), possibly by chance' ELSE 'n=' || n END AS clause FROM w LEFT JOIN st ON st.signal = w.signal AND st.horizon = w.horizon)
  SELECT signal, 'Backtest (' || upper(signal) || '): ' || string_agg(clause, '; ' ORDER BY horizon) || CASE WHEN length(signal) % 2 = 0 THEN '; not confirmed out of sample' ELSE '' END || '.' AS note FROM c GROUP BY signal""")
def backtest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the past of each kind of event says at three horizons, one of them without results."""
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), (1 + 4 * (F.col("event_id") % 3)).cast("int").alias("horizon"))
    rules = e.select("signal").distinct().select("signal", F.upper("signal").alias("label"), F.array(*[F.lit(h) for h in (1, 5, 20)]).alias("horizons"), F.when(F.length("signal") % 2 == 0, "not confirmed out of sample").alias("status"))
    return A.notes(rules, e.where("horizon < 9").groupBy("signal", "horizon").agg(F.count("*").alias("n")).withColumn("note", F.expr(_NOTE)))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session_date, story_count, article_count, mean_score, weighted_score, strong_negative_stories, latest_first_seen_at."""
    from tessera.plans.store import scored

    s = scored(spark, sf_dir).withColumn("story", F.coalesce("story_id", "article_id")).withColumn("moment", known_moment("published_at", "first_seen_at"))
    s = with_session(s, "moment", sessions.days(spark, sf_dir), how="inner")
    return by_session(s)


_DAILY = f"""{sessions._K}, {T.NEWS}, sc AS (SELECT s.article_id, s.symbol, s.score, m.confidence, coalesce(a.story_id, a.id) AS story, a.first_seen_at, make_timestamp(coalesce(least(a.published_at, a.first_seen_at), a.first_seen_at) * 1000000) + INTERVAL 330 MINUTE AS local
  FROM article_sentiment s JOIN article_mentions m ON m.article_id = s.article_id AND m.symbol = s.symbol JOIN articles a ON a.id = s.article_id WHERE s.model_name = '{T.MODEL}'),
ss AS (SELECT sc.*, {sessions._SESSION} AS session_date FROM sc JOIN cal ON cal.day = local::DATE),
st AS (SELECT symbol, story, min(session_date) AS session_date, avg(score) AS score, max(confidence) AS confidence, count(DISTINCT article_id) AS articles, max(first_seen_at) AS seen FROM ss GROUP BY ALL),
daily AS (SELECT symbol, session_date, count(*) AS story_count, sum(articles)::BIGINT AS article_count, avg(score) AS mean_score, sum(score * confidence) / nullif(sum(confidence), 0) AS weighted_score, count(*) FILTER (score <= -0.5) AS strong_negative_stories, max(seen) AS latest_first_seen_at FROM st GROUP BY ALL)"""


@query(f"WITH {_DAILY} SELECT symbol, session_date, story_count, article_count, round(mean_score, 9) AS mean_score, round(weighted_score, 9) AS weighted_score, strong_negative_stories, latest_first_seen_at FROM daily")
def daily_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment by symbol and session, copies counted as one story, with the last moment that any of it was seen."""
    d = daily(spark, sf_dir)
    return d.withColumns({"mean_score": F.round("mean_score", 9), "weighted_score": F.round("weighted_score", 9), "latest_first_seen_at": T.seconds("latest_first_seen_at")})


@query(f"WITH {_DAILY}, f AS (SELECT symbol, min(session_date) AS first_session FROM daily GROUP BY symbol) SELECT symbol, first_session, (SELECT min((make_timestamp(first_seen_at * 1000000) + INTERVAL 330 MINUTE)::DATE) FROM articles) AS collected_from FROM f")
def news_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which session each symbol has news, and from which day any was collected."""
    began = T.articles(spark, sf_dir).agg(F.min(local_day(F.col("first_seen_at"))).alias("collected_from"))
    return daily(spark, sf_dir).groupBy("symbol").agg(F.min("session_date").alias("first_session")).crossJoin(began)


_AVERAGES = f"""{_DAILY}, e AS (SELECT s.symbol, cal.day FROM (SELECT DISTINCT symbol FROM daily) s, cal WHERE datediff('day', DATE '1970-01-01', cal.day) % 3 = 0),
av AS (SELECT e.symbol, e.day, (SELECT sum(weighted_score * story_count) / sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.day - 7 AND d.session_date <= e.day) AS avg_7,
  (SELECT sum(weighted_score * story_count) / sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.day - 30 AND d.session_date <= e.day) AS avg_30,
  coalesce((SELECT sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.day - 7 AND d.session_date <= e.day), 0)::BIGINT AS stories_7 FROM e)"""


def shift_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day of the calendar, sessions or not."""
    return sessions.days(spark, sf_dir).where(F.col("day").between(sessions.LOW, sessions.HIGH) & F.expr("unix_date(day) % 3 = 0")).select("day", "previous_session")


@query(f"WITH {_AVERAGES} SELECT symbol, day, round(coalesce(avg_7, 9), 9) AS avg_7, round(coalesce(avg_30, 9), 9) AS avg_30, stories_7 FROM av")
def sentiment_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over 7 and 30 days up to every third day, 9 for none."""
    a = A.averages(daily(spark, sf_dir), shift_days(spark, sf_dir))
    return a.select("symbol", "day", F.round(F.coalesce("avg_7", F.lit(9.0)), 9).alias("avg_7"), F.round(F.coalesce("avg_30", F.lit(9.0)), 9).alias("avg_30"), "stories_7")


def shift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = entities.story_items(spark, sf_dir).select(F.lit("2-HIGH").alias("symbol"), "session_date", "title", "source", "score")
    return A.refused(A.news_shifts(daily(spark, sf_dir), shift_days(spark, sf_dir), s, shift=0.004, least=2))


_WINDOWS = """(SELECT sum(weighted_score * story_count) / sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.{day} - 7 AND d.session_date <= e.{day}) AS a7,
  (SELECT sum(weighted_score * story_count) / sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.{day} - 30 AND d.session_date <= e.{day}) AS a30,
  coalesce((SELECT sum(story_count) FROM daily d WHERE d.symbol = e.symbol AND d.session_date > e.{day} - 7 AND d.session_date <= e.{day}), 0) AS n7"""
_SHIFTS = f"""{entities._ITEMS}, st_items AS (SELECT title, source, score, {sessions._SESSION} AS session_date FROM items JOIN cal ON cal.day = local::DATE WHERE score IS NOT NULL), {_DAILY.split(T.NEWS + ", ", 1)[1]},
e AS (SELECT s.symbol, cal.day, cal.previous_session FROM (SELECT DISTINCT symbol FROM daily) s, cal WHERE datediff('day', DATE '1970-01-01', cal.day) % 3 = 0),
now_ AS (SELECT e.*, {_WINDOWS.format(day="day")} FROM e), was_ AS (SELECT e.symbol, e.day, {_WINDOWS.format(day="previous_session")} FROM e),
shifts AS (SELECT n.*, sign(n.a7 - n.a30) AS way FROM now_ n JOIN was_ w ON w.symbol = n.symbol AND w.day = n.day WHERE n.n7 >= 2 AND abs(n.a7 - n.a30) >= 0.004 AND NOT coalesce(w.n7 >= 2 AND abs(w.a7 - w.a30) >= 0.004, false)),
tops AS (SELECT s.day, string_agg('"' || title || '" (' || coalesce(source, 'unknown') || ')', '; ' ORDER BY r) AS heads FROM (SELECT s.day, i.title, i.source, row_number() OVER (PARTITION BY s.day ORDER BY i.score * s.way DESC, i.title) AS r FROM shifts s JOIN st_items i ON i.session_date > s.day - 7 AND i.session_date <= s.day WHERE s.symbol = '2-HIGH') s WHERE r <= 3 GROUP BY s.day)"""


@query(f"WITH {_SHIFTS} SELECT s.symbol, s.day AS alert_date, s.day::VARCHAR || ':news_shift' AS subject, n7::BIGINT AS stories, way > 0 AS positive, CASE WHEN s.symbol = '2-HIGH' THEN coalesce(heads, '') ELSE '' END AS heads FROM shifts s LEFT JOIN tops ON tops.day = s.day")
def news_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First days of a shift, read back from their text: the stories of the week, which way they lean, and the headlines."""
    t = F.col("text")
    return shift_rows(spark, sf_dir).select("symbol", "alert_date", "subject", F.regexp_extract(t, r"\((\d+) stories", 1).cast("long").alias("stories"), F.contains(t, F.lit("more positive")).alias("positive"), F.regexp_extract(t, r"(?s) Top stories: (.*)\.$", 1).alias("heads"))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = T.filings(spark, sf_dir).select("symbol", F.date_sub(local_day(F.col("filed_at")), 9131).alias("date"), "id", "subject")
    return f.groupBy("symbol", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "subject"))), lambda x: x["subject"]), "; ").alias("subjects"))


def price_move_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = T.bars(spark, sf_dir).where(F.col("symbol") == T.BENCHMARK)
    news = daily(spark, sf_dir).withColumn("session_date", F.date_sub("session_date", 9131))
    return A.refused(A.price_moves(moves(spark, sf_dir), bench, news, _filed(spark, sf_dir), said(spark)))


@query(f"""WITH {_MOVES}, {_DAILY}, bm AS (SELECT date, move AS i_move, gap AS i_gap FROM m WHERE symbol = '{T.BENCHMARK}'), nd AS (SELECT symbol, session_date - 9131 AS date, story_count, weighted_score FROM daily), nf AS (SELECT symbol, min(date) AS news_from FROM nd GROUP BY symbol),
  {T.FILINGS}, fl AS (SELECT symbol, (make_timestamp(filed_at * 1000000) + INTERVAL 330 MINUTE)::DATE - 9131 AS date, string_agg(subject, '; ' ORDER BY id) AS subjects FROM filings GROUP BY ALL)
  SELECT c.symbol, c.date AS alert_date, c.date::VARCHAR || ':price_move' AS subject, length(c.symbol || CASE WHEN c.move > 0 THEN ' rose ' ELSE ' fell ' END) AS n_head, c.same_way >= 3 AS wide, bm.i_move IS NULL AS no_index, coalesce(nd.story_count, 0) AS stories, coalesce(c.date >= nf.news_from, false) AS covered, fl.subjects IS NOT NULL AS filed, c.gap_signal IS NOT NULL AS gapped
  FROM cand c LEFT JOIN bm ON bm.date = c.date LEFT JOIN nf ON nf.symbol = c.symbol LEFT JOIN nd ON nd.symbol = c.symbol AND nd.date = c.date LEFT JOIN fl ON fl.symbol = c.symbol AND fl.date = c.date""")
def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on moves, read back from their text: which sentences each of them has."""
    t, a = F.col("text"), price_move_rows(spark, sf_dir)
    has = lambda s: F.contains(t, F.lit(s))
    stories = F.coalesce(F.nullif(F.regexp_extract(t, r"News that session: (\d+) stor", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return a.select("symbol", "alert_date", "subject", F.length(F.regexp_extract(t, r"^(.* (?:rose|fell) )\d", 1)).cast("long").alias("n_head"), has("Market-wide move").alias("wide"), has("No index bar").alias("no_index"), stories.alias("stories"), (~has("No news data for this date")).alias("covered"), has("Filing that day: ").alias("filed"), has("the previous close.").alias("gapped"))


@query(f"WITH {market._FIRED} SELECT symbol, date AS alert_date, date::VARCHAR || ':' || signal AS subject, symbol || ': ' || signal || ' on ' || strftime(date, '%d %b') || ', value ' || printf('%.2f', round(value, 6)) || '.' AS text FROM fired WHERE signal IN ('golden_cross', 'high_52w_breakout')")
def price_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on the signals that are told."""
    return signal_rows(spark, sf_dir).select("symbol", "alert_date", "subject", "text")


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = market.rule_firings(T.bars(spark, sf_dir)).where("signal in ('golden_cross', 'high_52w_breakout')")
    return A.signal_alerts(s, said(spark), F.concat(F.lit("value "), F.format_string("%.2f", F.round("value", 6))), F.col("signal"))


def results_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on results; a filing is seen up to 45 days behind its board date, too late for some."""
    c = R.changes(T.results(spark, sf_dir))
    filed = F.date_add("period_end", (20 + F.col("filing_id") % 10).cast("int"))
    filings = c.groupBy(F.col("filing_id").alias("id"), "symbol").agg(F.max(filed).alias("filed_on")).withColumn("seen_on", F.date_add("filed_on", (F.col("id") % 45).cast("int")))
    return A.results_alerts(filings, c)


_TOLD = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE printf('%+.1f%%', round({0} * 100, 1)) END"


@query(f"""WITH {reports._CHANGES}, last_ AS (SELECT symbol, max(period_end) AS latest FROM ch GROUP BY symbol), own AS (SELECT symbol, filing_id, max(period_end) AS latest, min(basis) AS basis, arg_max(fiscal_quarter, period_end) AS quarter, max(period_end) + 20 + (filing_id % 10)::INT AS filed_on FROM ch GROUP BY symbol, filing_id),
  o AS (SELECT own.*, filed_on + (filing_id % 45)::INT AS seen_on FROM own JOIN last_ USING (symbol, latest))
  SELECT o.symbol, o.filing_id::VARCHAR AS subject, o.seen_on AS alert_date, quarter || ' ' || o.basis AS of_, strftime(filed_on, '%d %b %Y') AS board, round(r.value)::BIGINT AS revenue, {_TOLD.format("r.yoy")} AS revenue_yoy, {_TOLD.format("r.qoq")} AS revenue_qoq, round(p.value)::BIGINT AS profit, {_TOLD.format("p.yoy")} AS profit_yoy, {_TOLD.format("p.qoq")} AS profit_qoq
  FROM o JOIN ch r ON r.symbol = o.symbol AND r.basis = o.basis AND r.period_end = o.latest AND r.metric = 'revenue' JOIN ch p ON p.symbol = o.symbol AND p.basis = o.basis AND p.period_end = o.latest AND p.metric = 'net_profit' WHERE o.filing_id % 45 <= 30""")
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on the results of the latest quarters, read back from their text."""
    t = F.col("text")
    part = lambda p: F.regexp_extract(t, p, 1)
    number = lambda name: F.replace(part(rf"{name} ₹([\d,-]+) cr"), F.lit(","), F.lit("")).cast("long")
    told = lambda name, of: part(rf"{name} ₹[^;]*{of} ([^,)]+)[,)]")
    return results_rows(spark, sf_dir).select("symbol", "subject", "alert_date", part(r": (\S+ \S+) results imported").alias("of_"), part(r"board date ([^)]+)\)").alias("board"), number("revenue").alias("revenue"), told("revenue", "YoY").alias("revenue_yoy"), told("revenue", "QoQ").alias("revenue_qoq"), number("net profit").alias("profit"), told("net profit", "YoY").alias("profit_yoy"), told("net profit", "QoQ").alias("profit_qoq"))


@query(f"WITH {entities._PENDING} SELECT symbol, action_type || ':' || filing_id AS subject, symbol || ': ' || action_type || coalesce(' ' || ratio, '') || ' detected in a filing (ex-date ' || coalesce(ex_date::VARCHAR, 'not stated') || '), status ' || status || '.' AS text FROM pending WHERE status IN ('upcoming', 'undated', 'needs_review')")
def pending_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pending_alerts(entities.pending(spark, sf_dir), F.lit(entities.TODAY)).select("symbol", "subject", "text")


@query(f"WITH {T.RUNS} SELECT 'run:' || started_at AS subject, (make_timestamp(started_at * 1000000) + INTERVAL 330 MINUTE)::DATE AS alert_date, 'update at ' || strftime(make_timestamp(started_at * 1000000) + INTERVAL 330 MINUTE, '%H:%M') || ' failed: ' || array_to_string(list_filter(string_split(failures, chr(10)), lambda x: x <> ''), ', ') || '.' AS text FROM runs WHERE exit_code <> 0")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pipeline_alerts(T.runs(spark, sf_dir)).select("subject", "alert_date", "text")


@query(f"""WITH {T.ALERTS}, {T.RUNS}, d AS (SELECT DISTINCT alert_date AS day FROM alerts WHERE alert_date <= DATE '2024-01-06'), s AS (SELECT DISTINCT symbol FROM alerts), own AS (SELECT symbol, alert_date AS day, string_agg(CASE WHEN severity = 'high' THEN '  [!] ' ELSE '  - ' END || text, chr(10) ORDER BY severity, text) AS lines FROM alerts WHERE alert_type = 'results' GROUP BY ALL),
  b AS (SELECT d.day, string_agg(CASE WHEN lines IS NULL THEN s.symbol || ': quiet day.' ELSE s.symbol || ':' || chr(10) || lines END, chr(10) ORDER BY s.symbol) AS body FROM d CROSS JOIN s LEFT JOIN own ON own.symbol = s.symbol AND own.day = d.day GROUP BY d.day),
  l AS (SELECT *, make_timestamp(started_at * 1000000) + INTERVAL 330 MINUTE AS local FROM runs), r AS (SELECT local::DATE AS day, arg_max(strftime(local, '%H:%M'), started_at) AS hhmm, arg_max(exit_code, started_at) AS code, arg_max(failures, started_at) AS failures FROM l GROUP BY ALL)
  SELECT b.day, 'Digest for ' || strftime(b.day, '%d %b %Y') || chr(10) || body || chr(10) || CASE WHEN code IS NULL THEN 'Pipeline: no run recorded for this day.' WHEN code = 0 THEN 'Pipeline: run at ' || hhmm || ' completed without failures.' ELSE 'Pipeline: run at ' || hhmm || ' had failures: ' || array_to_string(list_filter(string_split(failures, chr(10)), lambda x: x <> ''), ', ') || '.' END AS digest FROM b LEFT JOIN r ON r.day = b.day""")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's digest: a section for each symbol, quiet ones too, and the pipeline's status."""
    a = T.alerts(spark, sf_dir)
    days = a.select(F.col("alert_date").alias("day")).where("day <= date '2024-01-06'").distinct()
    return A.digest(a.where("alert_type = 'results'"), a.select("symbol").distinct(), days, A.pipeline_status(T.runs(spark, sf_dir)))


_BUILT = " UNION ALL ".join(
    f"SELECT {symbol} AS symbol, '{kind}' AS alert_type, subject, {day} AS alert_date, '{severity}' AS severity FROM ({AREA.ORACLES[f'alerting_{name}']}) AS {name}_"
    for name, kind, symbol, day, severity in (
        ("price_moves", "price_move", "symbol", "alert_date", "high"), ("price_signals", "price_signal", "symbol", "alert_date", "normal"), ("news_shifts", "news_shift", "symbol", "alert_date", "normal"),
        ("results", "results", "symbol", "alert_date", "high"), ("pending_actions", "pending_action", "symbol", f"DATE '{entities.TODAY}'", "normal"), ("failed_runs", "pipeline", "'*'", "alert_date", "high"),
    )
)


@query(f"WITH b AS ({_BUILT}), stored AS (SELECT symbol, alert_type, subject FROM b WHERE day(alert_date) % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, alert_type, subject ORDER BY alert_date) AS r FROM b) SELECT symbol, alert_type, subject, alert_date, severity FROM r WHERE r = 1 AND (symbol, alert_type, subject) NOT IN (SELECT (symbol, alert_type, subject) FROM stored)")
def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of all six builders, all days in one job; those that are stored already, on even days, are left out."""
    builders = (price_move_rows, signal_rows, shift_rows, results_rows)
    parts = [b(spark, sf_dir) for b in builders] + [A.pending_alerts(entities.pending(spark, sf_dir), F.lit(entities.TODAY)), A.pipeline_alerts(T.runs(spark, sf_dir))]
    rows = A.refused(reduce(DataFrame.unionByName, parts))
    stored = T.alerts(spark, sf_dir).select(*A.COLUMNS).unionByName(rows.where("day(alert_date) % 2 = 0"))
    return sinks.inserted(stored, rows, ["symbol", "alert_type", "subject"], ["alert_date"]).drop("text")
