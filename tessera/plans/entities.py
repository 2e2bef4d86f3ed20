"""Companies in texts, stories, and what filings announce."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import linking
from tessera.functions.actions import classified, filing_text
from tessera.functions.linking import Company, Conditional
from tessera.operators import actions, sinks, stories
from tessera.operators.calendar import known_moment, with_session
from tessera.plans import sessions
from tessera.plans.registry import Area
from tessera.sources import tables as T

AREA = Area("entities")
query = AREA.query
#: Names that the texts have: the languages are invented, so that they are common words, as are the words of finance and of market reports.
COMPANIES = [
    Company("ALPHACO", aliases=("that", "und")), Company("BETACO", aliases=("people", "which"), excludes=("the people",)), Company("GAMMACO", aliases=("Hewh of", "de la")),
    Company("DELTACO", ambiguous=("With", "Der", "Que")), Company("EPSCO", conditional=(Conditional(("le", "on"), ("une", "was"), dt.date(2024, 1, 4)),)),
]
FINANCE, MARKET = ("from", "den", "as"), ("The", "El")
_SINCE = "DATE '2024-01-04'"

#: Chunks between blanks with the number of their sentence, tokens of chunks, the names that tokens make, and those that count.
_HITS = rf"""places AS (SELECT id, k AS place, coalesce([title, summary, text][k + 1], '') AS t, length(text) AS body_chars, make_timestamp(coalesce(published_at, first_seen_at) * 1000000)::DATE AS day FROM articles, range(3) AS r(k)),
chunks AS (SELECT id, place, unnest(range(1, len(c) + 1)) AS j, unnest(c) AS chunk FROM (SELECT id, place, regexp_extract_all(t, '\s+|\S+') AS c FROM places)),
near AS (SELECT *, lag(chunk) OVER w AS before, lead(chunk) OVER w AS after FROM chunks WINDOW w AS (PARTITION BY id, place ORDER BY j)),
numbered AS (SELECT id, place, j, chunk, count(*) FILTER (regexp_matches(chunk, '^\s') AND (contains(chunk, chr(10)) OR (regexp_matches(before, '[.!?]$') AND regexp_matches(after, '^[A-Z0-9"''(‘“]')
  AND lower(rtrim(before, '.!?')) NOT IN ('ltd', 'rs', 'co', 'inc', 'corp', 'mr', 'mrs', 'ms', 'dr', 'no', 'vs', 'st')))) OVER (PARTITION BY id, place ORDER BY j) AS sentence FROM near),
toks AS (SELECT id, place, j, sentence, unnest(t) AS tok, j * 100000 + unnest(range(len(t))) AS k FROM (SELECT id, place, j, sentence, regexp_extract_all(chunk, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]') AS t FROM numbered WHERE regexp_matches(chunk, '^\S'))),
pairs AS (SELECT *, lower(tok) AS low, lag(lower(tok)) OVER w AS low_before, j - lag(j) OVER w = 2 AS apart FROM toks WINDOW w AS (PARTITION BY id, place ORDER BY k)),
cand AS (SELECT id, place, k, sentence, unnest([CASE WHEN low IN ('that', 'und') THEN 'ALPHACO' END, CASE WHEN low = 'which' OR (low = 'people' AND NOT (apart AND coalesce(low_before, '') = 'the')) THEN 'BETACO' END,
  CASE WHEN apart AND (low_before, low) IN (('hewh', 'of'), ('de', 'la')) THEN 'GAMMACO' END, CASE WHEN tok IN ('With', 'WITH', 'Der', 'DER', 'Que', 'QUE') THEN 'DELTACO' END, CASE WHEN low IN ('le', 'on') THEN 'EPSCO' END]) AS symbol FROM pairs),
ctx AS (SELECT DISTINCT id, place, sentence, symbol FROM (SELECT *, CASE WHEN regexp_matches(low, '^(from|den|as)(s|es)?$') THEN 'DELTACO' WHEN regexp_matches(low, '^(une|was)(s|es)?$') THEN 'EPSCO' END AS symbol FROM pairs) WHERE symbol IS NOT NULL),
counted AS (SELECT c.id, c.place, c.k, c.symbol, c.symbol IN ('ALPHACO', 'BETACO', 'GAMMACO') OR (c.symbol = 'EPSCO' AND p.day < {_SINCE}) AS strong FROM cand c JOIN places p ON p.id = c.id AND p.place = c.place LEFT JOIN ctx ON ctx.id = c.id AND ctx.place = c.place AND ctx.sentence = c.sentence AND ctx.symbol = c.symbol
  WHERE c.symbol IN ('ALPHACO', 'BETACO', 'GAMMACO') OR ctx.id IS NOT NULL OR (c.symbol = 'EPSCO' AND p.day < {_SINCE})),
report AS (SELECT id, min(k) AS report FROM toks WHERE place = 0 AND tok IN ('The', 'THE', 'El', 'EL') GROUP BY id), titled AS (SELECT id, count(DISTINCT symbol) AS titled FROM counted WHERE place = 0 GROUP BY id),
firsts AS (SELECT id, symbol, min(place) AS place, count(*) AS n FROM counted GROUP BY id, symbol), heres AS (SELECT f.id, f.symbol, f.place, any_value(f.n) AS n, bool_or(c.strong) AS strong, min(c.k) AS k FROM firsts f JOIN counted c ON c.id = f.id AND c.symbol = f.symbol AND c.place = f.place GROUP BY f.id, f.symbol, f.place)"""
_LINKED = f"""{T.ARTICLES}, {_HITS}, linked AS (SELECT h.id, symbol, ['title', 'summary', 'body'][h.place + 1] AS location, n AS mention_count,
  round_even(CASE WHEN h.place = 0 THEN CASE WHEN strong THEN 0.95 ELSE 0.8 END * CASE WHEN report IS NOT NULL AND NOT (titled = 1 AND k < report) THEN 0.5 ELSE 1 END WHEN h.place = 1 THEN CASE WHEN strong THEN 0.75 ELSE 0.65 END
    ELSE CASE WHEN n >= 3 THEN 0.7 WHEN n = 2 OR body_chars < 1500 THEN 0.55 ELSE 0.3 END - CASE WHEN strong THEN 0 ELSE 0.1 END END::DOUBLE, 3) AS confidence
  FROM heres h JOIN (SELECT DISTINCT id, body_chars FROM places) b ON b.id = h.id LEFT JOIN report r ON r.id = h.id LEFT JOIN titled t ON t.id = h.id)"""


def linked(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    a = T.articles(spark, sf_dir).where(where).select("id", "title", "summary", F.col("text").alias("body"), F.coalesce("published_at", "first_seen_at").cast("date").alias("day"))
    return linking.mentions(a, COMPANIES, finance=FINANCE, market=MARKET)


@query(f"WITH {_LINKED} SELECT * FROM linked")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which companies articles name, where, how often, and how sure that is: plain, ambiguous and conditional names, market reports."""
    return linked(spark, sf_dir).select("id", "symbol", "location", "mention_count", "confidence")


@query(f"WITH {_LINKED}, p AS (SELECT id, symbol FROM linked WHERE confidence >= 0.5), e AS (SELECT id, 'ALPHACO' AS symbol FROM articles WHERE id % 2 = 0), b AS (SELECT p.id AS p, e.id AS e FROM p FULL JOIN e ON p.id = e.id AND p.symbol = e.symbol) SELECT count(*) FILTER (p IS NOT NULL AND e IS NOT NULL) / count(p) AS precision, count(*) FILTER (p IS NOT NULL AND e IS NOT NULL) / count(e) AS recall FROM b")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of linking against a labelled set."""
    expected = T.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("ALPHACO").alias("symbol"))
    return linking.quality(linked(spark, sf_dir).where("confidence >= 0.5"), expected, ["id", "symbol"])


@query(f"WITH {_LINKED} SELECT id, symbol, 'ALPHACO' = symbol AS named, regexp_matches(title, '(?i)\\bthat\\b') AS title_has FROM linked JOIN articles USING (id)")
def topic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a title has one of a company's search terms."""
    return linked(spark, sf_dir).select("id", "symbol", (F.col("symbol") == "ALPHACO").alias("named"), linking.names_any(F.col("title"), ("that",)).alias("title_has"))


@query(f"WITH {_LINKED} SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS was_linked, count(*) AS n FROM linked WHERE id % 3 = 0 GROUP BY ALL")
def pending_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only articles that have not been linked are; their mentions replace what was stored for them."""
    return linked(spark, sf_dir, "linked_at is null").groupBy("id").agg(F.count("*").alias("n")).withColumn("was_linked", F.lit(0))


@query()
def scorer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer reads for each mention: the title and up to six sentences that name the company."""
    return linked(spark, sf_dir).where("confidence >= 0.5").select("id", "symbol", linking.scored_text(F.col("title"), F.col("sentences"), 6).alias("text"))


_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9_%]+', ' ', 'g'))"
_PAIRS = f"""{T.ARTICLES}, n AS (SELECT id, source, story_id, coalesce(published_at, first_seen_at) AS t, {_NORM} AS norm FROM articles), w AS (SELECT *, string_split(norm, ' ') AS words, list_filter(string_split(norm, ' '), lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '^(mon|tues|wednes|thurs|fri|satur|sun)day$')) AS keys FROM n),
links AS (SELECT x.id AS a, y.id AS b FROM w x JOIN w y ON x.id < y.id AND abs(x.t - y.t) <= 172800 AND (list_has_all(x.keys, y.keys) OR list_has_all(y.keys, x.keys)) AND
  CASE WHEN least(len(x.words), len(y.words)) >= 6 THEN list_has_all(x.words, y.words) OR list_has_all(y.words, x.words) ELSE array_to_string(list_sort(x.words), ' ') = array_to_string(list_sort(y.words), ' ') END)"""


@query(f"""WITH RECURSIVE {_PAIRS}, both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
    comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a), named AS (SELECT component, coalesce(arg_min(story_id, (t, n.id)) FILTER (story_id IS NOT NULL), arg_min(n.id, (t, n.id))) AS story FROM comp JOIN n ON n.id = comp.id GROUP BY component)
    SELECT comp.id, story AS story_id FROM comp JOIN named USING (component)""")
def story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles into stories by titles that are alike in full, so that SQL can tell them; tests have titles that differ."""
    return stories.grouped(T.articles(spark, sf_dir), similar=100.0)


#: Names that keep titles apart.
FIRMS = {"ALPHACO": stories.company_pattern(["that"]), "DELTACO": stories.company_pattern(["with", "der"])}


@query()
def similar_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles into stories by titles that are alike to 90 per cent; titles that name different companies tell different things."""
    return stories.grouped(T.articles(spark, sf_dir), FIRMS)


@query()
def stories_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental grouping changes."""
    return stories.regrouped(T.articles(spark, sf_dir), similar=95.0)


def story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a story of one symbol: the first value of each column by time, the mean score, the session, other outlets."""
    a = T.articles(spark, sf_dir)
    own = T.article_mentions(spark, sf_dir).where("symbol = '2-HIGH' and confidence >= 0.3").select(F.col("article_id").alias("id"))
    s = T.article_sentiment(spark, sf_dir).where(F.col("model_name") == T.MODEL).where("symbol = '2-HIGH'").select(F.col("article_id").alias("id"), "score")
    of = a.join(own, "id").join(s, "id", "left").withColumn("story", F.coalesce("story_id", "id")).withColumn("moment", known_moment("published_at", "first_seen_at"))
    time = F.struct("moment", "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), time)).alias(c)
    out = of.groupBy("story").agg(*[first(c) for c in ("title", "summary", "source")], F.min("moment").alias("moment"), F.avg("score").alias("score"), F.collect_set("source").alias("own"))
    outlets = a.where("story_id is not null").groupBy(F.col("story_id").alias("story")).agg(F.collect_set("source").alias("all"))
    out = out.join(outlets, "story", "left")
    others = F.size(F.array_remove(F.array_union(F.col("own"), F.coalesce("all", F.array().cast("array<string>"))), F.col("source")))
    return with_session(out.withColumn("more_sources", others), "moment", sessions.days(spark, sf_dir), how="inner")


_ITEMS = f"""{sessions._K}, {T.NEWS}, own AS (SELECT a.*, coalesce(a.story_id, a.id) AS story, coalesce(least(published_at, first_seen_at), first_seen_at) AS moment, s.score FROM articles a JOIN article_mentions m ON m.article_id = a.id AND m.symbol = '2-HIGH' AND m.confidence >= 0.3 LEFT JOIN article_sentiment s ON s.article_id = a.id AND s.symbol = '2-HIGH' AND s.model_name = '{T.MODEL}'),
g AS (SELECT story, arg_min(title, (moment, id)) FILTER (title IS NOT NULL) AS title, arg_min(summary, (moment, id)) FILTER (summary IS NOT NULL) AS summary, arg_min(source, (moment, id)) FILTER (source IS NOT NULL) AS source, min(moment) AS moment, avg(score) AS score, list(DISTINCT source) AS own_ FROM own GROUP BY story),
o AS (SELECT story_id, list(DISTINCT source) AS all_ FROM articles WHERE story_id IS NOT NULL GROUP BY story_id),
items AS (SELECT g.*, len(list_filter(list_distinct(list_concat(own_, coalesce(all_, []))), lambda x: x <> source)) AS more_sources, make_timestamp(moment * 1000000) + INTERVAL 330 MINUTE AS local FROM g LEFT JOIN o ON o.story_id = g.story)"""


@query(f"WITH {_ITEMS} SELECT story, title, summary, source, score, more_sources::INT AS more_sources, moment, {sessions._SESSION} AS session_date FROM items JOIN cal ON cal.day = local::DATE")
def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_items(spark, sf_dir).select("story", "title", "summary", "source", "score", "more_sources", T.seconds("moment").alias("moment"), "session_date").orderBy(F.desc("moment"))


# --- filings -----------------------------------------------------------------------

#: What the filings' subjects come to, by their number: type, tags, action, ratio, factor, record date, ex-date.
_EXPECTED = (
    ("board_meeting", "board_meeting,corporate_action", "", "", "", "", ""), ("corporate_action", "corporate_action", "bonus", "1:4", "0.8", "2024-03-14", "2024-03-14"), ("corporate_action", "corporate_action", "split", "1:5", "0.2", "", "2024-02-05"),
    ("results", "board_meeting,results", "", "", "", "", ""), ("dividend", "dividend", "", "", "", "", ""), ("corporate_action", "corporate_action", "demerger", "2:3", "", "2024-04-12", "2024-04-12"),
    ("shareholding_pattern", "shareholding_pattern", "", "", "", "", ""), ("credit_rating", "credit_rating", "", "", "", "", ""), ("insider_trading", "insider_trading", "", "", "", "", ""), ("analyst_meet", "analyst_meet", "", "", "", "", ""),
    ("press_release", "press_release", "", "", "", "", ""), ("corporate_action", "board_meeting,corporate_action", "rights", "1:5", "", "2024-03-01", "2024-03-01"), ("corporate_action", "corporate_action", "buyback", "", "", "", ""),
    ("other", "other", "", "", "", "", ""), ("corporate_action", "corporate_action", "bonus", "3:2", "0.4", "", ""), ("results", "results", "", "", "", "", ""),
)
_X = f"""{T.FILINGS}, x AS (SELECT * FROM (VALUES {", ".join(str((k, *v)) for k, v in enumerate(_EXPECTED))}) t(k, filing_type, tags, action_type, ratio, factor, record_date, ex_date)),
c AS (SELECT f.*, x.filing_type, x.tags, x.action_type, nullif(x.ratio, '') AS ratio, nullif(x.factor, '')::DOUBLE AS price_factor, nullif(x.record_date, '')::DATE AS record_date, nullif(x.ex_date, '')::DATE AS ex_date FROM filings f JOIN x ON x.k = f.id % {len(_EXPECTED)})"""


@query(f"WITH {_X} SELECT id, filing_type, tags FROM c")
def filing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, tags, _ = classified(filing_text(F.col("category"), F.col("subject"), F.col("description")))
    return T.filings(spark, sf_dir).select("id", kind.alias("filing_type"), F.array_join(tags, ",").alias("tags"))


@query(f"WITH {_X} SELECT id, symbol, filed_at, filing_type FROM c WHERE coalesce(filing_type, 'other') IN ('results', 'dividend') AND (make_timestamp(filed_at * 1000000) + INTERVAL 330 MINUTE)::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-02-10'")
def filings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of some types between two exchange dates, newest first."""
    from tessera.operators.calendar import local_day

    kind, _, _ = classified(filing_text(F.col("category"), F.col("subject"), F.col("description")))
    f = T.filings(spark, sf_dir).where(local_day(F.col("filed_at")).between("2024-01-10", "2024-02-10")).withColumn("filing_type", kind)
    return f.where("filing_type in ('results', 'dividend')").select("id", "symbol", T.seconds("filed_at").alias("filed_at"), "filing_type").orderBy(F.desc("filed_at"))


@query(f"WITH {_X}, m AS (SELECT (make_timestamp(filed_at * 1000000) + INTERVAL 330 MINUTE)::DATE AS date, id, symbol, CASE WHEN id % 2 = 0 THEN 'FY24Q3 results' ELSE 'Results results (date approx.)' END AS label FROM c WHERE filing_type = 'results'), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY id) AS r FROM m) SELECT symbol, date, label FROM r WHERE r = 1")
def results_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark for each day on which results were filed, with the quarter that the subject names."""
    from tessera.operators.calendar import local_day

    kind, _, _ = classified(filing_text(F.col("category"), F.col("subject"), F.col("description")))
    f = T.filings(spark, sf_dir).where(kind == "results").withColumn("subject", F.when(F.col("id") % 2 == 0, "FY24Q3 consolidated results").otherwise("results [date approx.]")).withColumn("date", local_day(F.col("filed_at")))
    quarter = F.coalesce(F.nullif(F.regexp_extract("subject", r"(FY\d{2}Q\d)", 1), F.lit("")), F.lit("Results"))
    label = F.concat(quarter, F.lit(" results"), F.when(F.contains(F.col("subject"), F.lit("[date approx.]")), " (date approx.)").otherwise(""))
    return f.groupBy("symbol", "date").agg(F.min_by(label, "id").alias("label"))


TODAY = dt.date(2024, 3, 5)
#: Bars stand 25 years on, so that they lie around the filings.
SHIFT = 9131
_BARS = f"{T.BARS}, b AS (SELECT symbol, date + {SHIFT} AS date, open, close FROM bars)"
_PENDING = f"""{_BARS}, {_X}, a AS (SELECT * FROM c WHERE action_type <> ''), dated AS (SELECT symbol, action_type, ex_date, min((filed_at, id)) AS first FROM a WHERE ex_date IS NOT NULL GROUP BY ALL),
und AS (SELECT DISTINCT symbol, action_type, make_timestamp(filed_at * 1000000)::DATE AS on_ FROM a WHERE ex_date IS NULL), into_ AS (SELECT u.symbol, u.action_type, arg_min(d.ex_date, d.first) AS into_date FROM und u JOIN dated d ON d.symbol = u.symbol AND d.action_type = u.action_type AND abs(u.on_ - d.ex_date) <= 120 GROUP BY ALL),
m AS (SELECT a.*, coalesce(a.ex_date, i.into_date) AS key_date FROM a LEFT JOIN into_ i ON i.symbol = a.symbol AND i.action_type = a.action_type),
g AS (SELECT symbol, action_type, key_date, arg_min(ratio, (filed_at, id)) FILTER (ratio IS NOT NULL) AS ratio, arg_min(price_factor, (filed_at, id)) FILTER (price_factor IS NOT NULL) AS price_factor, min(ex_date) AS ex_date, arg_min(id, (filed_at, id)) AS filing_id, count(*) AS n_filings FROM m GROUP BY ALL),
gaps AS (SELECT g.symbol, g.ex_date, (SELECT b.open FROM b WHERE b.symbol = g.symbol AND b.date >= g.ex_date ORDER BY b.date LIMIT 1) / (SELECT b.close FROM b WHERE b.symbol = g.symbol AND b.date < g.ex_date ORDER BY b.date DESC LIMIT 1) - 1 AS gap FROM (SELECT DISTINCT symbol, ex_date FROM g WHERE ex_date IS NOT NULL) g),
pending AS (SELECT g.*, CASE WHEN action_type = 'buyback' THEN 'no_adjustment' WHEN g.ex_date IS NULL THEN 'undated' WHEN g.symbol = '2-HIGH' AND abs(g.ex_date - DATE '2024-02-07') <= 3 THEN 'recorded' WHEN g.ex_date > DATE '{TODAY}' THEN 'upcoming' WHEN gap IS NULL OR abs(gap) >= 0.1 THEN 'needs_review' ELSE 'adjusted' END AS status FROM g LEFT JOIN gaps ON gaps.symbol = g.symbol AND gaps.ex_date = g.ex_date)"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced actions with their status."""
    bars = T.bars(spark, sf_dir).withColumn("date", F.date_add("date", SHIFT))
    known = spark.createDataFrame([("2-HIGH", dt.date(2024, 2, 7))], "symbol string, ex_date date")
    return actions.with_status(actions.gathered(actions.announced(T.filings(spark, sf_dir))), known, bars, TODAY)


@query(f"WITH {_X} SELECT id, symbol, action_type, coalesce(ratio, '-') AS ratio, round(coalesce(price_factor, 0), 6) AS price_factor, coalesce(record_date::VARCHAR, '-') AS record_date, coalesce(ex_date::VARCHAR, '-') AS ex_date FROM c WHERE action_type <> ''")
def announced_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio, factor and dates of every action that a filing decides."""
    a = actions.announced(T.filings(spark, sf_dir))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return a.select("id", "symbol", "action_type", text("ratio"), F.round(F.coalesce("price_factor", F.lit(0.0)), 6).alias("price_factor"), text("record_date"), text("ex_date"))


@query(f"WITH {_PENDING} SELECT symbol, action_type, coalesce(ratio, '-') AS ratio, coalesce(ex_date::VARCHAR, '-') AS ex_date, filing_id, n_filings, status, left(sha256(symbol || '|' || action_type || '|' || coalesce(ex_date::VARCHAR, filing_id::VARCHAR)), 32) AS id FROM pending")
def pending_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions gathered from all their filings, and whether they are known, upcoming or visible in prices."""
    p = pending(spark, sf_dir)
    return p.select("symbol", "action_type", F.coalesce("ratio", F.lit("-")).alias("ratio"), F.coalesce(F.col("ex_date").cast("string"), F.lit("-")).alias("ex_date"), "filing_id", "n_filings", "status", actions.action_id(F.col("symbol"), F.col("action_type"), F.col("ex_date"), F.col("filing_id")).alias("id"))


@query(f"WITH {_X} SELECT id, filing_type, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS changed FROM c WHERE id % 4 = 0")
def types_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filings classified again; the rows whose stored type differs."""
    kind, _, _ = classified(filing_text(F.col("category"), F.col("subject"), F.col("description")))
    f = T.filings(spark, sf_dir).withColumn("filing_type", kind)
    stored = f.select("id", F.when(F.col("id") % 4 != 0, F.col("filing_type")).alias("filing_type"))
    new = sinks.update(stored, f.select("id", "filing_type"), ["id"])
    old = stored.withColumnRenamed("filing_type", "was")
    return new.join(old, "id").where(~F.col("was").eqNullSafe(F.col("filing_type"))).select("id", "filing_type", F.lit(1).alias("changed"))
