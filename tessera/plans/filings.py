"""Filings and quarterly results: classification, actions, comparisons, validation, keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import fiscal_quarter, months_before, quarter_end
from tessera.operators import sinks
from tessera.sources.tables import table

#: Types in the order of their priority, with what names them.
TYPES = {"results": "quarterly|results|income", "dividend": "dividend|payout", "legal": "licen[sc]e|license|copyright|court", "meeting": "meeting|board|agenda"}


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.concat_ws(" | ", "source", "text")).alias("t"))
    tags = F.array_sort(F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(k)) for k, p in TYPES.items()])))
    kind = F.coalesce(*[F.when(F.col("t").rlike(p), F.lit(k)) for k, p in TYPES.items()], F.lit("other"))
    return d.select("doc_id", kind.alias("filing_type"), F.array_join(tags, ",").alias("filing_tags"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long results: symbol, period_end, metric, value, from the orders of each customer nation and quarter."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    q = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("symbol"), quarter_end(F.col("o_orderdate").cast("date")).alias("period_end"))
    wide = q.agg(F.sum("o_totalprice").alias("revenue"), (F.sum("o_totalprice") - F.avg("o_totalprice") * 3).alias("profit"), F.count("*").cast("double").alias("orders"))
    return wide.unpivot(["symbol", "period_end"], ["revenue", "profit", "orders"], "metric", "value")


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).withColumn("quarter", fiscal_quarter(F.col("period_end")))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the quarter and the year before, by calendar: a missing quarter gives null."""
    r = results(spark, sf_dir)
    q, y = r.toDF("symbol", "q_end", "metric", "q_value"), r.toDF("symbol", "y_end", "metric", "y_value")
    r = r.withColumn("q_end", months_before(F.col("period_end"), 3)).withColumn("y_end", months_before(F.col("period_end"), 12))
    out = r.join(q, ["symbol", "metric", "q_end"], "left").join(y, ["symbol", "metric", "y_end"], "left")
    pct = lambda before: F.when(F.col(before) > 0, F.col("value") / F.col(before) - 1)
    return out.select("symbol", "metric", "period_end", "value", pct("q_value").alias("qoq"), pct("y_value").alias("yoy"), F.col("q_value").alias("previous"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps over 5 times or under a fifth, and changes of sign."""
    c = changes(spark, sf_dir).where("previous is not null and previous <> 0")
    jump = F.when((F.abs(F.col("value") / F.col("previous")) > 5) | (F.abs(F.col("value") / F.col("previous")) < 0.2), "jump")
    sign = F.when(F.col("value") * F.col("previous") < 0, "sign")
    return c.select("symbol", "metric", "period_end", F.concat_ws("; ", jump, sign).alias("flag")).where("flag <> ''")


def last_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = results(spark, sf_dir).groupBy("symbol", "period_end").pivot("metric", ["revenue", "profit", "orders"]).agg(F.first("value"))
    return wide.withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("period_end")))).where("r <= 8")


def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several sources of a quarter the best rank, and of its rows the last file."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("file"), F.col("l_extendedprice").alias("value"))
    rank = F.when(F.col("source") == "A", 0).when(F.col("source") == "R", 1).otherwise(2)
    li = li.withColumn("rank", rank).withColumn("best", F.min("rank").over(W.partitionBy("k")))
    return li.where("rank = best").groupBy("k").agg(F.max(F.struct("file", "value"))["value"].alias("value"), F.max("source").alias("source"))


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation and each of eight quarters: stored or missing. Both sides are small by nature."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("symbol"))
    ends = spark.range(8).select(F.last_day(F.add_months(F.lit("2001-06-30").cast("date"), (F.col("id") * -3).cast("int"))).alias("period_end"))
    have = results(spark, sf_dir).where("metric = 'revenue'").select("symbol", "period_end", F.lit(True).alias("have"))
    return n.crossJoin(ends).join(have, ["symbol", "period_end"], "left").select("symbol", "period_end", F.when(F.col("have"), "stored").otherwise("missing").alias("status"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") * 2).alias("c_acctbal"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored(spark, sf_dir)
    return sinks.upsert(stored, new, ["c_custkey"])


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored(spark, sf_dir)
    return sinks.insert_absent(stored, sinks.conform(new, stored, ["c_custkey"]), ["c_custkey"], ["c_acctbal"])


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored(spark, sf_dir)
    return sinks.delete_keys(stored, new, ["c_custkey"])


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = _stored(spark, sf_dir)
    now = stored.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 1, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return sinks.changed_keys(stored, now, "c_custkey")


QUERIES = {f"filings_{f.__name__}": f for f in (classified, reported, changes, flagged, last_quarters, best_source, checklist, upserted, inserted, deleted, changed)}

_CASES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in TYPES.items())
_R = """w AS (SELECT c_nationkey AS symbol, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS period_end, sum(o_totalprice) AS revenue, sum(o_totalprice) - avg(o_totalprice) * 3 AS profit, count(*)::DOUBLE AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT symbol, period_end, 'revenue' AS metric, revenue AS value FROM w UNION ALL SELECT symbol, period_end, 'profit', profit FROM w UNION ALL SELECT symbol, period_end, 'orders', orders FROM w)"""
_C = f"""{_R}, c AS (SELECT r.symbol, r.metric, r.period_end, r.value, CASE WHEN q.value > 0 THEN r.value / q.value - 1 END AS qoq, CASE WHEN y.value > 0 THEN r.value / y.value - 1 END AS yoy, q.value AS previous
  FROM r LEFT JOIN r q ON q.symbol = r.symbol AND q.metric = r.metric AND q.period_end = last_day(r.period_end - INTERVAL 3 MONTH) LEFT JOIN r y ON y.symbol = r.symbol AND y.metric = r.metric AND y.period_end = last_day(r.period_end - INTERVAL 12 MONTH))"""
_S = "c AS (SELECT c_custkey, c_name, c_acctbal FROM customer), s AS (SELECT * FROM c WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 END AS c_acctbal FROM c WHERE c_custkey % 2 = 0)"
ORACLES = {
    "filings_classified": f"WITH d AS (SELECT doc_id, lower(concat_ws(' | ', source, text)) AS t FROM documents) SELECT doc_id, CASE {_CASES} ELSE 'other' END AS filing_type, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN regexp_matches(t, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, p in TYPES.items())}], lambda x: x IS NOT NULL)), ',') AS filing_tags FROM d",
    "filings_reported": f"WITH {_R} SELECT *, 'FY' || lpad(((year(period_end) + CASE WHEN month(period_end) > 3 THEN 1 ELSE 0 END) % 100)::VARCHAR, 2, '0') || 'Q' || CASE month(period_end) WHEN 3 THEN 4 WHEN 6 THEN 1 WHEN 9 THEN 2 ELSE 3 END AS quarter FROM r",
    "filings_changes": f"WITH {_C} SELECT * FROM c",
    "filings_flagged": f"WITH {_C}, f AS (SELECT symbol, metric, period_end, concat_ws('; ', CASE WHEN abs(value / previous) > 5 OR abs(value / previous) < 0.2 THEN 'jump' END, CASE WHEN value * previous < 0 THEN 'sign' END) AS flag FROM c WHERE previous IS NOT NULL AND previous <> 0) SELECT * FROM f WHERE flag <> ''",
    "filings_last_quarters": f"WITH {_R}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS r FROM w) SELECT * FROM x WHERE r <= 8",
    "filings_best_source": """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS source, l_linenumber AS file, l_extendedprice AS value, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS rank FROM lineitem), b AS (SELECT *, min(rank) OVER (PARTITION BY k) AS best FROM l)
        SELECT k, struct_extract(max({'f': file, 'v': value}), 'v') AS value, max(source) AS source FROM b WHERE rank = best GROUP BY k""",
    "filings_checklist": f"WITH {_R}, e AS (SELECT last_day(DATE '2001-06-30' - to_months(i * 3)) AS period_end FROM range(8) t(i)) SELECT n_nationkey AS symbol, e.period_end, CASE WHEN w.symbol IS NULL THEN 'missing' ELSE 'stored' END AS status FROM nation CROSS JOIN e LEFT JOIN w ON w.symbol = n_nationkey AND w.period_end = e.period_end",
    "filings_upserted": f"WITH {_S} SELECT coalesce(s.c_custkey, n.c_custkey) AS c_custkey, s.c_name, CASE WHEN n.c_custkey IS NULL THEN s.c_acctbal ELSE n.c_acctbal END AS c_acctbal FROM s FULL JOIN n ON s.c_custkey = n.c_custkey",
    "filings_inserted": f"WITH {_S} SELECT * FROM s UNION ALL SELECT c_custkey, NULL, c_acctbal FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM s)",
    "filings_deleted": f"WITH {_S} SELECT * FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM n)",
    "filings_changed": f"WITH {_S} SELECT c_custkey FROM s WHERE c_custkey % 10 = 1 AND c_acctbal <> 0",
}
