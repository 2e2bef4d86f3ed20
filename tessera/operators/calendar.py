"""Trading days: known sessions, weekdays beyond them, and the session that a moment first counts for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
CLOSE = "15:30:00"
#: Days beyond either end of what is asked for, so that a session lies there.
MARGIN = 14


def calendar(known: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
    """day, is_session, next_session, previous_session for each day from low to high.

    known: day, the sessions that have happened. Between the first and last of them they are the sessions; outside,
    Monday to Friday are. One row a day, so that the windows here run over a table that years bound."""
    spark = known.sparkSession
    known = known.select(F.col("day").cast("date").alias("day")).where("day is not null").distinct()
    ends = known.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = spark.sql(f"SELECT explode(sequence(date'{low}' - {MARGIN}, date'{high}' + {MARGIN})) AS day")
    days = days.join(known.withColumn("is_known", F.lit(True)), "day", "left").crossJoin(ends)
    inside = F.coalesce(F.col("day").between(F.col("first"), F.col("last")), F.lit(False))
    days = days.withColumn("is_session", F.when(inside, F.col("is_known").isNotNull()).otherwise(F.weekday("day") < 5))
    after, before = W.orderBy("day").rowsBetween(1, W.unboundedFollowing), W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    which = lambda flag: F.when(F.col(flag), F.col("day"))
    next_ = F.coalesce(F.min(which("is_known")).over(after), F.min(which("is_session")).over(after))
    previous = F.coalesce(F.when(F.col("day") <= F.col("last"), F.max(which("is_known")).over(before)), F.max(which("is_session")).over(before))
    # A known session beyond the days that are asked for is the next one too.
    next_ = F.when(F.col("day") < F.col("first"), F.coalesce(F.least(next_, F.col("first")), next_)).otherwise(next_)
    return days.select("day", "is_session", next_.alias("next_session"), previous.alias("previous_session"))


def local_day(moment: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(moment, zone).cast("date")


def clipped(days: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
    """A calendar of the days from low to high alone: sessions beyond them are not known, and null."""
    inside = lambda c: F.when(F.col(c).between(F.lit(low), F.lit(high)), F.col(c))
    return days.where(F.col("day").between(F.lit(low), F.lit(high))).withColumns({c: inside(c) for c in ("next_session", "previous_session")})


def with_session(rows: DataFrame, moment: str, days: DataFrame, zone: str = ZONE, close: str = CLOSE, name: str = "session_date", how: str = "left") -> DataFrame:
    """rows with the session their moment first counts for: after the close, or on a day without a session, it is the next one.
    days: a calendar that has the moments' days. how: "inner" leaves out rows whose day it has not; else they stay without a session."""
    local = F.from_utc_timestamp(F.col(moment), zone)
    of = rows.withColumn("_day", local.cast("date")).withColumn("_late", F.date_format(local, "HH:mm:ss.SSSSSS") > f"{close}.000000")
    days = days.select(F.col("day").alias("_day"), "is_session", "next_session")
    session = F.when(F.col("_late") | ~F.col("is_session"), F.col("next_session")).when(F.col("is_session"), F.col("_day"))
    return of.join(days, "_day", how).withColumn(name, session).drop("_day", "_late", "is_session", "next_session")


def known_moment(published: str, seen: str) -> Column:
    """When something became public: when it says so, unless that is missing or later than it was seen."""
    return F.least(F.col(published), F.col(seen))


def completed_session(now: str, days: DataFrame, zone: str = ZONE, close: str = "16:00:00") -> tuple[Column, DataFrame]:
    """The join key (local day) and the table of what `now` on that day gives: the day itself once it has closed, else the session before."""
    local = F.from_utc_timestamp(F.col(now), zone)
    return F.when(F.date_format(local, "HH:mm:ss") >= close, local.cast("date")).otherwise(F.date_sub(local.cast("date"), 1)), days.select("day", F.when(F.col("is_session"), F.col("day")).otherwise(F.col("previous_session")).alias("session"))
