"""Extras over the event stream: windows, sessions, as-of joins.  Not part of the audited domain."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.plans.bindings import read
from citeweave.streaming.events import tumbling_counts


def event_tumbling(spark, sf):
    return tumbling_counts(read(spark, sf, "events"), "6 hours")


GAP = 6 * 3_600_000_000  # microseconds


def event_sessions(spark, sf):
    """Sessions of a user: a gap of over six hours begins a new one.

    Events are put in order within a user's day only; the pieces of sessions that days give, of which
    even a busy user has few, are then joined over midnight.
    """
    e = read(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value").withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    order = W.partitionBy("user_id", "day").orderBy("t", "event_id")
    apart = F.coalesce((F.col("t") - F.lag("t").over(order) > GAP).cast("int"), F.lit(1))
    s = e.withColumn("apart", apart).withColumn("s", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    pieces = s.groupBy("user_id", "day", "s").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.min("t").alias("a"), F.max("t").alias("b"))
    order = W.partitionBy("user_id").orderBy("a", "s")
    new = F.coalesce((F.col("a") - F.lag("b").over(order) > GAP).cast("int"), F.lit(1))
    joined = pieces.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return joined.groupBy("user_id", "session").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def event_asof(spark, sf):
    """For each purchase the user's last click before it: sorted within a user's day; where the day has no
    click before it, the last one of the days before.  No range join."""
    e = read(spark, sf, "events").where("event_type IN ('purchase', 'click')").select("user_id", "event_type", "ts", "event_id", F.to_date("ts").alias("day"))
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    last = F.last(click, ignorenulls=True).over(W.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    rows = e.withColumn("same_day", last).where("event_type = 'purchase'")
    days = e.groupBy("user_id", "day").agg(F.max(F.when(click.isNotNull(), F.struct("ts", "event_id")))["event_id"].alias("latest"))
    before = F.last("latest", ignorenulls=True).over(W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    days = days.select(F.col("user_id").alias("u"), F.col("day").alias("d"), before.alias("earlier"))
    met = rows.join(days, F.col("user_id").eqNullSafe(F.col("u")) & F.col("day").eqNullSafe(F.col("d")))
    return met.select("event_id", F.coalesce("same_day", "earlier").alias("click_id"))


_NAMES = "event_tumbling event_sessions event_asof".split()
QUERIES = {n: globals()[n] for n in _NAMES}

ORACLE = {
    "event_tumbling": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "event_sessions": "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY 1, 2",
    "event_asof": "WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events WHERE event_type IN ('purchase', 'click')) SELECT event_id, click_id FROM e WHERE event_type = 'purchase'",
}
