"""Features the catalogue declares and events can produce.

Per-entity time scans are partitioned by (entity, time bucket), never by the
entity alone, so one hot entity is spread across tasks:

* ``trailing_count`` copies each row into its own bucket and the next one
  (bucket width = the trailing range), so every row's range lies inside one
  (entity, bucket) partition; each bucket answers only for its own rows.
* ``sessions`` builds sessions inside (entity, day) buckets, then stitches
  only the partial sessions within a gap of a bucket's edge: at most two per
  (entity, day), whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, safe_ratio, seconds_between
from .asof import interval_seconds, time_bucket


def trailing_count(events: DataFrame, range_spec="7 days", entity: str = "entity_id",
                   time: str = "timestamp", out: str = "count_7d") -> DataFrame:
    """For every row, the number of rows of the same entity with
    ``time - range <= t <= time`` (RANGE frame, current row and ties
    included)."""
    width = interval_seconds(range_spec)
    us = width * 1_000_000
    base = events.withColumn("_b", time_bucket(F.col(time), width)) \
        .withColumn("_us", micros(F.col(time)))
    copies = base.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_shift")) \
        .withColumn("_pb", F.col("_b") + F.col("_shift"))
    w = Window.partitionBy(entity, "_pb").orderBy("_us").rangeBetween(-us, 0)
    counted = copies.withColumn(out, F.count(F.lit(1)).over(w))
    return counted.where(F.col("_shift") == 0).drop("_b", "_us", "_shift", "_pb")


def purchase_count_7d(events: DataFrame) -> DataFrame:
    """N2 at every purchase: purchases of the user in the trailing 7 days."""
    p = events.where(F.col("event_type") == "purchase").select("entity_id", "timestamp", "event_id")
    return trailing_count(p, "7 days", out="purchase_count_7d")


def days_since(asof_result: DataFrame, label: str = "label_ts", last: str = "purchase_ts",
               out: str = "last_purchase_days") -> DataFrame:
    """Calendar days between the last event (from the as-of join)
    and the label time; NULL when there is none."""
    return asof_result.withColumn(out, F.datediff(F.to_date(F.col(label)), F.to_date(F.col(last))))


def product_view_stats(products: DataFrame) -> DataFrame:
    """N4/N5 per product: views, purchases and purchases / views (NULL for
    zero views).  Conditional sums are plain partial aggregates."""
    g = products.groupBy("entity_id").agg(
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).cast("long").alias("product_view_count"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("long").alias("purchases"))
    return g.withColumn("product_conversion_rate", safe_ratio(F.col("purchases"), F.col("product_view_count")))


def sessions(events: DataFrame, gap: str = "30 minutes", entity: str = "entity_id",
             time: str = "timestamp", bucket: str = "1 day") -> DataFrame:
    """Sessions per entity; a new session starts when the gap to the
    previous event is longer than ``gap`` (``session_window`` keeps an event
    exactly ``gap`` after the last one in the same session).  Returns entity, session_start, session_end
    (last event), n_events, session_duration_seconds (floor of seconds)."""
    gap_s = interval_seconds(gap)
    b = events.select(entity, time).withColumn("_b", time_bucket(F.col(time), interval_seconds(bucket)))
    # 1. sessions inside (entity, bucket) with Spark's session windows
    part = b.groupBy(entity, "_b", F.session_window(time, f"{gap_s} seconds").alias("sw")).agg(
        F.min(time).alias("s_start"), F.max(time).alias("s_end"), F.count(F.lit(1)).alias("n"))
    # 2. only a partial session within a gap of a bucket's edge can go on in the next bucket; between
    #    two such sessions any other one lies more than a gap away from both
    width = interval_seconds(bucket) * 1_000_000
    near = ((micros(F.col("s_start")) - F.col("_b") * width <= gap_s * 1_000_000)
            | ((F.col("_b") + 1) * width - micros(F.col("s_end")) <= gap_s * 1_000_000))
    # each other one is a group of its own, so all go through one window
    part = part.withColumn("_own", F.when(~near, F.struct("_b", "s_start")))
    w = Window.partitionBy(entity, "_own").orderBy("s_start", "s_end")
    prev_end = F.lag("s_end").over(w)
    flagged = part.withColumn("_new", F.when(
        prev_end.isNull() | (seconds_between(F.col("s_start"), prev_end) > gap_s), 1).otherwise(0))
    sid = flagged.withColumn("_sid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = sid.groupBy(entity, "_own", "_sid").agg(
        F.min("s_start").alias("session_start"), F.max("s_end").alias("session_end"),
        F.sum("n").cast("long").alias("n_events"))
    return out.select(entity, "session_start", "session_end", "n_events",
                      F.floor(seconds_between("session_end", "session_start")).cast("long")
                      .alias("session_duration_seconds"))
