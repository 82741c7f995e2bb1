"""History upkeep jobs: hourly rollup, its incremental refresh, retention,
compaction, statistics (A6, H3-H6).  The jobs take ``as_of`` as an argument;
an external scheduler calls them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import add_hours, hour_of, ts_lit
from .writes import last_writer_wins, with_day


def hourly_rollup(values: DataFrame) -> DataFrame:
    """Per (feature, entity, hour): update_count, last_update."""
    return values.groupBy("feature_id", "entity_id",
                          hour_of(F.col("event_ts")).alias("hour")) \
        .agg(F.count(F.lit(1)).alias("update_count"), F.max("event_ts").alias("last_update"))


def refresh_window(as_of, start_offset_hours: int = 3, end_offset_hours: int = 1):
    """Whole hour buckets inside ``[as_of - start, as_of - end]``."""
    t = ts_lit(as_of)
    lo = add_hours(t, -start_offset_hours)
    hi = add_hours(t, -end_offset_hours)
    first = F.when(hour_of(lo) == lo, lo).otherwise(add_hours(hour_of(lo), 1))
    return first, hour_of(hi)


def refresh_rollup(rollup: DataFrame, values: DataFrame, as_of,
                   start_offset_hours: int = 3, end_offset_hours: int = 1) -> DataFrame:
    """H5: recompute only the whole buckets inside the refresh window and
    replace those buckets in the rollup; everything else is kept."""
    first, last_end = refresh_window(as_of, start_offset_hours, end_offset_hours)
    v = values.where((F.col("event_ts") >= first) & (F.col("event_ts") < last_end))
    if "dt" in values.columns:
        v = v.where((F.col("dt") >= F.to_date(first)) & (F.col("dt") <= F.to_date(last_end)))
    fresh = hourly_rollup(v)
    kept = rollup.where(~((F.col("hour") >= first) & (F.col("hour") < last_end)))
    return kept.unionByName(fresh)


# --- H5 by invalidation: buckets that a write touched, whenever they lie -----------------------------
BUCKET = ["feature_id", "entity_id", "hour"]


def with_hour_folder(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("dt", F.to_date("hour")).withColumn("hh", F.extract(F.lit("HOUR"), F.col("hour")).cast("int"))


def write_rollup(rollup: DataFrame, path: str) -> None:
    """The rollup by day and hour; only the hours present in ``rollup`` are replaced."""
    r = with_hour_folder(rollup)
    (r.hint("rebalance", "dt", "hh").sortWithinPartitions("dt", "hh", *BUCKET[:2]).write.mode("overwrite")
     .option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "hh").parquet(path))


def log_invalidations(updates: DataFrame, path: str, run: int) -> None:
    """Note the (feature, entity, hour) buckets that the rows written by ``run`` touch; a run that is repeated
    replaces its notes.  To be called with the rows that an upsert or a deletion takes."""
    touched = updates.where(F.col("event_ts").isNotNull()).select(
        "feature_id", "entity_id", hour_of(F.col("event_ts")).alias("hour")).distinct()
    (touched.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


def invalidations(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """The touched buckets noted by the runs after ``after``."""
    rows = spark.read.schema("feature_id int, entity_id string, hour timestamp_ntz, run int").parquet(path)
    return (rows if after is None else rows.where(F.col("run") > after)).select(*BUCKET).distinct()


def refresh_invalidated(rollup: DataFrame, values: DataFrame, touched: DataFrame, as_of=None,
                        end_offset_hours: int = 1) -> DataFrame:
    """H5: the rows of the touched hours after a recount of the touched buckets, for ``write_rollup``.  ``rollup``
    and ``values`` are the stored tables (by hour and by day): other hours of the rollup and other days of the
    history are not read.  With ``as_of``, hours that end after ``as_of`` less the offset are left for a later run."""
    if as_of is not None:
        touched = touched.where(F.col("hour") < hour_of(add_hours(ts_lit(as_of), -end_offset_hours)))
    touched = with_hour_folder(touched)
    recount = (values.join(touched.select("dt").distinct(), "dt", "left_semi")
               .withColumn("hour", hour_of(F.col("event_ts"))).join(touched.select(*BUCKET), BUCKET, "left_semi"))
    kept = (rollup.join(touched.select("dt", "hh").distinct(), ["dt", "hh"], "left_semi")
            .join(touched.select(*BUCKET), BUCKET, "left_anti"))
    fresh = hourly_rollup(recount)
    return kept.select(*fresh.columns).unionByName(fresh)


def cutoff_day(as_of, days: int) -> str:
    """The first day that retention keeps."""
    return str(datetime.date.fromisoformat(str(as_of)[:10]) - datetime.timedelta(days))


def retain(values: DataFrame, as_of, days: int = 90) -> DataFrame:
    """H3: drop whole days older than the horizon (a day partition goes once
    its end is at or before ``as_of - days``); the straddling day stays."""
    cutoff_day = F.to_date(F.timestamp_add("DAY", F.lit(-days), ts_lit(as_of)))
    day = F.col("dt") if "dt" in values.columns else F.to_date("event_ts")
    return values.where(day >= cutoff_day)


def compact(values: DataFrame, as_of, days: int = 7,
            keys=("feature_id", "entity_id", "event_ts"), seq: str = "write_seq") -> DataFrame:
    """H4: days older than ``as_of - days`` are rewritten with the upsert
    view applied (one row per key); newer days are left as appended.  Write
    the result with ``writes.write_history`` to a new directory."""
    cutoff_day = F.to_date(F.timestamp_add("DAY", F.lit(-days), ts_lit(as_of)))
    day = F.col("dt") if "dt" in values.columns else F.to_date("event_ts")
    old = values.where(day < cutoff_day)
    recent = values.where(day >= cutoff_day)
    return last_writer_wins(old, keys, seq).select(*values.columns).unionByName(recent)


def compact_days(history: DataFrame, as_of, last_run=None, days: int = 7,
                 keys=("feature_id", "entity_id", "event_ts"), seq: str = "write_seq") -> DataFrame:
    """H4 on the stored history: the compacted rows of the days that became older than ``days`` since
    the run at ``last_run`` (all old days without it).  Only their partitions are read and shuffled;
    ``write_history`` replaces just those.  A day written to after its compaction needs a run whose
    ``last_run`` lies before it."""
    history = history if "dt" in history.columns else with_day(history)

    def cutoff(t):
        return F.to_date(F.timestamp_add("DAY", F.lit(-days), ts_lit(t)))

    due = history.where(F.col("dt") < cutoff(as_of))
    if last_run is not None:
        due = due.where(F.col("dt") >= cutoff(last_run))
    return last_writer_wins(due, keys, seq).select(*history.columns)


def analyze(spark: SparkSession, table: str) -> None:
    """H6: column statistics for the cost-based optimizer (catalog tables)."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def column_statistics(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """(column, num_nulls, min, max, n_rows) as the catalog has them after ``analyze``; texts."""
    size = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    n_rows = int(size["Statistics"].split(",")[-1].split()[0])
    rows = []
    for c in columns:
        d = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} {c}").collect()}
        rows.append((c, int(d["num_nulls"]), d["min"], d["max"], n_rows))
    return spark.createDataFrame(rows, "column string, num_nulls bigint, min string, max string, n_rows bigint")
