"""History writes: upsert, insert-ignore, day-partitioned layout.

Files are immutable, so a mutable key is an append log plus a read-side
``max_by`` view; compaction (``upkeep.compact``) rewrites old partitions.
Never read and overwrite one path in one job: write a new directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def last_writer_wins(rows: DataFrame, keys, seq: str = "write_seq") -> DataFrame:
    """X2/U1 view: one row per key, the one with the highest ``seq``.
    ``max_by`` aggregates partially, so duplicates of a hot key collapse
    before the shuffle."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")) \
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_writer_wins(rows: DataFrame, keys, seq: str = "write_seq") -> DataFrame:
    """X2/U2 view: one row per key, the one with the lowest ``seq``."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("r")) \
        .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(history: DataFrame, updates: DataFrame, keys, seq: str = "write_seq") -> DataFrame:
    """``INSERT .. ON CONFLICT DO UPDATE``.  An update replaces the stored
    row of its key whatever the order numbers say; within the updates the last
    row in write order wins.  Missing metadata becomes ``{}``.  An empty update
    is a no-op; applying the same update twice equals applying it once."""
    new = updates.select(*history.columns)
    if "metadata" in new.columns:
        new = new.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ranked = both.withColumn("_rank", F.struct("_new", seq))
    return last_writer_wins(ranked, keys, "_rank").select(*history.columns)


def upsert_days(history: DataFrame, updates: DataFrame, keys, seq: str = "write_seq",
                ts_col: str = "event_ts") -> DataFrame:
    """U1 on the stored history: the rows of the touched days alone, after the
    upsert.  The join on ``dt`` prunes the day partitions that no update
    touches, and ``write_history`` replaces just those days.  The keys hold
    ``ts_col``, so a key never leaves its day."""
    if ts_col not in keys:
        raise ValueError(f"the keys must hold {ts_col}")
    new = with_day(updates, ts_col)
    days = new.select("dt").distinct()
    return upsert(history.join(days, "dt", "left_semi").select(*history.columns), new, keys, seq)


def insert_ignore(target: DataFrame, rows: DataFrame, keys, seq: str = "write_seq") -> DataFrame:
    """``INSERT .. ON CONFLICT DO NOTHING``: the first writer of a key
    wins; rows whose key already exists are dropped."""
    keys = list(keys)
    fresh = first_writer_wins(rows.select(*target.columns), keys, seq)
    return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))


def with_day(values: DataFrame, ts_col: str = "event_ts") -> DataFrame:
    return values.withColumn("dt", F.to_date(F.col(ts_col)))


def write_history(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """U8: Parquet (zstd) partitioned by day and feature.  A ``rebalance`` on both lets AQE split a big (hot)
    day of a feature into advisory-size tasks and coalesce small ones, so file sizes follow the data, not a fixed
    partition count.  Reads of a few features prune by path, with dynamic pruning where the features come from the
    registry.  Files are sorted by (entity, time) and carry Bloom filters of the entity beside its min and max, so
    lookups of a few entities skip row groups.  ``mode='overwrite'`` replaces only the (day, feature) folders present
    in ``values``, whatever the session's overwrite mode."""
    v = values if "dt" in values.columns else with_day(values)
    (v.hint("rebalance", "dt", "feature_id")
      .sortWithinPartitions("dt", "feature_id", "entity_id", "event_ts")
      .write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
      .option("parquet.bloom.filter.enabled#entity_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
      .partitionBy("dt", "feature_id").parquet(path))


def drop_days(spark: SparkSession, path: str, before, dry_run: bool = False) -> list[str]:
    """H3: remove the day folders of a stored history that lie before the day ``before``, and nothing else: no file of
    another day is read or written.  Returns the days, in order; ``dry_run`` only lists them."""
    days = [n[3:] for n in files.names(spark, path) if n.startswith("dt=") and n[3:] < str(before)[:10]]
    for day in days if not dry_run else ():
        files.remove(spark, f"{path}/dt={day}")
    return days
