"""Point-in-time (as-of) join with a time per spine row.

For each spine row (entity, label_ts) take, per feature, the newest value
with ``event_ts <= label_ts`` (inclusive; ties -> higher version, then higher
write_seq).  Left by default: spine rows without a value keep NULLs.

Plan (all built-in DataFrame operators, no join on time):

1. Cut time into buckets (default one day).  The work is partitioned by
   (entity, bucket), so a hot entity is spread over its buckets instead of
   landing in one task.
2. Per (entity, bucket) a ``max_by`` summary of the bucket's newest value per
   feature (partial aggregation before the shuffle).
3. The *carry-in* of a spine bucket is the newest summary of an earlier
   bucket: a running ``last(ignorenulls)`` over the per-bucket summaries of
   one entity (rows per entity = buckets, not values).
4. Spine rows, the values of the spine's buckets and one carry row per
   (entity, bucket) are unioned and scanned once with
   ``last(ignorenulls)`` over ``partitionBy(entity, bucket).orderBy(ts, kind)``;
   values sort before spine rows at equal time, so the bound is inclusive.

All features are slots of the same scans: the number of exchanges does not
grow with the features, and there is no join per feature.

Time bounds reach the history scan as scalar subqueries over the spine: no
day after the newest spine time is read, and with ``apply_ttl`` none before
the oldest spine time less the longest ttl asked for.  With a stored index
(``asof_index``) no day before the spine's first one is read either: the
summaries of step 2 come from the index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_hours, micros
from .pit import resolved_values

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def interval_seconds(spec) -> int:
    """``"1 day"`` / ``"6 hours"`` / ``"30 minutes"`` / int seconds."""
    if isinstance(spec, (int, float)):
        return int(spec)
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", str(spec).lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"bad interval: {spec!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def time_bucket(ts: Column, width_seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(width_seconds * 1_000_000)).cast("long")


def _asof_core(spine: DataFrame, vals: DataFrame, keys: list[str], time: str,
               slots: list[tuple[str, Column]], payload: Column, bucket_seconds: int,
               older: DataFrame | None = None) -> DataFrame:
    """Generic as-of scan.  ``vals`` has the keys, ``event_ts``,
    ``feature_version``, ``write_seq`` and the columns used by ``payload``;
    each slot takes the value rows where its condition holds.  ``older``: the
    rows that the carry-in comes from (an index), by default all ``vals``.
    Returns the spine's columns plus one payload struct column per slot."""
    spine_cols = spine.columns

    # A NULL key equals nothing: its values are left out, its spine rows find none.
    def bucketed(rows):
        for k in ["event_ts", *keys]:
            rows = rows.where(F.col(k).isNotNull())
        return rows.withColumn("_b", time_bucket(F.col("event_ts"), bucket_seconds))

    vb = bucketed(vals)
    sp = spine.withColumn("_b", time_bucket(F.col(time), bucket_seconds))
    order = F.struct("event_ts", "feature_version", "write_seq")

    # 2. newest value per (keys, bucket) and slot
    summaries = (vb if older is None else bucketed(older)).groupBy(*keys, "_b").agg(
        *[F.max_by(payload, F.when(cond, order)).alias(name) for name, cond in slots])

    # 3. carry-in for each spine bucket from earlier buckets
    spine_buckets = sp.select(*keys, "_b").distinct()
    marks = spine_buckets.withColumn("_k", F.lit(0))
    carry_scan = marks.unionByName(summaries.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    w_carry = Window.partitionBy(*keys).orderBy("_b", "_k") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = carry_scan.select(
        *keys, "_b", "_k",
        *[F.last(name, ignorenulls=True).over(w_carry).alias(name) for name, _ in slots]) \
        .where(F.col("_k") == 0) \
        .select(*keys, "_b", F.lit(None).cast(vb.schema["event_ts"].dataType).alias("_t"),
                F.lit(0).alias("_k"), *[name for name, _ in slots])

    # 4. one ordered scan per (keys, bucket)
    in_spine_buckets = vb.join(spine_buckets, [*keys, "_b"], "left_semi")
    value_rows = in_spine_buckets.select(
        *keys, "_b", F.col("event_ts").alias("_t"), F.lit(1).alias("_k"),
        F.col("feature_version").alias("_o1"), F.col("write_seq").alias("_o2"),
        *[F.when(cond, payload).alias(name) for name, cond in slots])
    spine_rows = sp.select(*keys, "_b", F.col(time).cast(vb.schema["event_ts"].dataType).alias("_t"),
                           F.lit(2).alias("_k"),
                           F.struct(*[F.col(c) for c in spine_cols]).alias("_s"))
    scan = (carry.unionByName(value_rows, allowMissingColumns=True)
                 .unionByName(spine_rows, allowMissingColumns=True))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("_t").asc_nulls_first(), "_k", "_o1", "_o2") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = scan.select("_k", "_s", *[F.last(name, ignorenulls=True).over(w).alias(name)
                                       for name, _ in slots])
    return picked.where(F.col("_k") == 2).select("_s.*", *[name for name, _ in slots])


def _payload(*values: str) -> Column:
    return F.struct(*values, "event_ts", "feature_version", "write_seq", "ttl_hours")


def _indexed(values: DataFrame, registry: DataFrame, spine: DataFrame, time: str, index, bucket_seconds: int):
    """(the history of the spine's days, the index rows that stood before them)."""
    if bucket_seconds != 86400 or "dt" not in values.columns:
        raise ValueError("an index needs buckets of one day and a history by day")

    def day(f):
        return F.to_date(spine.agg(f(time).cast("timestamp_ntz")).scalar())

    return values.where((F.col("dt") >= day(F.min)) & (F.col("dt") <= day(F.max))), index.before(day(F.min), day(F.max))


def _within(values: DataFrame, registry: DataFrame, spine: DataFrame, time: str, features,
            apply_ttl: bool) -> DataFrame:
    """The values that any spine row can take, by time; with a ``dt`` column
    (the stored history) the bounds prune its day partitions."""
    def newest():
        return spine.agg(F.max(time).cast("timestamp_ntz")).scalar()

    stored = "dt" in values.columns
    values = values.where(F.col("event_ts") <= newest())
    if stored:
        values = values.where(F.col("dt") <= F.to_date(newest()))
    if apply_ttl:
        asked = registry if features is None else registry.where(F.col("name").isin(list(features)))

        def oldest():
            return add_hours(spine.agg(F.min(time).cast("timestamp_ntz")).scalar(),
                             -asked.agg(F.max("ttl_hours")).scalar())

        values = values.where(F.col("event_ts") >= oldest())
        if stored:
            values = values.where(F.col("dt") >= F.to_date(oldest()))
    return values


def as_of_join(spine: DataFrame, values: DataFrame, registry: DataFrame, features,
               entity: str = "entity_id", time: str = "label_ts", how: str = "left",
               apply_ttl: bool = False, versions: str = "all", bucket="1 day",
               value: str = "value_num", index=None) -> DataFrame:
    """Spine + for each feature ``f`` the columns ``f`` (value) and
    ``f_ts`` (its timestamp).  ``how='inner'`` keeps spine rows that found a
    value for every feature.  ``value='value_json'`` answers with the JSON
    text, which holds values of any type (strings, booleans, objects, whole
    numbers beyond 2^53).  With ``index`` (an ``AsofIndex`` of ``values``) the
    history is read on the spine's days alone, and what stood before them
    comes from the index."""
    feats = list(features)
    width = interval_seconds(bucket)
    older = None
    if index is not None:
        values, older = _indexed(values, registry, spine, time, index, width)
        older = resolved_values(older, registry, feats, versions).withColumnRenamed("entity_id", entity)
    else:
        values = _within(values, registry, spine, time, feats, apply_ttl)
    v = resolved_values(values, registry, feats, versions).withColumnRenamed("entity_id", entity)
    slots = [(f"_f{i}", F.col("feature_name") == f) for i, f in enumerate(feats)]
    out = _asof_core(spine, v, [entity], time, slots, _payload(value), width, older)
    cols = [c for c in spine.columns]
    for i, f in enumerate(feats):
        s = F.col(f"_f{i}")
        if apply_ttl:
            s = F.when(s["event_ts"] >= add_hours(F.col(time), -s["ttl_hours"]), s)
        cols += [s[value].alias(f), s["event_ts"].alias(f"{f}_ts")]
    res = out.select(*cols)
    if how == "inner":
        for f in feats:
            res = res.where(F.col(f"{f}_ts").isNotNull())
    return res


def as_of_join_long(spine: DataFrame, values: DataFrame, registry: DataFrame,
                    entity: str = "entity_id", time: str = "label_ts",
                    apply_ttl: bool = False, versions: str = "all", bucket="1 day", index=None) -> DataFrame:
    """J3 in long form: the spine names its feature per row
    (``feature_name``); adds ``value_num``, ``value_json`` (the value of any
    type), ``value_ts``, ``feature_version``.
    Used where each row asks for a different feature (cache misses, batch
    requests)."""
    width = interval_seconds(bucket)
    older = None
    if index is not None:
        values, older = _indexed(values, registry, spine, time, index, width)
        older = resolved_values(older, registry, None, versions).withColumnRenamed("entity_id", entity)
    else:
        values = _within(values, registry, spine, time, None, apply_ttl)
    v = resolved_values(values, registry, None, versions).withColumnRenamed("entity_id", entity)
    out = _asof_core(spine, v, [entity, "feature_name"], time, [("_v", F.lit(True))],
                     _payload("value_num", "value_json"), width, older)
    s = F.col("_v")
    if apply_ttl:
        s = F.when(s["event_ts"] >= add_hours(F.col(time), -s["ttl_hours"]), s)
    return out.select(*spine.columns, s["value_num"].alias("value_num"), s["value_json"].alias("value_json"),
                      s["event_ts"].alias("value_ts"), s["feature_version"].alias("feature_version"))
