"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the
whole given tables (or tables Spark derives from them).  The matching DuckDB
SQL lives in ``oracles.py``; column names and rounding (6 decimals for
computed doubles) agree between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ts_lit
from ..operators import asof, features, online, pit, quality, registry as reg, telemetry, upkeep, windows, writes
from ..operators.asof_index import AsofIndex
from ..session import scratch_path, written
from ..sources import adapters as A
from .context import Tables

# --- query parameters (shared with the SQL oracles) --------------------------
AS_OF = "2024-01-20 00:00:00"
HIST_START, HIST_END = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
EVENT_FEATURES = ["purchase", "view", "click", "signup", "error"]
ASOF_FEATURES = ["purchase", "view", "click"]
SNAPSHOT_AT = "2024-01-15 00:00:00"
REFRESH_BASE_UNTIL, REFRESH_AT = "2024-01-20 10:00:00", "2024-01-20 12:30:00"
RETAIN_AT, RETAIN_DAYS = "2024-01-31 12:00:00", 10
COMPACT_AT, COMPACT_DAYS, COMPACT_LAST = "1998-01-01 00:00:00", 7, "1997-01-01 00:00:00"
REREGISTER_AT = "2024-02-01 00:00:00"
INVALIDATE_GLOB = "user_1*:purchase"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def T(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


# --- point-in-time reads ----------------------------------------------------------
PIT_COLS = ["value_num", "feature_version", "write_seq"]


def q_pit_lookup(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.point_in_time(t.values, t.registry, AS_OF, columns=PIT_COLS)
    return p.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts",
                    "feature_version", "write_seq")


def q_pit_ttl(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.point_in_time(t.values, t.registry, AS_OF, apply_ttl=True, columns=PIT_COLS)
    return p.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts",
                    "feature_version", "write_seq")


def q_pit_latest_version(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.point_in_time(t.values, t.registry, AS_OF, versions="latest", columns=PIT_COLS)
    return p.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts",
                    "feature_version", "write_seq")


def q_pit_entity_set(spark, sf_dir):
    """entities from a DataFrame (users with an error on 2024-01-19),
    two features by name."""
    t = T(spark, sf_dir)
    ents = t.events.where((F.col("event_type") == "error") &
                          (F.to_date("timestamp") == F.lit("2024-01-19").cast("date"))).select("entity_id")
    p = pit.point_in_time(t.values, t.registry, AS_OF, entities=ents, features=["purchase", "click"])
    return p.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts")


def q_pit_wide(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.point_in_time(t.values, t.registry, AS_OF, features=EVENT_FEATURES, columns=PIT_COLS)
    m = pit.to_matrix(p, EVENT_FEATURES)
    return m.select("entity_id", *[r6(f).alias(f"{f}_value") for f in EVENT_FEATURES])


def q_feature_map(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.point_in_time(t.values, t.registry, AS_OF)
    return pit.render_feature_map(pit.to_feature_map(p))


def q_freshness(spark, sf_dir):
    t = T(spark, sf_dir)
    p = pit.with_freshness(pit.point_in_time(t.values, t.registry, AS_OF, columns=PIT_COLS), AS_OF)
    return p.select("entity_id", "feature_name", r6("freshness_seconds").alias("freshness_seconds"))


def q_history_range(spark, sf_dir):
    t = T(spark, sf_dir)
    h = pit.history(t.values, t.registry, None, ["purchase"], HIST_START, HIST_END)
    return h.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts", "metadata",
                    "write_seq")


def q_pit_asof_join(spark, sf_dir):
    t = T(spark, sf_dir)
    j = asof.as_of_join(t.spine, t.values, t.registry, ["purchase"], index=t.asof_index)
    return j.select("spine_id", "entity_id", "label_ts", r6("purchase").alias("purchase_value"),
                    F.col("purchase_ts"))


def q_pit_asof_wide(spark, sf_dir):
    t = T(spark, sf_dir)
    j = asof.as_of_join(t.spine, t.values, t.registry, ASOF_FEATURES, index=t.asof_index)
    cols = ["spine_id", "entity_id", "label_ts"]
    for f in ASOF_FEATURES:
        cols += [r6(f).alias(f"{f}_value"), F.col(f"{f}_ts")]
    return j.select(*cols)


def late_values(t: Tables) -> DataFrame:
    """A late write: for every signup a purchase (version 1) the day before, with the signup's value."""
    purchase = t.registry.where((F.col("name") == "purchase") & (F.col("version") == 1)).select("feature_id")
    rows = t.events_raw.where(F.col("event_type") == "signup").select(
        A.user_entity().alias("entity_id"), F.timestamp_add("DAY", F.lit(-1), F.col("ts")).alias("event_ts"),
        F.col("value").cast("string").alias("value_json"), F.col("value").alias("value_num"),
        F.col("props").alias("metadata"), F.col("event_id").alias("write_seq"), purchase.scalar().alias("feature_id"))
    return rows


def after_late_write(t: Tables):
    """(history, as-of index, rollup) after a late write: the stored history is copied, indexed and rolled up;
    then the late rows go in, and index and rollup are brought up to date from what the write touched."""
    spark = t.spark
    path = t.folder("late", lambda root: _write_late(t, root))
    return spark.read.parquet(f"{path}/history"), AsofIndex(spark, f"{path}/index"), spark.read.parquet(f"{path}/rollup")


def _write_late(t: Tables, root: str) -> None:
    spark, history = t.spark, f"{root}/history"
    writes.write_history(t.values, history)
    index = AsofIndex(spark, f"{root}/index").build(spark.read.parquet(history))
    upkeep.write_rollup(upkeep.hourly_rollup(spark.read.parquet(history)), f"{root}/rollup")
    late = late_values(t)
    merged = written(writes.upsert_days(spark.read.parquet(history), late, ["feature_id", "entity_id", "event_ts"]), "upserted")
    upkeep.log_invalidations(late, f"{root}/touched", run=1)
    writes.write_history(merged, history)
    stored = spark.read.parquet(history)
    index.correct(stored, [r["dt"] for r in merged.select("dt").distinct().collect()])
    fresh = written(upkeep.refresh_invalidated(spark.read.parquet(f"{root}/rollup"), stored,
                                               upkeep.invalidations(spark, f"{root}/touched")), "refreshed")
    upkeep.write_rollup(fresh, f"{root}/rollup")


def q_pit_asof_late_write(spark, sf_dir):
    """J3 from the index, after old days were written to again."""
    t = T(spark, sf_dir)
    history, index, _ = after_late_write(t)
    j = asof.as_of_join(t.spine, history, t.registry, ["purchase", "view"], index=index)
    return j.select("spine_id", r6("purchase").alias("purchase_value"), "purchase_ts", r6("view").alias("view_value"), "view_ts")


def q_rollup_invalidated(spark, sf_dir):
    """H5: the rollup after a late write, recounted in the touched buckets only."""
    return after_late_write(T(spark, sf_dir))[2].select("feature_id", "entity_id", "hour", "update_count", "last_update")


def q_retention_dropped(spark, sf_dir):
    """H3: what a copy of the stored history holds once its old day folders are removed."""
    t = T(spark, sf_dir)
    path = t.folder("retained", lambda root: (writes.write_history(t.values, root),
                                              writes.drop_days(spark, root, upkeep.cutoff_day(RETAIN_AT, RETAIN_DAYS))))
    return spark.read.parquet(path).select("feature_id", "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_typed_values(spark, sf_dir):
    """Values of every type, stored as VARIANT and read as typed columns."""
    t = T(spark, sf_dir)
    values, registry = any_type_history(t)
    path = t.folder("variants", lambda root: quality.to_variant(values).drop("value_json", "value_num").write.parquet(root))
    v = quality.typed_values(spark.read.parquet(path), registry)
    return v.select("write_seq", "feature_name", F.col("int64").alias("as_int64"), F.col("bool").alias("as_bool"),
                    F.col("string").alias("as_string"), F.try_variant_get("json", "$.k", "bigint").alias("as_object_k"),
                    F.col("float64").alias("as_float64"), "matches")


def q_stream_sessions(spark, sf_dir):
    """Sessions that left the stream, drained in four slices."""
    from ..streaming.sessions import drain_sessions
    return drain_sessions(spark, T(spark, sf_dir).events, gap="30 minutes")


def q_days_since_purchase(spark, sf_dir):
    t = T(spark, sf_dir)
    j = asof.as_of_join(t.spine, t.values, t.registry, ["purchase"], index=t.asof_index)
    return features.days_since(j).select("spine_id", "entity_id", "label_ts", "last_purchase_days")


def batch_requests(t: Tables) -> DataFrame:
    """One batch request per click: the users whose id is the user's, the next and the one after, three
    features, as of the click."""
    names = F.array(*[F.lit(f) for f in ("purchase", "view", "signup")])
    return t.events_raw.where(F.col("event_type") == "click").select(
        F.col("event_id").alias("request_id"),
        F.array(*[F.concat(F.lit("user_"), (F.col("user_id") + i).cast("string")) for i in range(3)]).alias("entity_ids"),
        names.alias("feature_names"), F.col("ts").alias("as_of"))


def odd_requests(t: Tables) -> DataFrame:
    """The batch requests with, on days divisible by ten, no feature, and for users divisible by seven no entity."""
    r = batch_requests(t)
    none = F.array().cast("array<string>")
    return r.select("request_id", F.when(F.substring_index(F.col("entity_ids")[0], "_", -1).cast("bigint") % 7 == 0, none)
                    .otherwise(F.col("entity_ids")).alias("entity_ids"),
                    F.when(F.dayofmonth("as_of") % 10 == 0, none).otherwise(F.col("feature_names")).alias("feature_names"), "as_of")


def q_batch_retrieval(spark, sf_dir):
    t = T(spark, sf_dir)
    hits, _ = pit.batch_retrieval(t.values, t.registry, batch_requests(t))
    return hits.select("request_id", "entity_id", "feature_name", r6("value_num").alias("value"),
                       "value_ts", "entities_returned")


def any_type_history(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A history of values that are no doubles, made of the events' own columns, with its registry."""
    kinds = {"last_kind": ("string", F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))),
             "is_high": ("bool", (F.col("value") > 50).cast("string")), "last_doc": ("json", F.col("props")),
             "big_seq": ("int64", (F.lit(9007199254740992) + F.col("event_id")).cast("string"))}
    defs = t.spark.createDataFrame([(n, d) for n, (d, _) in kinds.items()], "name string, dtype string")
    registry = reg.register(t.registry, defs.withColumn("entity_type", F.lit("user")), REREGISTER_AT)
    rows = t.events_raw.select(
        A.user_entity().alias("entity_id"), F.col("ts").alias("event_ts"), F.col("event_id").alias("write_seq"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), j.alias("value_json")) for n, (_, j) in kinds.items()])))
    ids = registry.select("name", "feature_id")
    return rows.join(ids, "name").select("feature_id", "entity_id", "event_ts", "value_json",
                                         F.lit(None).cast("double").alias("value_num"), "write_seq"), registry


ANY_TYPE_FEATURES = ["last_kind", "is_high", "last_doc", "big_seq"]


def q_asof_any_type(spark, sf_dir):
    """J3 on a string, a boolean, an object and whole numbers beyond 2^53."""
    t = T(spark, sf_dir)
    values, registry = any_type_history(t)
    return asof.as_of_join(t.spine, values, registry, ANY_TYPE_FEATURES, value="value_json").select(
        "spine_id", *ANY_TYPE_FEATURES, "last_doc_ts")


def q_batch_any_type(spark, sf_dir):
    """H2 on values of any type."""
    t = T(spark, sf_dir)
    values, registry = any_type_history(t)
    ask = batch_requests(t).withColumn("feature_names", F.array(*[F.lit(f) for f in ANY_TYPE_FEATURES]))
    hits, _ = pit.batch_retrieval(values, registry, ask)
    return hits.select("request_id", "entity_id", "feature_name", "value_json", "value_ts", "entities_returned")


def q_request_rejects(spark, sf_dir):
    """V2: the batch requests that are not answered, with their violations."""
    t = T(spark, sf_dir)
    _, rejects = pit.batch_retrieval(t.values, t.registry, odd_requests(t), max_entities=3)
    return rejects.select("request_id", F.array_join("violations", ",").alias("violations"))


# --- windows ---------------------------------------------------------------------
def _stats_out(s, suffix):
    return s.select("entity_id", "event_type", "window_start", "window_end",
                    *[r6(f"{k}_{suffix}").alias(f"{k}_{suffix}") for k in ("avg", "stddev", "max", "min")],
                    "n_events")


def q_sliding_stats(spark, sf_dir):
    t = T(spark, sf_dir)
    return _stats_out(windows.window_stats(t.events, "5 minutes", "1 minute"), "5min")


def q_sliding_stats_1d6h(spark, sf_dir):
    t = T(spark, sf_dir)
    return _stats_out(windows.window_stats(t.events, "1 day", "6 hours", suffix="1d"), "1d")


def q_window_long(spark, sf_dir):
    t = T(spark, sf_dir)
    s = windows.window_stats(t.events, "5 minutes", "1 minute")
    f = windows.stats_to_features(s, stats_kept=("avg", "stddev", "max", "min"))
    return f.select("entity_id", "feature_name", r6("value_num").alias("value"), "event_ts", "window_start")


def _window_merge(t: Tables):
    f = windows.stats_to_features(windows.window_stats(t.events, "5 minutes", "1 minute"))
    return windows.merge_into_history(f, t.registry, t.values, 0)


def q_window_merge(spark, sf_dir):
    """The touched days of the history with the window features merged in."""
    merged, _ = _window_merge(T(spark, sf_dir))
    return merged.select("feature_id", "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_window_unresolved(spark, sf_dir):
    """Window features without a definition."""
    return _window_merge(T(spark, sf_dir))[1]


def q_closed_window_snapshot(spark, sf_dir):
    """The snapshot of the windows closed by SNAPSHOT_AT."""
    t = T(spark, sf_dir)
    stats = windows.window_stats(t.events, "5 minutes", "1 minute")
    u = online.stream_updates(stats, 0, as_of=SNAPSHOT_AT)
    return online.snapshot_merge(None, u).select("entity_id", "feature_name", r6("value_num").alias("value"), "value_ts")


def q_stream_closed_snapshot(spark, sf_dir):
    """The snapshot that the append-mode sink wrote, from base and deltas."""
    from ..streaming.replay import drain_events_stream
    s = drain_events_stream(spark, T(spark, sf_dir).events, closed=True).snapshot()
    return s.select("entity_id", "feature_name", r6("value_num").alias("value"), "value_ts", "written_at", "expires_at")


def q_stream_closed_log(spark, sf_dir):
    """The windows that left the stream, each once, with the days of its log."""
    from ..streaming.replay import drain_events_stream
    log = drain_events_stream(spark, T(spark, sf_dir).events, closed=True).log()
    g = log.groupBy("dt").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_events").alias("n_events"),
                              F.count_distinct("entity_id", "event_type", "window_start").alias("n_distinct"),
                              F.max(F.col("window_end").cast("timestamp_ntz")).alias("last_end"),
                              F.count_if(F.col("last_updated") <= F.current_timestamp()).alias("n_stamped"))
    return g


def q_stream_window_stats(spark, sf_dir):
    from ..streaming.replay import drain_events_stream
    t = T(spark, sf_dir)
    s = drain_events_stream(spark, t.events).windows()
    s = s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    return _stats_out(s, "5min")


# --- named features ------------------------------------------------------------------
def q_purchase_count_7d(spark, sf_dir):
    t = T(spark, sf_dir)
    return features.purchase_count_7d(t.events).select(
        "entity_id", F.col("timestamp").alias("event_ts"), "event_id", "purchase_count_7d")


def q_product_stats(spark, sf_dir):
    t = T(spark, sf_dir)
    return features.product_view_stats(t.products).select(
        "entity_id", "product_view_count", "purchases",
        r6("product_conversion_rate").alias("product_conversion_rate"))


def q_session_duration(spark, sf_dir):
    t = T(spark, sf_dir)
    return features.sessions(t.events, "30 minutes")


def q_seed_counts(spark, sf_dir):
    """Rows, distinct entities and time extent per feature."""
    t = T(spark, sf_dir)
    v = pit.resolved_values(t.values, t.registry)
    return v.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"),
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")).orderBy(F.desc("n_rows"), "feature_name")


# --- writes and upkeep -----------------------------------------------------------------
def _order_history(t: Tables):
    o = t.orders
    cols = ["entity_id", "event_ts", "value_num", "write_seq"]
    return o.where(F.col("status") == "F").select(*cols), o.where(F.col("status") != "F").select(*cols)


def q_upsert_last_wins(spark, sf_dir):
    t = T(spark, sf_dir)
    hist, upd = _order_history(t)
    u = writes.upsert(hist, upd, ["entity_id", "event_ts"])
    return u.select("entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_upsert_replaces(spark, sf_dir):
    """U1 where updates carry lower order numbers than what they replace."""
    t = T(spark, sf_dir)
    hist, upd = _order_history(t)
    u = writes.upsert(hist, upd.withColumn("write_seq", -F.col("write_seq")), ["entity_id", "event_ts"])
    return u.select("entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_recent_order_dates(spark, sf_dir):
    """The five newest rows, ties by entity and order number."""
    t = T(spark, sf_dir)
    return t.orders.orderBy(F.desc("event_ts"), "entity_id", "write_seq").limit(5).select(
        "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_insert_ignore(spark, sf_dir):
    t = T(spark, sf_dir)
    hist, upd = _order_history(t)
    target = writes.first_writer_wins(hist, ["entity_id", "event_ts"]).select(*hist.columns)
    u = writes.insert_ignore(target, upd, ["entity_id", "event_ts"])
    return u.select("entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_compaction(spark, sf_dir):
    t = T(spark, sf_dir)
    v = t.orders.select("entity_id", "event_ts", "value_num", "write_seq")
    c = upkeep.compact(v, COMPACT_AT, COMPACT_DAYS, keys=("entity_id", "event_ts"))
    return c.select("entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_compaction_due(spark, sf_dir):
    """H4: the days that became due since the run a year before."""
    t = T(spark, sf_dir)
    v = t.orders.select("entity_id", "event_ts", "value_num", "write_seq")
    c = upkeep.compact_days(v, COMPACT_AT, COMPACT_LAST, COMPACT_DAYS, keys=("entity_id", "event_ts"))
    return c.select("entity_id", "event_ts", "dt", r6("value_num").alias("value"), "write_seq")


COMPACTED_AT = "2024-01-31 00:00:00"


def q_compaction_written(spark, sf_dir):
    """H4 on stored files: clicks are written a second time with new values; then the days older than a week
    are compacted in place, and the whole history is read back."""
    t = T(spark, sf_dir)
    clicks = t.registry.where("name = 'click'").select("feature_id")
    again = t.values.join(clicks, "feature_id", "left_semi").withColumns(
        {"value_num": F.col("value_num") + 1, "write_seq": F.col("write_seq") + 1_000_000_000})

    def build(root):
        writes.write_history(t.values, root)
        writes.write_history(again, root, mode="append")
        due = written(upkeep.compact_days(spark.read.parquet(root), COMPACTED_AT, None, COMPACT_DAYS), "compacted_days")
        writes.write_history(due, root)

    h = spark.read.parquet(t.folder("compacted", build))
    return h.select("feature_id", "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_window_merge_written(spark, sf_dir):
    """U7 on stored files: the history after the window features were merged into their days."""
    t = T(spark, sf_dir)

    def build(root):
        writes.write_history(t.values, root)
        f = windows.stats_to_features(windows.window_stats(t.events, "5 minutes", "1 minute"))
        merged, _ = windows.merge_into_history(f, t.registry, spark.read.parquet(root), 0)
        writes.write_history(written(merged, "merged_days"), root)

    h = spark.read.parquet(t.folder("merged", build))
    return h.select("feature_id", "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_retention(spark, sf_dir):
    t = T(spark, sf_dir)
    r = upkeep.retain(t.values, RETAIN_AT, RETAIN_DAYS)
    return r.select("feature_id", "entity_id", "event_ts", r6("value_num").alias("value"), "write_seq")


def q_hourly_rollup(spark, sf_dir):
    t = T(spark, sf_dir)
    return upkeep.hourly_rollup(t.values)


def q_rollup_refresh(spark, sf_dir):
    t = T(spark, sf_dir)
    base = upkeep.hourly_rollup(t.values.where(F.col("event_ts") < ts_lit(REFRESH_BASE_UNTIL)))
    return upkeep.refresh_rollup(base, t.values, REFRESH_AT)


# --- registry ----------------------------------------------------------------------------
def q_registry_list(spark, sf_dir):
    t = T(spark, sf_dir)
    return reg.list_features(t.registry, "user").select(
        "feature_id", "name", "version", "dtype", "entity_type", "ttl_hours")


def q_registry_latest(spark, sf_dir):
    t = T(spark, sf_dir)
    return reg.latest_versions(t.registry).select("name", "version", "feature_id", "ttl_hours")


def reregistration(t: Tables) -> DataFrame:
    """Every event definition re-registered with a 48 h ttl, plus purchase v3."""
    d = A.event_definitions(t.events_raw).where(F.col("version") == 1)
    v3 = d.where(F.col("name") == "purchase").withColumn("version", F.lit(3)) \
        .withColumn("description", F.lit("purchase event value, v3"))
    return d.withColumn("ttl_hours", F.lit(48)).unionByName(v3)


def q_registry_upsert(spark, sf_dir):
    t = T(spark, sf_dir)
    r = reg.register(t.registry, reregistration(t), REREGISTER_AT)
    return r.select("feature_id", "name", "version", "ttl_hours", "description", "created_at", "updated_at")


def q_feature_by_id(spark, sf_dir):
    """The public columns of every definition, fetched by its id, in id order (T5)."""
    t = T(spark, sf_dir)
    used = t.values.select("feature_id").distinct()
    return reg.metadata_view(t.registry.join(used, "feature_id", "left_semi")).orderBy("feature_id").select(
        "feature_id", "name", "version", "dtype", "entity_type", "ttl_hours")


def q_feature_resolve(spark, sf_dir):
    """Purchase by name and version, and by name alone (the latest)."""
    t = T(spark, sf_dir)
    one, last = reg.resolve(t.registry, "purchase", 1), reg.resolve(t.registry, "purchase")
    return one.withColumn("asked", F.lit("v1")).unionByName(last.withColumn("asked", F.lit("latest"))).select(
        "asked", "feature_id", "name", "version", "ttl_hours")


def host_definitions(t: Tables) -> DataFrame:
    """One definition per page host, named by the host; hosts over 18 characters lose their type, and
    the ttl is the number of pages less one."""
    host = F.parse_url("url", F.lit("HOST"))
    return t.raw("pages").groupBy(host.alias("name")).agg((F.count(F.lit(1)) - 1).cast("int").alias("ttl_hours")).select(
        "name", "ttl_hours", F.lit(1).alias("version"), F.lit("page").alias("entity_type"),
        F.when(F.length("name") <= 18, "float64").alias("dtype"))


def q_definitions_load(spark, sf_dir):
    """The host definitions as JSON lines, loaded and registered."""
    t = T(spark, sf_dir)
    path = scratch_path(spark, "definitions")
    host_definitions(t).write.json(path)
    r = reg.register(t.registry, reg.load_definitions(spark, path), REREGISTER_AT)
    return r.select("feature_id", "name", "version", "dtype", "entity_type", "ttl_hours")


def q_definition_rejects(spark, sf_dir):
    """V1: the host definitions that are not applied."""
    t = T(spark, sf_dir)
    _, rejects = reg.register_with_rejects(t.registry, host_definitions(t), REREGISTER_AT)
    return rejects.select("name", F.array_join("violations", ",").alias("violations"))


def q_group_members(spark, sf_dir):
    t = T(spark, sf_dir)
    members, _ = reg.expand_groups(A.feature_groups(spark), t.registry)
    return members.select("group", "pos", "member", "feature_id", "version")


def host_groups(t: Tables) -> DataFrame:
    """One group per last label of the page hosts: its hosts."""
    host = F.parse_url("url", F.lit("HOST"))
    return t.raw("pages").select(F.substring_index(host, ".", -1).alias("group"), host.alias("member")).distinct()


def q_group_hosts(spark, sf_dir):
    """J7 over groups that grow with the pages; hosts that no valid definition names dangle."""
    t = T(spark, sf_dir)
    registry = reg.register(t.registry, host_definitions(t), REREGISTER_AT)
    members, dangling = reg.expand_members(host_groups(t), registry)
    lost = dangling.withColumn("dangling", F.lit(True))
    return members.join(lost, ["group", "member"], "left").select(
        "group", "member", "feature_id", "version", F.coalesce("dangling", F.lit(False)).alias("dangling"))


def q_table_statistics(spark, sf_dir):
    """H6: statistics of the stored history as a catalog table."""
    t = T(spark, sf_dir)
    path = t.folder("analyzed", lambda root: t.values.select("entity_id", "event_ts", "value_num", "write_seq").write.parquet(root))
    name = "chronoframe_history_" + path.rsplit("-", 1)[-1]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING PARQUET LOCATION '{path}'")
    upkeep.analyze(spark, name)
    s = upkeep.column_statistics(spark, name, ["write_seq", "value_num"])
    return s.select("column", "num_nulls", r6(F.col("min").cast("double")).alias("min"), r6(F.col("max").cast("double")).alias("max"), "n_rows")


def broken_events(t: Tables) -> DataFrame:
    """Every event as JSON; errors have a bad time, signups no entity, clicks no type, and views are cut off."""
    from ..streaming.job import event_json
    kind = F.col("event_type")
    e = t.events.withColumn("entity_id", F.when(kind != "signup", F.col("entity_id")))
    text = F.get_json_object("value", "$.event_type")
    j = event_json(e.select("entity_id", "event_type", "value", "timestamp", "metadata")).withColumn("kind", text)
    return j.select(F.when(F.col("kind") == "error", F.regexp_replace("value", '"timestamp":"', '"timestamp":"x'))
                    .when(F.col("kind") == "click", F.regexp_replace("value", '"event_type":"click",', ""))
                    .when(F.col("kind") == "view", F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value"))


def q_stream_quarantine(spark, sf_dir):
    """Rows per reason that did not decode, from the quarantine stream's table."""
    from ..streaming.job import run_quarantine
    root = scratch_path(spark, "quarantine")
    broken_events(T(spark, sf_dir)).write.text(f"{root}/in")
    run_quarantine(spark.readStream.format("text").load(f"{root}/in"), f"{root}/out", f"{root}/ckpt",
                   trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("_raw string, reason string").parquet(f"{root}/out").groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


LATE_AT = "2024-01-20 00:00:00"


def q_stream_late_rows(spark, sf_dir):
    """K1/K7: the clicks of a day come after that day has passed: they count in windows that the watermark
    hadn't closed, and in no other."""
    from ..streaming.replay import drain_batches
    t = T(spark, sf_dir)
    ts, at = F.col("timestamp"), ts_lit(LATE_AT)
    held = (F.col("event_type") == "click") & (ts < at) & (ts >= F.timestamp_add("DAY", F.lit(-1), at))
    store = drain_batches(spark, [t.events.where((ts < at) & ~held), t.events.where((ts >= at) | held)], closed=False)
    s = store.windows().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    return _stats_out(s, "5min")


def q_group_dangling(spark, sf_dir):
    t = T(spark, sf_dir)
    _, dangling = reg.expand_groups(A.feature_groups(spark), t.registry)
    return dangling.select("group", "pos", "member")


def q_tag_search(spark, sf_dir):
    t = T(spark, sf_dir)
    return reg.tag_search(t.registry, any_of=["revenue", "purchase"]).select("feature_id", "name", "version")


# --- quality -------------------------------------------------------------------------------
def q_orphans(spark, sf_dir):
    """V5: values left without a definition once ``error`` is deleted."""
    t = T(spark, sf_dir)
    remaining = t.registry.where(F.col("name") != "error")
    return quality.orphans(t.values, remaining).select("feature_id", "entity_id", "event_ts", "write_seq")


def q_cascade_delete(spark, sf_dir):
    """V5: values per feature id once ``error`` and what hangs on it are deleted."""
    t = T(spark, sf_dir)
    left = quality.cascade_delete(t.values, t.registry.where(F.col("name") != "error"))
    return left.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q_json_filter_typed(spark, sf_dir):
    """F10 by type: numbers in another notation, booleans and strings, made of the events' own columns."""
    t = T(spark, sf_dir)
    e = t.events_raw.select("event_id", F.to_json(F.struct(
        "value", F.col("event_type").alias("kind"), (F.col("value") > 50).alias("high"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))).alias("doc"))
    tests = {"k_42": ("$.k", 42), "high": ("$.high", True), "kind_click": ("$.kind", "click"), "kind_true": ("$.kind", True)}
    return e.select("event_id", *[quality.json_path_equals("doc", p, v).alias(c) for c, (p, v) in tests.items()]).where(
        "k_42 or high or kind_click or kind_true")


def q_dtype_violations(spark, sf_dir):
    """V3: values checked against a registry that declares ``click`` int64."""
    t = T(spark, sf_dir)
    redeclared = reg.register(
        t.registry, t.registry.where(F.col("name") == "click").select(
            "name", "version", F.lit("int64").alias("dtype"), "entity_type", "ttl_hours", "description", "tags"),
        REREGISTER_AT)
    return quality.dtype_violations(t.values, redeclared).select(
        "feature_name", "feature_version", "dtype", "checked", "violations")


def q_json_filter(spark, sf_dir):
    """values whose metadata has ``k == 42``."""
    t = T(spark, sf_dir)
    v = pit.resolved_values(t.values.where(quality.json_path_equals("metadata", "$.k", 42)), t.registry)
    return v.select("entity_id", "feature_name", "event_ts", r6("value_num").alias("value"))


# --- online snapshot -----------------------------------------------------------------------
def online_requests(t: Tables) -> DataFrame:
    """One online request per event: the user, three features, at the event time."""
    return t.events_raw.select(
        F.col("event_id").alias("request_id"), A.user_entity().alias("entity_id"),
        F.array(*[F.lit(f) for f in ASOF_FEATURES]).alias("feature_names"), F.col("ts").alias("request_ts"))


def warm_snapshot(t: Tables) -> DataFrame:
    """The online snapshot as the U6 warm-up job writes it (a stored table)."""
    def build():
        p = pit.point_in_time(t.values, t.registry, SNAPSHOT_AT, features=EVENT_FEATURES)
        return online.warm_up(p, SNAPSHOT_AT, registry=t.registry)
    return t.stored("snapshot", build)


def q_snapshot(spark, sf_dir):
    t = T(spark, sf_dir)
    return warm_snapshot(t).select("entity_id", "feature_name", r6("value_num").alias("value"), "value_ts",
                                   "written_at", "expires_at")


def q_cache_probe(spark, sf_dir):
    t = T(spark, sf_dir)
    p = online.probe(warm_snapshot(t), online_requests(t))
    return p.select("request_id", "pos", "feature_name", "hit", r6("cached_value").alias("cached_value"),
                    "cached_ts")


def _replay(t: Tables):
    return online.replay(warm_snapshot(t), t.values, t.registry, online_requests(t))


def q_online_replay(spark, sf_dir):
    t = T(spark, sf_dir)
    answers, _ = _replay(t)
    return answers.select("request_id", "pos", "feature_name", r6("value_num").alias("value"), "value_ts",
                          "hit", "source", r6("freshness_seconds").alias("freshness_seconds"))


def q_snapshot_after_replay(spark, sf_dir):
    t = T(spark, sf_dir)
    _, snap = _replay(t)
    return snap.select("entity_id", "feature_name", r6("value_num").alias("value"), "value_ts",
                       "written_at", "expires_at")


def q_hit_rate(spark, sf_dir):
    t = T(spark, sf_dir)
    p = online.probe(warm_snapshot(t), online_requests(t))
    return telemetry.hit_rate(p).select("feature_name", "hits", "misses", r6("hit_rate_pct").alias("hit_rate_pct"))


def q_freshness_gauge(spark, sf_dir):
    t = T(spark, sf_dir)
    g = online.freshness_gauge(warm_snapshot(t), t.values, t.registry, online_requests(t))
    return g.select("feature_name", r6("freshness_seconds").alias("freshness_seconds"), "observed_at")


def q_invalidate(spark, sf_dir):
    t = T(spark, sf_dir)
    remaining, _ = online.invalidate(warm_snapshot(t), pattern=INVALIDATE_GLOB)
    return remaining.select("entity_id", "feature_name", r6("value_num").alias("value"))


INVALIDATE_RANGE = "user_[3-1]*:[!c-p]*"


def q_invalidate_count(spark, sf_dir):
    """Entries removed by a glob with a reversed range and a negated one."""
    t = T(spark, sf_dir)
    return online.invalidate(warm_snapshot(t), pattern=INVALIDATE_RANGE)[1]


def q_snapshot_stats(spark, sf_dir):
    t = T(spark, sf_dir)
    p = online.probe(warm_snapshot(t), online_requests(t))
    s = online.snapshot_stats(warm_snapshot(t), p, "2024-01-15 01:00:00")
    return s.select("total_keys", "hits", "misses", r6("hit_rate_pct").alias("hit_rate_pct"))


# --- serving telemetry --------------------------------------------------------------------
def q_latency_summary(spark, sf_dir):
    t = T(spark, sf_dir)
    s = telemetry.latency_summary(t.request_log)
    return s.select("endpoint", "n", "errors", *[r6(c).alias(c) for c in (
        "min_ms", "max_ms", "mean_ms", "stddev_ms", "success_pct", "median_ms", "p90_ms", "p95_ms", "p99_ms")])


def q_latency_histogram(spark, sf_dir):
    t = T(spark, sf_dir)
    return telemetry.histogram(t.request_log, "latency_ms", telemetry.LATENCY_BUCKETS_S, scale=0.001)


def q_histogram_quantile(spark, sf_dir):
    t = T(spark, sf_dir)
    h = telemetry.histogram(t.request_log, "latency_ms", telemetry.LATENCY_BUCKETS_S, scale=0.001)
    return telemetry.histogram_quantile(h, 0.99).select("endpoint", r6("quantile").alias("p99_s"))


def q_request_rate(spark, sf_dir):
    t = T(spark, sf_dir)
    r = telemetry.request_rate(t.request_log)
    return r.select("endpoint", F.col("window_start"), "n", r6("rps").alias("rps"))


def q_tenant_requests(spark, sf_dir):
    t = T(spark, sf_dir)
    a = telemetry.attribute_tenant(t.request_log, A.api_keys(spark))
    return telemetry.requests_by(a)


def q_throughput(spark, sf_dir):
    t = T(spark, sf_dir)
    asked = online_requests(t).select("request_id", F.size("feature_names").alias("n_features"))
    log = t.request_log.join(asked, "request_id")
    th = telemetry.throughput(log, features_col="n_features")
    return th.select("endpoint", "requests", r6("elapsed_s").alias("elapsed_s"), r6("rps").alias("rps"),
                     r6("features_per_s").alias("features_per_s"))


def q_entities_served(spark, sf_dir):
    """Distinct entities served by type and day."""
    return telemetry.entities_served(T(spark, sf_dir).request_log)


def q_latency_by_batch_size(spark, sf_dir):
    """batches = a user's requests within one hour."""
    t = T(spark, sf_dir)
    b = telemetry.latency_by_batch_size(telemetry.batches_from_log(t.request_log))
    return b.select("batch_size", "batches", r6("mean_ms").alias("mean_ms"),
                    r6("ms_per_entity").alias("ms_per_entity"))


def q_batch_size_histogram(spark, sf_dir):
    """Cumulative histogram of batch sizes per entity type."""
    t = T(spark, sf_dir)
    b = telemetry.batches_from_log(t.request_log).withColumn(
        "entity_type", F.substring_index("entity_id", "_", 1))
    return telemetry.histogram(b, "batch_size", telemetry.BATCH_SIZE_BUCKETS, by=("entity_type",))


QUERIES = {
    "pit_lookup": q_pit_lookup,
    "pit_ttl": q_pit_ttl,
    "pit_latest_version": q_pit_latest_version,
    "pit_entity_set": q_pit_entity_set,
    "pit_wide": q_pit_wide,
    "feature_map": q_feature_map,
    "freshness": q_freshness,
    "history_range": q_history_range,
    "pit_asof_join": q_pit_asof_join,
    "pit_asof_wide": q_pit_asof_wide,
    "days_since_purchase": q_days_since_purchase,
    "batch_retrieval": q_batch_retrieval,
    "batch_any_type": q_batch_any_type,
    "asof_any_type": q_asof_any_type,
    "window_merge": q_window_merge,
    "window_unresolved": q_window_unresolved,
    "definitions_load": q_definitions_load,
    "entities_served": q_entities_served,
    "sliding_stats": q_sliding_stats,
    "sliding_stats_1d6h": q_sliding_stats_1d6h,
    "window_long": q_window_long,
    "stream_window_stats": q_stream_window_stats,
    "compaction_written": q_compaction_written,
    "window_merge_written": q_window_merge_written,
    "invalidate_count": q_invalidate_count,
    "group_hosts": q_group_hosts,
    "table_statistics": q_table_statistics,
    "stream_quarantine": q_stream_quarantine,
    "stream_late_rows": q_stream_late_rows,
    "stream_sessions": q_stream_sessions,
    "pit_asof_late_write": q_pit_asof_late_write,
    "rollup_invalidated": q_rollup_invalidated,
    "retention_dropped": q_retention_dropped,
    "typed_values": q_typed_values,
    "stream_closed_snapshot": q_stream_closed_snapshot,
    "stream_closed_log": q_stream_closed_log,
    "purchase_count_7d": q_purchase_count_7d,
    "product_stats": q_product_stats,
    "session_duration": q_session_duration,
    "seed_counts": q_seed_counts,
    "upsert_last_wins": q_upsert_last_wins,
    "upsert_replaces": q_upsert_replaces,
    "request_rejects": q_request_rejects,
    "cascade_delete": q_cascade_delete,
    "definition_rejects": q_definition_rejects,
    "json_filter_typed": q_json_filter_typed,
    "recent_order_dates": q_recent_order_dates,
    "feature_by_id": q_feature_by_id,
    "feature_resolve": q_feature_resolve,
    "closed_window_snapshot": q_closed_window_snapshot,
    "insert_ignore": q_insert_ignore,
    "compaction": q_compaction,
    "compaction_due": q_compaction_due,
    "retention": q_retention,
    "hourly_rollup": q_hourly_rollup,
    "rollup_refresh": q_rollup_refresh,
    "registry_list": q_registry_list,
    "registry_latest": q_registry_latest,
    "registry_upsert": q_registry_upsert,
    "group_members": q_group_members,
    "group_dangling": q_group_dangling,
    "tag_search": q_tag_search,
    "orphans": q_orphans,
    "dtype_violations": q_dtype_violations,
    "json_filter": q_json_filter,
    "snapshot": q_snapshot,
    "cache_probe": q_cache_probe,
    "online_replay": q_online_replay,
    "snapshot_after_replay": q_snapshot_after_replay,
    "hit_rate": q_hit_rate,
    "freshness_gauge": q_freshness_gauge,
    "invalidate": q_invalidate,
    "snapshot_stats": q_snapshot_stats,
    "latency_summary": q_latency_summary,
    "latency_histogram": q_latency_histogram,
    "histogram_quantile": q_histogram_quantile,
    "request_rate": q_request_rate,
    "tenant_requests": q_tenant_requests,
    "throughput": q_throughput,
    "latency_by_batch_size": q_latency_by_batch_size,
    "batch_size_histogram": q_batch_size_histogram,
}
