"""The online cache as a table: snapshot, probe, replay, invalidate, stats
(O1-O6, J4, J5, X1, R5, R7, R8, U5, U6, K12).

A snapshot row is ``(entity_id, feature_name) -> value, value_ts,
written_at, expires_at``.  An entry answers a request at ``t`` when
``written_at <= t < expires_at``.  A table of requests is replayed set-wise:
every request reads the snapshot as of the batch start; misses fall back to
the as-of join at the request time, and the fetched values are written back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_seconds, glob_match, online_key, percent_or_zero, seconds_between, ts_lit
from ..session import cut_lineage
from .asof import as_of_join_long
from .pit import resolved_values

SNAPSHOT_COLS = ["entity_id", "feature_name", "value_num", "value_json", "value_ts", "written_at", "expires_at", "write_seq"]
DEFAULT_TTL_SECONDS = 3600


def snapshot_merge(snapshot: DataFrame | None, updates: DataFrame, ttl_seconds=DEFAULT_TTL_SECONDS) -> DataFrame:
    """Set-many with TTL.  ``updates`` has entity_id, feature_name,
    value_num, value_ts, written_at, write_seq and optionally value_json (the
    value of any type as JSON; by default that of value_num) and ttl_seconds
    (per-feature TTL); the newest write per key wins."""
    ttl = F.col("ttl_seconds") if "ttl_seconds" in updates.columns else F.lit(ttl_seconds)
    # Without a snapshot to merge with, the JSON of a number is made for the newest writes alone.
    late = snapshot is None and "value_json" not in updates.columns
    if late:
        updates = updates.withColumn("value_json", F.lit(None).cast("string"))
    elif "value_json" not in updates.columns:
        updates = updates.withColumn("value_json", _number_json())
    u = updates.where(F.col("value_num").isNotNull() | F.col("value_json").isNotNull()) \
        .withColumn("expires_at", add_seconds(F.col("written_at"), ttl)) \
        .select(*SNAPSHOT_COLS)
    allrows = u if snapshot is None else snapshot.select(*SNAPSHOT_COLS).unionByName(u)
    rest = [c for c in SNAPSHOT_COLS if c not in ("entity_id", "feature_name")]
    merged = allrows.groupBy("entity_id", "feature_name").agg(
        F.max_by(F.struct(*rest), F.struct("written_at", "write_seq")).alias("r")) \
        .select("entity_id", "feature_name", *[F.col(f"r.{c}").alias(c) for c in rest])
    return merged.withColumn("value_json", _number_json()) if late else merged


def _number_json() -> Column:
    return F.get_json_object(F.to_json(F.struct("value_num")), "$.value_num")


def warm_up(pit: DataFrame, written_at, registry: DataFrame | None = None,
            ttl_seconds=DEFAULT_TTL_SECONDS) -> DataFrame:
    """A snapshot from a point-in-time read (TTL per feature from the
    registry's ttl_hours when given)."""
    u = pit.select("entity_id", "feature_name", "value_num", "value_json", F.col("event_ts").alias("value_ts"),
                   ts_lit(written_at).alias("written_at"), "write_seq",
                   *([(F.col("ttl_hours") * 3600).alias("ttl_seconds")] if registry is not None
                     and "ttl_hours" in pit.columns else []))
    return snapshot_merge(None, u, ttl_seconds)


def stream_updates(stats: DataFrame, batch_id, ttl_seconds=DEFAULT_TTL_SECONDS, as_of=None) -> DataFrame:
    """Window stats of one micro-batch -> snapshot updates.  One entry
    per (entity, feature): the newest window end wins.  With ``as_of`` only
    windows closed by then count (``window_end <= as_of``)."""
    from .windows import newest_features
    if as_of is not None:
        stats = stats.where(F.col("window_end") <= ts_lit(as_of))
    return newest_features(stats).select("entity_id", "feature_name", "value_num", F.col("event_ts").alias("value_ts"),
                    F.col("event_ts").alias("written_at"), F.lit(batch_id).cast("long").alias("write_seq"),
                    F.lit(ttl_seconds).alias("ttl_seconds"))


def explode_requests(requests: DataFrame) -> DataFrame:
    """(request_id, entity_id, feature_names, request_ts) -> one row per
    requested feature with its position (order kept)."""
    return requests.select("request_id", "entity_id", "request_ts",
                           F.posexplode("feature_names").alias("pos", "feature_name"))


def probe(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """Per requested key, hit or miss and the cached value.  The join
    is on (entity, feature); the snapshot holds one row per key, so AQE's
    skew handling can split a hot request key."""
    r = explode_requests(requests)
    s = snapshot.select("entity_id", "feature_name", F.col("value_num").alias("c_value"),
                        F.col("value_json").alias("c_json"), F.col("value_ts").alias("c_ts"), "written_at", "expires_at")
    j = r.join(s, ["entity_id", "feature_name"], "left")
    hit = F.coalesce((F.col("written_at") <= F.col("request_ts")) & (F.col("request_ts") < F.col("expires_at")),
                     F.lit(False))
    return j.withColumn("hit", hit).select(
        "request_id", "entity_id", "request_ts", "pos", "feature_name", "hit",
        F.when(hit, F.col("c_value")).alias("cached_value"), F.when(hit, F.col("c_json")).alias("cached_json"),
        F.when(hit, F.col("c_ts")).alias("cached_ts"))


def replay(snapshot: DataFrame, values: DataFrame, registry: DataFrame, requests: DataFrame,
           bucket="1 day") -> tuple[DataFrame, DataFrame]:
    """Look-aside answers for a table of requests.

    Returns ``(answers, write_back)``.  ``answers``: one row per requested
    feature that has a value -- hits from the snapshot, misses from the
    history as of the request time (absent stays absent) -- with
    freshness recomputed at the request time (R7), the per-row ``hit`` and
    the per-request ``source`` ('cache' only when every feature hit).
    ``write_back``: the snapshot after caching the fetched misses."""
    # The flag ('cache' only when every requested feature hit) is a window over one
    # request's rows -- a group bounded by its feature list.  Hits and misses both
    # start from that window's exchange, which Spark reuses; nothing is written.
    all_hit = F.min(F.col("hit").cast("int")).over(Window.partitionBy("request_id"))
    probed = probe(snapshot, requests).withColumn("_all", all_hit)
    hits = probed.where("hit").select(
        "request_id", "entity_id", "request_ts", "pos", "feature_name", "_all",
        F.col("cached_value").alias("value_num"), F.col("cached_json").alias("value_json"),
        F.col("cached_ts").alias("value_ts"), "hit")
    misses = probed.where(~F.col("hit")).select("request_id", "entity_id", "request_ts", "pos",
                                                "feature_name", "_all")
    fetched = as_of_join_long(misses, values, registry, time="request_ts", bucket=bucket) \
        .where(F.col("value_ts").isNotNull()) \
        .select("request_id", "entity_id", "request_ts", "pos", "feature_name", "_all", "value_num", "value_json",
                "value_ts", F.lit(False).alias("hit"))
    answers = hits.unionByName(fetched) \
        .withColumn("source", F.when(F.col("_all") == 1, "cache").otherwise("database")) \
        .withColumn("freshness_seconds", seconds_between("request_ts", "value_ts")) \
        .drop("_all")
    wb = fetched.select("entity_id", "feature_name", "value_num", "value_json", "value_ts",
                        F.col("request_ts").alias("written_at"), F.col("request_id").alias("write_seq"))
    return answers, snapshot_merge(snapshot, wb)


def freshness_gauge(snapshot: DataFrame, values: DataFrame, registry: DataFrame, requests: DataFrame) -> DataFrame:
    """A21 without a whole replay: per feature, the freshness that the newest request set which missed the snapshot
    and found a value in the history.  A miss finds one if the key's first value isn't later, so the newest such
    miss is an aggregate, and only one key per feature is looked up as of its time."""
    first = resolved_values(values, registry).groupBy("entity_id", "feature_name").agg(F.min("event_ts").alias("first_ts"))
    misses = probe(snapshot, requests).where(~F.col("hit")).join(first, ["entity_id", "feature_name"])
    newest = misses.where(F.col("first_ts") <= F.col("request_ts")).groupBy("feature_name").agg(
        F.max_by(F.struct("request_id", "entity_id", "request_ts"), F.struct("request_ts", "request_id")).alias("r"))
    asked = cut_lineage(newest.select("feature_name", "r.*"))  # one row per feature
    keys = asked.select("entity_id", "feature_name")
    there = (resolved_values(values, registry).join(keys, ["entity_id", "feature_name"], "left_semi")
             .select("entity_id", "feature_name", "event_ts"))
    found = asked.join(there, ["entity_id", "feature_name"]).where(F.col("event_ts") <= F.col("request_ts"))
    return found.groupBy("feature_name").agg(F.max("event_ts").alias("value_ts"), F.max("request_ts").alias("observed_at")).select(
        "feature_name", seconds_between("observed_at", "value_ts").alias("freshness_seconds"), "observed_at")


def invalidate(snapshot: DataFrame, pattern: str | None = None, entities=None) -> tuple[DataFrame, DataFrame]:
    """O3: remove keys matching a glob on ``entity:feature`` (E12), or all keys
    of the given entities (exact match: ids are not patterns).  Returns
    ``(remaining, removed_count)``."""
    if pattern is not None:
        m = glob_match(online_key("entity_id", "feature_name"), pattern)
        removed = snapshot.where(m)
        remaining = snapshot.where(~m)
    else:
        ents = entities if isinstance(entities, DataFrame) else \
            snapshot.sparkSession.createDataFrame([(e,) for e in entities], "entity_id string")
        ents = ents.select(F.col(ents.columns[0]).alias("entity_id")).distinct()
        removed = snapshot.join(ents, "entity_id", "left_semi")
        remaining = snapshot.join(ents, "entity_id", "left_anti")
    return remaining, removed.agg(F.count(F.lit(1)).alias("removed"))


def snapshot_stats(snapshot: DataFrame, probed: DataFrame, as_of) -> DataFrame:
    """Live keys at ``as_of``, hits, misses, hit rate -- one row."""
    t = ts_lit(as_of)
    live = snapshot.where((F.col("written_at") <= t) & (t < F.col("expires_at")))
    k = live.agg(F.count(F.lit(1)).alias("total_keys"))
    h = probed.agg(F.sum(F.col("hit").cast("int")).cast("long").alias("hits"),
                   F.sum((~F.col("hit")).cast("int")).cast("long").alias("misses"))
    both = k.unionByName(h, allowMissingColumns=True).agg(F.max("total_keys").alias("total_keys"), F.max("hits").alias("hits"), F.max("misses").alias("misses"))
    return both.select("total_keys", "hits", "misses", percent_or_zero(F.col("hits"), F.col("hits") + F.col("misses"))
                       .alias("hit_rate_pct"))
