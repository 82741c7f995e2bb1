"""Serving-log analytics.

Exact quantiles without gathering a group: per group, count each distinct
value (partial aggregation), sum the counts per value range, and rank only
the ranges that hold a wanted rank; the two ranks around ``q * (n - 1)`` are
interpolated like numpy / ``quantile_cont``.  ``approx=True`` switches to
``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_or_zero, seconds_between

# --- fixed values: histogram bucket upper bounds of the reference's metrics
LATENCY_BUCKETS_S = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
BATCH_SIZE_BUCKETS = [1, 10, 50, 100, 250, 500, 1000]

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def attribute_tenant(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Tenant per request; a missing or unknown key is a 401."""
    j = log.join(keys, "api_key", "left")
    return j.withColumn("auth_status", F.when(F.col("api_key").isNull() | F.col("tenant").isNull(), 401)
                        .otherwise(F.col("status")))


def value_counts(df: DataFrame, by, col: str) -> DataFrame:
    """(_g, _x, _c): how often each value occurs per group.  What follows is built on these counts alone, so
    their exchange is one that Spark reuses, behind one scan of ``df``."""
    group = F.struct(*by).alias("_g")  # equal also where a field is NULL
    return df.groupBy(group, F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))


def exact_quantiles(df: DataFrame, by, col: str, quantiles: dict, ranges: int = 64) -> DataFrame:
    """The quantiles of ``col`` per group, exact, from the counts per value.  Approximate cuts part the distinct values
    of a group into ``ranges``, a value equal to a cut being a range of its own; exact sums per range tell which
    ranges hold a wanted rank, and only those are ranked.  A poor approximation makes a ranked range longer
    and changes no result."""
    by = list(by)
    counts = value_counts(df.where(F.col(col).isNotNull()), by, col)
    # The condition on the count keeps it in both uses, so that they share one exchange.
    cuts = counts.where("_c > 0").groupBy("_g").agg(F.percentile_approx("_x", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    below = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("_x")).cast("int") + (c <= F.col("_x")).cast("int"))
    cut = counts.join(cuts, "_g").withColumn("_r", below).drop("_cuts")
    w = Window.partitionBy("_g")
    sums = cut.groupBy("_g", "_r").agg(F.sum("_c").alias("_t")) \
        .withColumn("_start", F.sum("_t").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")) \
        .withColumn("_n", F.sum("_t").over(w))
    ranks = {n: (F.lit(q) * (F.col("_n") - 1), F.floor(F.lit(q) * (F.col("_n") - 1)), F.ceil(F.lit(q) * (F.col("_n") - 1)))
             for n, q in quantiles.items()}

    def holds(start, end, rank):
        return (start <= rank) & (rank < end)

    wanted = F.lit(False)
    for _, lo, hi in ranks.values():
        end = F.col("_start") + F.col("_t")
        wanted = wanted | holds(F.col("_start"), end, lo) | holds(F.col("_start"), end, hi)
    running = Window.partitionBy("_g", "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.join(sums.where(wanted).drop("_t"), ["_g", "_r"]) \
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(running)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for name, (pos, lo, hi) in ranks.items():
        aggs += [F.max(F.when(holds(F.col("_lo"), F.col("_hi"), lo), F.col("_x"))).alias(f"_{name}_lo"),
                 F.max(F.when(holds(F.col("_lo"), F.col("_hi"), hi), F.col("_x"))).alias(f"_{name}_hi"),
                 F.max(pos - lo).alias(f"_{name}_f")]
    g = ranked.groupBy("_g").agg(*aggs)
    return g.select(*[F.col("_g")[c].alias(c) for c in by],
                    *[(F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
                      for n in quantiles])


def latency_summary(log: DataFrame, by=("endpoint",), col: str = "latency_ms",
                    approx: bool = False) -> DataFrame:
    """N, errors (status >= 400) and success percent of all requests;
    min, max, mean, median/p90/p95/p99 and population stddev of the latency of
    the successful ones (NULL if none is).  Two scans of the log, each summed
    before its exchange: one per group, one per value."""
    by = list(by)
    log = log.withColumn(col, F.when(F.col("status") < 400, F.col(col)))
    base = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(col).alias("min_ms"), F.max(col).alias("max_ms"),
        F.avg(col).alias("mean_ms"), F.stddev_pop(col).alias("stddev_ms"),
        F.sum(F.when(F.col("status") >= 400, 1).otherwise(0)).cast("long").alias("errors"))
    base = base.withColumn("success_pct", percent_or_zero(F.col("n") - F.col("errors"), F.col("n")))
    if approx:
        q = log.groupBy(*by).agg(*[F.percentile_approx(col, v, 10000).alias(k) for k, v in QUANTILES.items()])
    else:
        q = exact_quantiles(log, by, col, QUANTILES)
    q = q.select(F.struct(*by).alias("_q"), *QUANTILES)
    return base.join(q, F.struct(*by).eqNullSafe(F.col("_q")), "left").drop("_q") \
        .withColumnsRenamed({"p50": "median_ms", "p90": "p90_ms", "p95": "p95_ms", "p99": "p99_ms"})


def histogram(log: DataFrame, col: str, buckets, by=("endpoint",), scale: float = 1.0) -> DataFrame:
    """Cumulative ``le`` buckets (plus +Inf) per group, no join: one
    conditional count per bound, then unpivot."""
    by = list(by)
    v = F.col(col) * F.lit(scale)
    aggs = [F.sum(F.when(v <= F.lit(b), 1).otherwise(0)).cast("long").alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(buckets)}"))
    wide = log.groupBy(*by).agg(*aggs)
    les = list(buckets) + [float("inf")]
    pairs = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.lit(i).alias("bucket"), F.col(f"b{i}").alias("cum"))
                      for i, le in enumerate(les)])
    return wide.select(*by, F.inline(pairs))


def histogram_quantile(hist: DataFrame, q: float, by=("endpoint",)) -> DataFrame:
    """PromQL ``histogram_quantile`` over cumulative buckets: linear
    interpolation inside the bucket holding rank ``q * total``; the +Inf
    bucket answers the highest finite bound.  Groups are ``len(buckets)+1``
    rows, so the window is tiny."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("bucket")
    h = hist.withColumn("prev_cum", F.coalesce(F.lag("cum").over(w), F.lit(0))) \
        .withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0))) \
        .withColumn("total", F.max("cum").over(Window.partitionBy(*by))) \
        .withColumn("max_finite", F.max(F.when(F.col("le") != float("inf"), F.col("le"))).over(Window.partitionBy(*by)))
    rank = F.lit(q) * F.col("total")
    hit = h.where((F.col("cum") >= rank) & (F.col("total") > 0))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "prev_le", "cum", "prev_cum", "total", "max_finite"),
                                          F.col("bucket")).alias("b"))
    b = F.col("b")
    inside = b["prev_le"] + (b["le"] - b["prev_le"]) * \
        F.try_divide(F.lit(q) * b["total"] - b["prev_cum"], (b["cum"] - b["prev_cum"]).cast("double"))
    val = F.when(b["le"] == float("inf"), b["max_finite"]).otherwise(F.coalesce(inside, b["le"]))
    return first.select(*by, val.alias("quantile"))


def request_rate(log: DataFrame, by=("endpoint",), window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Requests per second per group and minute."""
    by = list(by)
    g = log.groupBy(*by, F.window("request_ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("window_start"), "n",
                    (F.col("n") / F.lit(float(seconds))).alias("rps"))


def entities_served(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Distinct entities and successful requests by entity type and window."""
    kind = F.substring_index("entity_id", "_", 1)
    g = log.where(F.col("status") < 400).groupBy(kind.alias("entity_type"), F.window("request_ts", window).alias("w")).agg(
        F.count_distinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("requests"))
    return g.select("entity_type", F.col("w.start").alias("window_start"), "entities", "requests")


def requests_by(log: DataFrame, by=("endpoint", "auth_status", "tenant")) -> DataFrame:
    """Request counter by labels."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def hit_rate(probed: DataFrame, by=("feature_name",)) -> DataFrame:
    """Hits, misses and hit-rate percent (0 when empty)."""
    by = list(by)
    g = probed.groupBy(*by).agg(
        F.sum(F.col("hit").cast("int")).cast("long").alias("hits"),
        F.sum((~F.col("hit")).cast("int")).cast("long").alias("misses"))
    return g.withColumn("hit_rate_pct", percent_or_zero(F.col("hits"), F.col("hits") + F.col("misses")))


def freshness_gauge(answers: DataFrame, by=("feature_name",)) -> DataFrame:
    """The last observed freshness per feature (gauge semantics: the
    value set by the latest request).  Only values fetched from the history
    set it; cache hits do not."""
    return answers.where(F.col("freshness_seconds").isNotNull() & ~F.col("hit")).groupBy(*by).agg(
        F.max_by("freshness_seconds", F.struct("request_ts", "request_id")).alias("freshness_seconds"),
        F.max("request_ts").alias("observed_at"))


def throughput(log: DataFrame, by=("endpoint",), features_col: str | None = None) -> DataFrame:
    """Requests per second (and features per second) over each group's
    elapsed span between first and last request."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("requests"), F.min("request_ts").alias("t0"), F.max("request_ts").alias("t1")]
    if features_col:
        aggs.append(F.sum(features_col).alias("features"))
    g = log.groupBy(*by).agg(*aggs)
    span = seconds_between("t1", "t0")
    g = g.withColumn("elapsed_s", span).withColumn("rps", F.try_divide(F.col("requests").cast("double"), span))
    if features_col:
        g = g.withColumn("features_per_s", F.try_divide(F.col("features").cast("double"), span))
    return g


def batches_from_log(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Group a request log into batches: one batch per entity and time
    window; size = number of requests, latency = their summed latency.
    Counts only -- no request list is gathered."""
    g = log.groupBy("entity_id", F.window("request_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("batch_size"), F.sum("latency_ms").alias("latency_ms"))
    return g.select("entity_id", F.col("w.start").alias("batch_start"), "batch_size", "latency_ms")


def latency_by_batch_size(batches: DataFrame, size_col: str = "batch_size",
                          latency_col: str = "latency_ms") -> DataFrame:
    """Mean latency and latency per entity by batch size."""
    return batches.groupBy(size_col).agg(
        F.count(F.lit(1)).alias("batches"), F.avg(latency_col).alias("mean_ms"),
        F.avg(F.col(latency_col) / F.col(size_col)).alias("ms_per_entity"))
