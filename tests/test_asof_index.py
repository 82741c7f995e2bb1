"""As-of index, pruning by path and row group, invalidation, retention by folder, numbering, typed values."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import asof, numbering, pit, quality, registry as reg, upkeep, writes
from chronoframe.operators.asof_index import AsofIndex
from chronoframe.session import cut_lineage, scratch_path
from chronoframe.sources import files

from helpers import registry_df, values_df


def definitions(spark):
    return registry_df(spark, [(1, "f1", 1, 24), (2, "f2", 1, 24), (3, "f1", 2, 48)])


def day(n):
    return str(dt.date(2024, 1, 1) + dt.timedelta(n))


def history(spark, rows):
    path = scratch_path(spark, "history")
    writes.write_history(values_df(spark, rows), path)
    return path


def random_rows(seed, days, n=120):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3]), f"e{rng.randrange(6)}", f"{day(rng.randrange(days))} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
             float(i), i) for i in range(n)]


def spine_df(spark, days, seed=5, n=40):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, f"e{rng.randrange(8)}", f"{rng.choice(days)} {rng.randrange(24):02d}:30:00") for i in range(n)],
                                 "sid int, entity_id string, t string").select("sid", "entity_id", F.col("t").cast("timestamp_ntz").alias("label_ts"))


def pairs(spark, path, index, spine, feats=("f1", "f2")):
    values, registry, names = spark.read.parquet(path), definitions(spark), list(feats)
    with_index = asof.as_of_join(spine, values, registry, names, index=index)
    plain = asof.as_of_join(spine, values, registry, names)
    key = lambda df: sorted(map(str, df.collect()))
    return key(with_index), key(plain), with_index


@pytest.mark.parametrize("every", [1, 3, 10, 100])
def test_index_equals_history(spark, every):
    names = ["f1", "f2"]
    path = history(spark, random_rows(every, 25))
    index = AsofIndex(spark, scratch_path(spark, "index"), every).build(spark.read.parquet(path))
    for days in ([day(0)], [day(24)], [day(9), day(10)], [day(3), day(21)], [day(40)]):
        got, want, _ = pairs(spark, path, index, spine_df(spark, days), names)
        assert got == want
    # A late write to an old day, and a day after the last one.
    late = values_df(spark, [(1, "e1", f"{day(2)} 23:59:00", 1000.0, 1000), (1, "e2", f"{day(30)} 01:00:00", 1001.0, 1001),
                             (2, "e1", f"{day(2)} 23:59:00", 1002.0, 1002)])
    merged = cut_lineage(writes.upsert_days(spark.read.parquet(path), late, ["feature_id", "entity_id", "event_ts"]))
    writes.write_history(merged, path)
    index.correct(spark.read.parquet(path), [day(2), day(30)])
    for days in ([day(4)], [day(3), day(24)], [day(30), day(31)]):
        got, want, _ = pairs(spark, path, index, spine_df(spark, days), names)
        assert got == want


def test_index_reads_the_spines_days_only(spark):
    names = ["f1", "f2"]
    path = history(spark, random_rows(1, 25))
    index = AsofIndex(spark, scratch_path(spark, "index"), 10).build(spark.read.parquet(path))
    got, want, joined = pairs(spark, path, index, spine_df(spark, [day(22)]), names)
    assert got == want
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in re.findall(r"FileScan parquet [^\n]*", plan) if "PartitionFilters" in x]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*dt#", x) for x in scans if "history" in x or "index" in x)
    read = {k: 0 for k in ("history", "index")}
    for leaf in _leaves(joined._jdf.queryExecution().executedPlan()):
        text = leaf.toString()
        if "FileScan" in text and "dt#" in text:
            n = leaf.metrics().get("numPartitions").get().value()
            read["index" if "/index-" in text else "history"] = max(read["index" if "/index-" in text else "history"], n)
    assert read["history"] <= 3  # the features of one day, not 25 days of them
    with pytest.raises(ValueError, match="one day"):
        asof.as_of_join(spine_df(spark, [day(22)]), spark.read.parquet(path), definitions(spark), names, index=index, bucket="6 hours")


def _leaves(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _leaves(plan.executedPlan())
    if hasattr(plan, "plan") and "QueryStage" in name:
        return _leaves(plan.plan())
    if name == "ReusedExchangeExec":
        return []
    kids = plan.children()
    if kids.size() == 0:
        return [plan]
    return [x for i in range(kids.size()) for x in _leaves(kids.apply(i))]


def test_feature_folders_and_row_groups(spark):
    """A feature chosen in the registry prunes folders at run time; ten entities skip row groups."""
    n = 40_000
    path = scratch_path(spark, "wide")
    values = spark.range(n).select(
        F.lit(1).alias("feature_id"), F.concat(F.lit("user_"), F.lpad((F.col("id") % 20000).cast("string"), 6, "0")).alias("entity_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,cast(id % 86400 as int))").alias("event_ts"),
        F.col("id").cast("double").alias("value_num"), F.col("id").cast("string").alias("value_json"),
        F.lit("{}").alias("metadata"), F.col("id").alias("write_seq"))
    both = values.unionByName(values.withColumn("feature_id", F.lit(2)))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 * 1024))
    conf.set("parquet.block.size.row.check.min", "100")
    try:
        writes.write_history(both.repartition(1), path)
    finally:
        conf.unset("parquet.block.size")
        conf.unset("parquet.block.size.row.check.min")
    stored, registry = spark.read.parquet(path), definitions(spark)
    p = pit.point_in_time(stored, registry, "2024-01-02 00:00:00", features=["f2"])
    p.collect()
    assert "dynamicpruning" in p._jdf.queryExecution().executedPlan().toString()
    ten = [f"user_{i * 1999:06d}" for i in range(10)]
    few = stored.where((F.col("feature_id") == 1) & F.col("entity_id").isin(ten))
    assert few.count() == 20
    few = few.select("entity_id", "value_num")
    few.collect()
    rows = [leaf.metrics().get("numOutputRows").get().value() for leaf in _leaves(few._jdf.queryExecution().executedPlan())
            if "FileScan" in leaf.toString()]
    assert rows and 20 <= rows[0] < n // 2


def test_invalidated_hours(spark):
    """A value for an old day reaches the rollup; other hours keep their files."""
    path, root = history(spark, random_rows(3, 12)), scratch_path(spark, "rollup")
    upkeep.write_rollup(upkeep.hourly_rollup(spark.read.parquet(path)), f"{root}/rollup")

    def listing():
        return {(r.f, r.n) for r in spark.read.parquet(f"{root}/rollup").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}

    before = listing()
    late = values_df(spark, [(1, "e1", f"{day(1)} 05:10:00", 7.0, 900), (1, "e1", f"{day(1)} 05:20:00", 8.0, 901),
                             (2, "e9", f"{day(8)} 07:00:00", 9.0, 902), (3, "e9", f"{day(11)} 23:30:00", 9.0, 903)])
    for _ in range(2):  # noted twice, counted once
        upkeep.log_invalidations(late, f"{root}/touched", run=4)
    writes.write_history(cut_lineage(writes.upsert_days(spark.read.parquet(path), late, ["feature_id", "entity_id", "event_ts"])), path)
    touched = upkeep.invalidations(spark, f"{root}/touched", after=3)
    assert touched.count() == 3 and upkeep.invalidations(spark, f"{root}/touched", after=4).count() == 0
    stored = spark.read.parquet(path)

    def refresh(as_of):
        fresh = upkeep.refresh_invalidated(spark.read.parquet(f"{root}/rollup"), stored, touched, as_of)
        upkeep.write_rollup(cut_lineage(fresh), f"{root}/rollup")
        return fresh

    first = refresh(f"{day(12)} 00:10:00")  # the last hour ends within an hour of this, so it waits
    assert first.select("hour").distinct().count() == 2
    key = lambda df: sorted(tuple(r) for r in df.select("feature_id", "entity_id", "hour", "update_count", "last_update").collect())
    late_hour = F.col("hour") >= F.lit(f"{day(11)} 23:00:00").cast("timestamp_ntz")
    assert key(spark.read.parquet(f"{root}/rollup").where(~late_hour)) == key(upkeep.hourly_rollup(stored).where(~late_hour))
    refresh(None)
    assert key(spark.read.parquet(f"{root}/rollup")) == key(upkeep.hourly_rollup(stored))
    hours = {(f"dt={day(1)}", "hh=5"), (f"dt={day(8)}", "hh=7"), (f"dt={day(11)}", "hh=23")}
    same = {(f, n) for f, n in before if tuple(f.split("/")[-3:-1]) not in hours}
    assert same and same <= listing()


def test_dropped_days(spark):
    path = history(spark, random_rows(2, 10))
    rows = {day(d): spark.read.parquet(path).where(F.col("dt") == day(d)).count() for d in range(10)}
    kept = {n: files.tree_size(spark, f"{path}/{n}") for n in files.names(spark, path) if n.startswith("dt=") and n[3:] >= day(4)}
    gone = [d for d in sorted(rows) if d < day(4) and rows[d]]
    assert writes.drop_days(spark, path, day(4), dry_run=True) == gone
    assert spark.read.parquet(path).count() == sum(rows.values())
    assert writes.drop_days(spark, path, upkeep.cutoff_day(f"{day(14)} 12:00:00", 10)) == gone
    assert writes.drop_days(spark, path, day(4)) == []
    assert {n: files.tree_size(spark, f"{path}/{n}") for n in files.names(spark, path) if n.startswith("dt=")} == kept
    assert spark.read.parquet(path).count() == sum(n for d, n in rows.items() if d >= day(4))


def test_numbered_rows_and_ids(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("name"), "id")
    got = [r.name for r in numbering.number_rows(rows, ["name"], "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert [r.n for r in numbering.number_rows(rows, ["name"], "n").orderBy("n").limit(3).collect()] == [1, 2, 3]
    assert numbering.number_rows(rows.limit(0), ["name"], "n").count() == 0
    registry = definitions(spark)
    top = registry.agg(F.max("feature_id")).first()[0]
    defs = rows.select("name", F.lit("int64").alias("dtype"), F.lit("user").alias("entity_type"))
    out = reg.register(registry, defs, "2024-01-01 00:00:00")
    assert not re.search(r"Exchange SinglePartition|Window", out._jdf.queryExecution().executedPlan().toString())
    new = out.where(F.col("feature_id") > top).orderBy("feature_id").collect()
    assert [r.feature_id for r in new] == list(range(top + 1, top + 1001)) and [r.name for r in new] == got


def test_typed_values(spark):
    kinds = ["int64", "float64", "bool", "string", "json"]
    defs = spark.createDataFrame([(i, d, d) for i, d in enumerate(kinds)], "feature_id int, name string, dtype string")
    docs = ["9007199254740993", "1.5", "true", '"x"', '{"a":[1]}', "null", "not json", None, "25"]
    rows = spark.createDataFrame([(i, d) for i in range(5) for d in docs], "feature_id int, value_json string")
    path = scratch_path(spark, "variant")
    quality.to_variant(rows).write.parquet(path)
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes)["value"] == "variant"
    v = quality.typed_values(stored, defs).withColumn("json", F.to_json("json"))
    got = {(r.dtype, r.value_json): tuple(r[k] for k in kinds) for r in v.collect()}
    assert got["int64", docs[0]][0] == 9007199254740993 and got["float64", "25"][1] == 25.0 and got["bool", "true"][2] is True
    assert got["string", '"x"'][3] == "x" and got["json", '{"a":[1]}'][4] == '{"a":[1]}'
    matched = {(r.dtype, r.value_json) for r in v.where("matches").collect()}
    assert matched == {("int64", docs[0]), ("int64", "25"), ("float64", docs[0]), ("float64", "1.5"), ("float64", "25"),
                       ("bool", "true"), ("string", '"x"'), ("json", '{"a":[1]}')}
    assert all(all(x is None for x in vals) for k, vals in got.items() if k not in matched)


def test_hours_and_spans_in_any_zone(spark):
    """Hour buckets, refresh bounds and throughput don't go through the session zone."""
    from chronoframe.operators import telemetry

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        v = values_df(spark, [(1, "a", "2024-03-10 01:30:00", 1.0, 1), (1, "a", "2024-03-10 02:30:00", 1.0, 2), (1, "a", "2024-03-10 03:30:00", 1.0, 3)])
        hours = sorted(r.h for r in upkeep.hourly_rollup(v).select(F.col("hour").cast("string").alias("h")).collect())
        assert hours == [f"2024-03-10 0{h}:00:00" for h in (1, 2, 3)]
        first, end = upkeep.refresh_window("2024-03-10 05:10:00")
        got = spark.range(1).select(first.cast("string"), end.cast("string")).first()
        assert tuple(got) == ("2024-03-10 03:00:00", "2024-03-10 04:00:00")
        log = spark.createDataFrame([("x", "2024-03-10 01:30:00"), ("x", "2024-03-10 03:30:00")], "endpoint string, t string").select(
            "endpoint", F.col("t").cast("timestamp_ntz").alias("request_ts"))
        assert telemetry.throughput(log).first()["elapsed_s"] == 7200.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_globs_of_odd_sets(spark):
    from chronoframe.functions.scalars import glob_match

    keys = ["abc", "a\nc", "zbc", "a-c", "a]c", "a", "a^c", "a\\c", "abc\n"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")

    def hits(p):
        return {r.k for r in df.where(glob_match("k", p)).collect()}

    assert hits("[z-a]bc") == {"abc", "zbc"} and hits("a*c") == {k for k in keys if k[0] == "a" and k[-1] == "c" and len(k) > 1}
    assert hits("a?c") == hits("a*c") and hits("[a") == set() and hits("a[\\]]c") == {"a]c"} and hits("a[^b]c") == hits("a?c") - {"abc"}
    assert hits("a[b-]c") == {"abc", "a-c"} and hits("a[\\\\]c") == {"a\\c"} and hits("a[]c") == set() and hits("?bc") == {"abc", "zbc"}
