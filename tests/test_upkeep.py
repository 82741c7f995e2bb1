import numpy as np

from chronoframe.operators import telemetry, upkeep, writes
from chronoframe.plans.guards import physical_plan
from chronoframe.session import scratch_path
from helpers import values_df


def test_compaction_of_due_days_only(spark):
    path = scratch_path(spark, "compact")
    rows = [(1, "a", f"2024-01-{d:02d} 10:00:00", float(10 * d + s), 10 * d + s) for d in (1, 5, 9) for s in (1, 2)]
    writes.write_history(values_df(spark, rows), path)
    history = spark.read.parquet(path)
    every = upkeep.compact_days(history, "2024-01-10 00:00:00", days=2)
    assert sorted(r.value_num for r in every.collect()) == [12.0, 52.0]  # the 9th isn't old yet
    due = upkeep.compact_days(history, "2024-01-10 00:00:00", last_run="2024-01-06 00:00:00", days=2)
    scan = [line for line in physical_plan(due).splitlines() if "PartitionFilters" in line]
    assert len(scan) == 1 and scan[0].count("dt#") >= 2, scan
    writes.write_history(due, path)
    spark.catalog.refreshByPath(path)
    assert sorted(r.value_num for r in spark.read.parquet(path).collect()) == [11.0, 12.0, 52.0, 91.0, 92.0]
    assert upkeep.compact_days(history.limit(0), "2024-01-10 00:00:00").count() == 0


def test_quantiles_where_a_wanted_rank_is_a_tie(spark):
    rng = np.random.default_rng(7)
    data = {"median": [5.0] * 3000 + rng.normal(5, 3, 4000).tolist(), "top": rng.normal(size=500).tolist() + [9.0] * 60,
            "two": [1.0, 2.0] * 300, "wide": (10.0 ** rng.uniform(-9, 9, 3000)).tolist()}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, x double")
    got = {r.g: r for r in telemetry.exact_quantiles(df, ["g"], "x", telemetry.QUANTILES).collect()}
    for g, vs in data.items():
        for name, q in telemetry.QUANTILES.items():
            assert np.isclose(got[g][name], np.quantile(vs, q), rtol=1e-12, atol=1e-12), (g, name)
