"""Every micro-batch's progress, over a restart."""

import json
import os

from pyspark.sql import functions as F

from chronoframe.session import scratch_path
from chronoframe.streaming.progress import ProgressTable, batch_histogram


def test_progress_of_many_batches(spark):
    root = scratch_path(spark, "progress")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(f"{local}/in")
    table = ProgressTable(spark, f"{root}/table")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.streams.addListener(table)
    try:
        for run in range(2):
            for i in range(75):
                n = run * 75 + i
                rows = [{"ts": f"2024-01-01T{n // 60:02d}:{n % 60:02d}:00", "v": n}]
                if n == 140:
                    rows.append({"ts": "2024-01-01T00:00:00", "v": -1})  # late
                with open(f"{local}/in/f{n:04d}.json", "w") as f:
                    f.write("\n".join(map(json.dumps, rows)))
                os.utime(f"{local}/in/f{n:04d}.json", (n + 1, n + 1))
            events = (spark.readStream.schema("ts timestamp, v long").option("maxFilesPerTrigger", "1").json(f"{root}/in"))
            counts = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes")).count()
            q = (counts.writeStream.queryName("many").outputMode("update").format("noop")
                 .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
            q.awaitTermination()
            assert q.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(table)
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def check():
        rows = table.table().where("input_rows > 0")
        got = rows.agg(F.count(F.lit(1)), F.countDistinct("batch_id"), F.countDistinct("run_id"), F.sum("input_rows"),
                       F.sum("dropped_by_watermark"), F.max("watermark").cast("string")).first()
        assert tuple(got) == (150, 150, 2, 151, 1, "2024-01-01 02:18:00")

    check()
    table.compact()
    check()
    table.compact()
    check()
    h = batch_histogram(table.table().where("input_rows > 0")).first()
    assert (h["query_name"], h["batches"], h["input_rows"], h["le_300"]) == ("many", 150, 151, 150)
    assert ProgressTable(spark, f"{root}/none").table().count() == 0
