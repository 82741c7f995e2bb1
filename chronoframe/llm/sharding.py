"""Operator 8: two-pass external shuffle into shards, in DataFrame operations only.

Pass 1 scatters whole records by seeded hashes into buckets of about ``bucket_bytes``.  The shard is
the rendezvous winner of (doc_id, shard number): doc_id and the shard count alone decide, and one
more shard takes records only into itself.  Within a shard the bucket is a second hash, of the id
and the text, so that many rows without an id still spread.  Rows that repeat one id and text more than ``HOT``
times are written with their place in the table first, which joins the hash, so that they spread as well.  Pass 2 puts each bucket in a fixed
order and applies a seeded Fisher-Yates shuffle (``shuffle``); the slot is the place in the bucket
plus the rows of the shard's earlier buckets.

Only the bucket counts meet in one place (a window per shard over one row per bucket).  The buckets
of a partition come sorted, and nothing is exchanged after the random step, so a task that is run
again writes what it wrote before.

Cases: a null text has no bytes and stays null; a null id is hashed as such; repeated rows each get
a slot of their own; an empty table gives an empty table; records carry all input columns in ``row``,
so clashing names can't arise.  Columns of map type can't be ordered and are refused by Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

BUCKET_BYTES = 8 << 20
#: Equal rows from which their places in the table spread them over buckets.
HOT = 1000


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard from 0 to n_shards - 1 whose hash with the key is the largest."""
    def weight(i):
        return F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.cast("int").alias("s"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), weight))["s"]


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _placed(docs: DataFrame, hash_: Column, hot: int) -> DataFrame:
    """(row, place): the records, with a place in the table where they repeat more than ``hot`` times, else 0.  Places
    are written before they are used, as a second reading could number the rows in another way."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), hash_.alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h")
    often = write_table(often, "hot")
    if often.isEmpty():
        return rows.select("row", F.lit(0).cast("bigint").alias("place"))
    spread = rows.join(often, "h", "left_semi").select("row", F.monotonically_increasing_id().alias("place"))
    rest = rows.join(often, "h", "left_anti").select("row", F.lit(0).cast("bigint").alias("place"))
    return rest.unionByName(write_table(spread, "placed"))


def shard(docs: DataFrame, n_shards: int, seed: int = 7, bucket_bytes: int = BUCKET_BYTES,
          id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(row, shard, slot, grown_shard): ``row`` is the input record as a struct."""
    total = docs.agg(F.sum(record_size(F.col(text_col))).alias("b")).first()["b"] or 0
    per_shard = max(1, math.ceil(total / n_shards / bucket_bytes))
    key, text = F.col(f"row.{id_col}"), F.col(f"row.{text_col}")
    same = F.xxhash64(docs[id_col].isNull(), docs[id_col], docs[text_col].isNull(), docs[text_col])
    rows = _placed(docs, same, hot).select(
        rendezvous(key, n_shards, seed).alias("shard"),
        F.pmod(F.xxhash64(key, text, F.lit(seed + 1), F.col("place")), F.lit(per_shard)).cast("int").alias("bucket"), "row")
    offsets = (rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(
                   Window.partitionBy("shard").orderBy("bucket")
                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")))
    buckets = (rows.repartition(per_shard * n_shards, "shard", "bucket")
               .groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"))
               .join(offsets, ["shard", "bucket"])
               .sortWithinPartitions("shard", "bucket"))
    return (buckets.select("shard", "offset", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("pos", "row"))
            .select("row", "shard", (F.col("offset") + F.col("pos")).cast("bigint").alias("slot"),
                    rendezvous(F.col(f"row.{id_col}"), n_shards + 1, seed).alias("grown_shard")))


def write_shards(sharded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per shard; files hold the records of whole buckets in slot order."""
    sharded.select("shard", "slot", "row").write.mode(mode).partitionBy("shard").parquet(path)
