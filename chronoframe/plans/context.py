"""Per-(session, data folder) access to the adapted domain tables.

The registry and the feature history are *stored* tables in a real
deployment.  Here they are derived from the driver's tables once per Spark
application and data folder, written to the shared checkpoint folder (which
also cuts their lineage), and read back by every query.
"""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.asof_index import AsofIndex
from ..operators.writes import write_history
from ..session import scratch_path
from ..sources import adapters as A

_STORED: dict[tuple, str] = {}
_LOCK = threading.RLock()


def _stored(spark: SparkSession, sf_dir: str, name: str, build, writer=None) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _LOCK:
        path = _STORED.get(key)
        if path is None:
            path = scratch_path(spark, name)
            df = build()
            if writer is None:
                df.write.mode("overwrite").parquet(path)
            else:
                writer(df, path)
            _STORED[key] = path
    return spark.read.parquet(path)


class Tables:
    """Lazily built domain tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def stored(self, name: str, build) -> DataFrame:
        """A derived table written once per application and data folder."""
        return _stored(self.spark, self.sf_dir, name, build)

    def raw(self, name: str) -> DataFrame:
        return A.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def events_raw(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def events(self) -> DataFrame:
        return A.domain_events(self.events_raw)

    @cached_property
    def registry(self) -> DataFrame:
        return _stored(self.spark, self.sf_dir, "registry",
                       lambda: A.build_registry(self.spark, self.events_raw).coalesce(1))

    @cached_property
    def values(self) -> DataFrame:
        """Feature history, day-partitioned (U8)."""
        return _stored(self.spark, self.sf_dir, "feature_values",
                       lambda: A.values_from_events(self.events_raw, self.registry), write_history)

    def folder(self, name: str, build) -> str:
        """A folder that ``build(path)`` fills once per application and data folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        with _LOCK:
            if key not in _STORED:
                path = scratch_path(self.spark, name)
                build(path)
                _STORED[key] = path
            return _STORED[key]

    @cached_property
    def asof_index(self) -> AsofIndex:
        """The stored index of the history."""
        path = self.folder("asof_index", lambda root: AsofIndex(self.spark, root).build(self.values))
        return AsofIndex(self.spark, path)

    @cached_property
    def spine(self) -> DataFrame:
        return A.spine_from_events(self.events_raw)

    @cached_property
    def products(self) -> DataFrame:
        return A.product_events(self.events_raw)

    @cached_property
    def request_log(self) -> DataFrame:
        return A.request_log(self.events_raw)

    @cached_property
    def orders(self) -> DataFrame:
        return A.order_updates(self.raw("orders"))
