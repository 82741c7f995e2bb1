"""A stored index for as-of joins (J3): the newest value of every (entity, feature) per day, and now
and then of all days so far.

``day/dt=D`` holds the newest value of each (feature, entity) within day D.  ``state/dt=C`` holds the newest value
before day C, for a state day C every ``every`` days.  What stood before a day is then one state and at most
``every`` days of the index, whatever the length of the history:

* ``build`` and ``extend`` read the history of the wanted days only; a state comes from the state before it and the
  days between, never from the history;
* ``correct`` takes the days that were rewritten (a late write): their index days are made anew, and the states
  after the first of them, each from the one before;
* ``before`` gives the rows that an as-of join needs besides the history of the spine's own days.

A state holds one row per (feature, entity), so the index costs about one row per key and ``every`` days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

KEYS = ["feature_id", "entity_id"]
COLUMNS = [*KEYS, "event_ts", "value_num", "value_json", "write_seq"]
EPOCH = dt.date(1970, 1, 1)


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in COLUMNS if c not in KEYS]
    return rows.groupBy(*KEYS, *keys).agg(F.max_by(F.struct(*rest), F.struct("event_ts", "write_seq")).alias("r")).select(
        *KEYS, *keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def _day(d) -> dt.date:
    return d if isinstance(d, dt.date) and not isinstance(d, dt.datetime) else dt.date.fromisoformat(str(d)[:10])


class AsofIndex:
    def __init__(self, spark: SparkSession, path: str, every: int = 10):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    # --- maintenance ---------------------------------------------------------------
    def build(self, values: DataFrame) -> AsofIndex:
        """Index a whole stored history (with ``dt``)."""
        self._write_days(values)
        self._states_after(None)
        return self

    def extend(self, values: DataFrame, days) -> AsofIndex:
        """Add the days of ``values`` that are new; later days may follow in any order."""
        return self.correct(values, days)

    def correct(self, values: DataFrame, days) -> AsofIndex:
        """Make the index days anew from the stored history ``values`` after ``days`` were written."""
        days = sorted({_day(d) for d in days})
        if days:
            self._write_days(values.where(F.col("dt").isin(days)))
            self._states_after(days[0])
        return self

    def _write_days(self, values: DataFrame) -> None:
        rows = values.select("dt", *[F.col(c) if c in values.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
        (_newest(rows, "dt").hint("rebalance", "dt").sortWithinPartitions("dt", *KEYS)
         .write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dt").parquet(f"{self.path}/day"))

    def _days(self, kind: str) -> list[dt.date]:
        return [_day(n[3:]) for n in files.names(self.spark, f"{self.path}/{kind}") if n.startswith("dt=")]

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def _states_after(self, day: dt.date | None) -> None:
        """Make the states after ``day`` (all without it), up to the one that follows the last index day."""
        days = self._days("day")
        if not days:
            return
        first, last = min(days), max(days)
        for n in range((first - EPOCH).days // self.every + 1, (last - EPOCH).days // self.every + 2):
            at = EPOCH + dt.timedelta(n * self.every)
            if day is None or at > day or not files.exists(self.spark, f"{self.path}/state/dt={at}"):
                since = at - dt.timedelta(self.every)
                rows = self._read("day").where((F.col("dt") >= F.lit(since)) & (F.col("dt") < F.lit(at))).select(*COLUMNS)
                if files.exists(self.spark, f"{self.path}/state/dt={since}"):
                    rows = rows.unionByName(self._read("state").where(F.col("dt") == F.lit(since)).select(*COLUMNS))
                _newest(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/state/dt={at}")

    # --- reading ---------------------------------------------------------------------
    def before(self, first: Column, last: Column) -> DataFrame:
        """What stood before the days ``first`` to ``last`` (date columns, such as scalar subqueries): one state and
        the index days from it on, before ``last``."""
        states = self._days("state")

        def state() -> Column:
            day = F.datediff(first, F.lit(EPOCH))
            at = F.date_add(F.lit(EPOCH), (F.floor(day / self.every) * self.every).cast("int"))
            return F.least(at, F.lit(max(states))) if states else at

        days = self._read("day").where((F.col("dt") >= state()) & (F.col("dt") < last)).select(*COLUMNS)
        if not states:
            return days
        return days.unionByName(self._read("state").where(F.col("dt") == state()).select(*COLUMNS))
