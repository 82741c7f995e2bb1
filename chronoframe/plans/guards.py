"""Plan assertions."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

def physical_plan(df: DataFrame) -> str:
    """The formatted physical plan, captured from ``explain``."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


FORBIDDEN_NODES = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython")


def assert_scalable_plan(df: DataFrame) -> None:
    plan = physical_plan(df)
    bad = [n for n in FORBIDDEN_NODES if n in plan]
    if bad:
        raise AssertionError(f"plan contains {bad}:\n{plan}")
