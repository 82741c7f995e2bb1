"""Operator 5: multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation (each role but ``system``) the whole dialogue is rendered with
that speaker as assistant and the others as named users.  A sample is (conversation, speaker); it is
returned as its segments, one row per turn: the segments in order of ``seq`` are the text, ``target``
says which are trained on, and [start, end) is the place of the segment and [mask_start, mask_end) that
of its trained part, in code points.  So a conversation of any length needs no buffer: places are
prefix sums in two steps, within blocks of ``BLOCK`` turn numbers and over the blocks.  Turns of a conversation
that are null or equal are one block, whose rows go through one task's window, which streams and spills.
``render`` joins the segments of each sample into one text with its mask spans.

Cases: a null text counts as empty; a null role is the participant ``unknown``; a null turn comes
first; a null conversation id is a conversation of its own; repeated turns are rendered each time, in
the order (turn, role, text); a conversation of system turns alone has no participant and no sample;
``<|`` in texts and names becomes ``< |`` so that they can't open a marker; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SYSTEM = "system"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, seq, segment, target, start, end, mask_start, mask_end)."""
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        _safe(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))).alias("role"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"))
    people = (turns.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker"))
              .distinct())
    own = F.col("role") == F.col("speaker")
    head = (F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == SYSTEM, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n"))))
    rows = (turns.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", "speaker", "turn", "role", "body", own.alias("target"),
                    F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BLOCK).alias("block"),
                    F.concat(head, F.col("body"), F.lit("<|end|>\n")).alias("segment"),
                    F.length(head).alias("head_len")))
    sample = ["conv_id", "speaker"]
    before = Window.partitionBy(*sample).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _block_offsets(rows, sample, before)
    order = Window.partitionBy(*sample, "block").orderBy("turn", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("*", F.row_number().over(order).alias("i"), F.sum(F.length("segment")).over(upto).alias("upto"))
    joined = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s"))
                         & (F.col("block") == F.col("b")))
    end = F.col("c0") + F.col("upto")
    start = end - F.length("segment")
    return joined.select(
        "conv_id", "speaker", (F.col("n0") + F.col("i") - 1).cast("bigint").alias("seq"), "segment", "target",
        start.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
        F.when(F.col("target"), start + F.col("head_len")).cast("bigint").alias("mask_start"),
        F.when(F.col("target"), end - 1).cast("bigint").alias("mask_end"))


def _block_offsets(rows: DataFrame, sample: list[str], before) -> DataFrame:
    sums = rows.groupBy(*sample, "block").agg(F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars"))
    return sums.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                       F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))


def render(segments: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, mask): one training text per sample.  A text is one row, so this is for
    conversations that fit one; ``rotate`` has no such limit."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment", "target", "mask_start", "mask_end")))
    return (segments.groupBy("conv_id", "speaker").agg(parts.alias("p"))
            .select("conv_id", "speaker", F.array_join(F.col("p.segment"), "").alias("text"),
                    F.transform(F.filter("p", lambda x: x["target"]),
                                lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
                    .alias("mask")))
