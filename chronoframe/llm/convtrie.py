"""Operator 11: the trie of conversation prefixes, from range minima over sorted LCPs.

1. ``ordered_turns`` numbers the turns of every conversation and gives each a 128-bit digest of role and
   text.  ``rebuilt`` puts the first turns of another conversation before a conversation's own.
2. ``trie`` cuts every conversation into segments of ``SEGMENT`` turns, so that a conversation of any
   length is rows of bounded size.  A turn's token is a 128-bit hash of its depth and digest; a node's id
   is its depth and the XOR of the tokens down to it.
3. Segments are sorted over the whole table by (segment number, id of the node they hang below, tokens,
   conversation).  The members of a node are then an interval of rows.  Each block of sorted rows has the
   LCPs of neighbours and a sparse table of their range minima.  Every candidate prefix, a pair of row and
   depth, searches the table by halves for its left and for its right extent, on its own and without
   any stack, all candidates at once.  Sums over the interval give the counts.
4. A node whose interval reaches an end of the block is a partial row, and the parts of a node are
   summed by its id: at most the depth of two rows per block.  What neighbours in two range
   partitions share is counted twice and taken off again, from the partitions' first and last rows.
   Leaves and saved tokens below a segment's last turn are suffix sums along the conversation.
5. The ids of the conversations that end at a node come in order; a node's hash takes them as a
   stream, from chunks of one per block.

No group is collected: a copied conversation, a common first turn or a conversation with a third of
all turns spreads over as many range partitions as its rows fill.  The stream of one node's ending
ids goes through one task in the end, as SHA-256 has to, in rows of a block's ids.  The driver sees two rows per
range partition.

Cases: a null role or text counts as empty; null turns come first; turns with equal numbers are
ordered by role, the first 256 characters of the text, and digest; repeated rows are turns each;
rows without a conversation id belong to no conversation and are left out; a conversation without
turns is a member of the root alone; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, write_table
from .order import by_range, numbered

#: Turns of a conversation in one row.
SEGMENT = 64
#: Segments per block of the prefix sums along a conversation.
SCAN = 1024
#: Characters of a text that order turns with equal numbers and roles.
TIE_CHARS = 256
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "depth bigint, a bigint, b bigint"
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_OUT = (f"kind int, {_NODE}, up_a bigint, up_b bigint, conv_id bigint, parent_conv_id bigint, "
        + ", ".join(f"{c} bigint" for c in _SUMS)
        + ", ends string, part int, s bigint, key array<bigint>, chars array<bigint>, more boolean")
CLOSED, OPEN, ENDS, FACTS, FIRST, LAST = range(6)


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, digest, chars): the turns of each conversation, numbered from 1, with the digest of
    role and text and the code points of the text.  ``conversations`` is a table read from files."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = (conversations.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
                    F.substring(text, 1, TIE_CHARS).alias("begin"), F.substring(digest, 1, 32).alias("digest"),
                    F.length(text).cast("bigint").alias("chars")))
    placed = numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "begin", "digest"], "at",
                      keep=["conv_id", "digest", "chars"])
    first = write_table(placed.groupBy("conv_id").agg(F.min("at").alias("first")), "first")
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("i"), "digest", "chars")


def head_length(conv_id: Column, modulus: int) -> Column:
    """Turns that a conversation takes from another: crc32 of its decimal id modulo ``modulus``."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % modulus).cast("int")


def rebuilt(turns: DataFrame, group: int = 100, modulus: int = 6) -> DataFrame:
    """(conv_id, depth, digest, chars) of every conversation c: the first h turns of conversation
    c - c % ``group``, then c's own turns after its first h.  A row of depth 0 stands for c itself."""
    turns = turns.withColumn("h", head_length(F.col("conv_id"), modulus))
    part = F.struct(F.col("i").alias("depth"), "digest", "chars")
    heads = (turns.where((F.col("conv_id") % group == 0) & (F.col("i") < modulus)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(part)).alias("head")))
    heads = write_table(heads, "heads")
    none = F.array().cast("array<struct<depth:bigint,digest:string,chars:bigint>>")
    joined = (turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
              .withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("digest"),
                             F.lit(0).cast("bigint").alias("chars")))
    own = F.array(F.struct((F.col("i") - F.col("h") + F.size("head")).alias("depth"), "digest", "chars"))
    rows = F.concat(F.when(F.col("i") == 1, F.concat(start, F.col("head"))).otherwise(none),
                    F.when(F.col("i") > F.col("h"), own).otherwise(none))
    return joined.select("conv_id", F.inline(rows))


def _running(rows: DataFrame, order: Column, sums: dict) -> DataFrame:
    """(conv_id, s, *sums): what stands before each row of a conversation in the order of the
    non-negative ``order``, in two steps: within blocks of ``SCAN`` and over the blocks.  ``sums``: name -> (aggregate, column)."""
    rows = rows.withColumn("_o", order).withColumn("_block", F.floor(F.col("_o") / SCAN))
    whole = rows.groupBy("conv_id", "_block").agg(*[f(c).alias(n) for n, (f, c) in sums.items()])
    over = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "_block", *[F.coalesce(f(n).over(over), F.lit(0)).alias(f"{n}_0") for n, (f, _) in sums.items()])
    inside = Window.partitionBy("conv_id", "_block").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.select("conv_id", "s", "_block", *[F.coalesce(f(c).over(inside), F.lit(0)).alias(n) for n, (f, c) in sums.items()])
    join = {n: F.col(n).bitwiseXOR(F.col(f"{n}_0")) if f is F.bit_xor else F.col(n) + F.col(f"{n}_0") for n, (f, _) in sums.items()}
    return here.join(before, ["conv_id", "_block"]).select("conv_id", "s", *[c.alias(n) for n, c in join.items()])


def _segments(turns: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, s, n, key, chars, sa, sb, more), and those of conversations of several segments."""
    token = lambda k: F.xxhash64(F.lit(k), "depth", "digest")
    cut = (turns.withColumn("s", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / size))
           .withColumn("ta", token(1)).withColumn("tb", token(2)))
    real = F.col("depth") > 0
    parts = F.array_sort(F.collect_list(F.when(real, F.struct("depth", "ta", "tb", "chars"))))
    rows = cut.groupBy("conv_id", "s").agg(parts.alias("p"), F.bit_xor(F.when(real, F.col("ta"))).alias("xa"),
                                           F.bit_xor(F.when(real, F.col("tb"))).alias("xb"))
    rows = write_table(rows.select(
        "conv_id", "s", F.size("p").alias("n"), F.flatten(F.transform("p", lambda x: F.array(x["ta"], x["tb"]))).alias("key"),
        F.col("p.chars").alias("chars"), "xa", "xb"), "segments")
    last = rows.where("s > 0").groupBy("conv_id").agg(F.max("s").alias("last"))
    if last.isEmpty():
        return rows.select("*", F.lit(0).cast("bigint").alias("sa"), F.lit(0).cast("bigint").alias("sb"), F.lit(False).alias("more")), None
    longer = write_table(rows.join(last, "conv_id"), "longer")
    starts = _running(longer, F.col("s"), {"sa": (F.bit_xor, "xa"), "sb": (F.bit_xor, "xb")})
    placed = longer.join(starts, ["conv_id", "s"]).withColumn("more", F.col("s") < F.col("last"))
    placed = write_table(placed.select("conv_id", "s", "sa", "sb", "more", "n", "key"), "placed")
    rows = (rows.join(placed.select("conv_id", "s", "sa", "sb", "more"), ["conv_id", "s"], "left")
            .fillna(0, ["sa", "sb"]).fillna(False, ["more"]))
    return rows, placed


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all ranges of 2**k values."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return levels


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima of the ranges [left, right]."""
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for level in np.unique(k).tolist():
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] - (1 << level) + 1])
    return out


def extents(lcp: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around each ``row`` that shares its first ``depth`` turns.
    ``lcp``: the sparse table of the LCPs of each row with the one before it."""
    left, right, end = row.copy(), row.copy(), len(lcp[0]) - 1
    for k in range(len(lcp) - 1, -1, -1):
        step, low = 1 << k, lcp[k]
        at = np.flatnonzero(right + step <= end)
        at = at[low[right[at] + 1] >= depth[at]]
        right[at] += step
        at = np.flatnonzero(left >= step)
        at = at[low[left[at] - step + 1] >= depth[at]]
        left[at] -= step
    return left, right


def _cum(m: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, m.shape[1]), np.int64), np.cumsum(m, axis=0, dtype=np.int64)])


class _Block:
    """Sorted rows as arrays, with the LCP of each with the one before."""

    def __init__(self, table: pa.Table, before: int):
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        self.conv, self.s, sa, sb = (col[c].to_numpy() for c in ("conv_id", "s", "sa", "sb"))
        self.more = col["more"].to_numpy(zero_copy_only=False)
        self.n = col["n"].to_numpy().astype(np.int64)
        rows, most = len(self.n), int(self.n.max())
        has = np.arange(most) < self.n[:, None]
        token = np.zeros((rows, most, 2), np.int64)
        token[has] = col["key"].flatten().to_numpy().reshape(-1, 2)
        chars = np.zeros((rows, most), np.int64)
        chars[has] = col["chars"].flatten().to_numpy()
        start = np.stack([sa, sb], axis=1)[:, None, :]
        self.id = np.bitwise_xor.accumulate(np.concatenate([start, token], axis=1), axis=1)
        self.upto = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(chars, axis=1)], axis=1)
        same = (self.s[1:] == self.s[:-1]) & (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
        equal = (token[1:] == token[:-1]).all(axis=2) & has[1:] & has[:-1]
        self.lcp = np.empty(rows, np.int64)
        self.lcp[0] = before
        self.lcp[1:] = np.where(same, np.cumprod(equal, axis=1, dtype=np.int64).sum(axis=1), -1)


def _nodes(b: _Block, m: int, at_start: bool, at_end: bool, size: int):
    """Output columns for the first ``m`` rows of a block."""
    lcp, n, more, conv, s = b.lcp[:m], b.n[:m], b.more[:m], b.conv[:m], b.s[:m]
    after = np.append(b.lcp[1:m], -1 if at_end else b.lcp[m])
    depths = np.arange(b.upto.shape[1])
    # Sums per row and depth, to be taken over intervals.
    owns = _cum((lcp[:, None] <= depths) & (n[:, None] > depths))
    shared = b.upto[np.arange(m), np.maximum(lcp, 0)]
    saves = _cum(np.where(lcp[:, None] >= depths, shared[:, None] - b.upto[:m][:, np.maximum(depths - 1, 0)], 0))
    ends = _cum((n[:, None] == depths) & ~more[:, None])
    leaf = ~more & (after < n)
    leaves, mores = np.append(0, np.cumsum(leaf)), np.append(0, np.cumsum(more))
    # Candidates: each prefix at the first row of the block that has it.
    top = np.where(s == 0, 0, 1)
    low = np.maximum(np.where(np.arange(m) == 0, -1, lcp) + 1, top)
    count = np.maximum(n - low + 1, 0)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(m), count)
    depth = np.arange(len(row)) - np.repeat(first, count) + low[row]
    table = sparse_table(lcp)
    left, right = extents(table, row, depth)
    above, _ = extents(table, row, depth - 1)
    open_ = (mores[right + 1] > mores[left]) | ((left == 0) & (at_start or lcp[0] >= depth))
    open_ |= (right == m - 1) & (at_end or after[-1] >= depth)
    least = range_min(sparse_table(conv), left, right)
    inner = depth > top[row]
    up = np.where(inner, first[above] + depth - 1 - low[above], 0)
    known = inner & ~open_[up]
    node, parent = b.id[row, depth], b.id[row, np.maximum(depth - 1, 0)]
    n_ends = ends[right + 1, depth] - ends[left, depth]
    out = {"kind": np.where(open_, OPEN, CLOSED), "depth": s[row] * size + depth, "a": node[:, 0], "b": node[:, 1],
           "up_a": parent[:, 0], "up_b": parent[:, 1], "conv_id": least,
           "parent_conv_id": pa.array(least[up], mask=~known), "n_convs": right - left + 1,
           "n_children": owns[right + 1, depth] - owns[left, depth], "n_leaves": leaves[right + 1] - leaves[left],
           "saved_tokens": saves[right + 1, depth] - saves[left, depth]}
    digest = np.full(len(row), _NO_ENDS, object)
    chunks = []
    for i in np.flatnonzero(n_ends).tolist():
        text = ",".join(map(str, conv[left[i]:left[i] + n_ends[i]].tolist()))
        if open_[i]:
            chunks.append((i, int(conv[left[i]]), text))
        else:
            digest[i] = hashlib.sha256(text.encode()).hexdigest()
    yield out | {"ends": pa.array(digest, pa.string(), mask=open_)}
    if chunks:
        at = np.array([c[0] for c in chunks])
        yield {"kind": np.full(len(at), ENDS)} | {c: out[c][at] for c in ("depth", "a", "b")} | {
            "conv_id": np.array([c[1] for c in chunks]), "ends": pa.array([c[2] for c in chunks], pa.string())}
    at = np.flatnonzero(more | (s > 0))
    if len(at):
        yield {"kind": np.full(len(at), FACTS), "conv_id": conv[at], "s": s[at], "saved_tokens": shared[at],
               "n_children": (lcp[at] <= 0) & (n[at] > 0), "n_leaves": leaf[at]}


def _batch(columns: dict, fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    rows = len(columns["kind"])
    arrays = [pa.nulls(rows, t) if (c := columns.get(name)) is None else
              c.cast(t) if isinstance(c, pa.Array) else pa.array(c).cast(t) for name, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """What the blocks of sorted segment rows give, by ``kind``."""
    longs = pa.int64()
    fields = [("kind", pa.int32()), *[(c, longs) for c in ("depth", "a", "b", "up_a", "up_b", "conv_id", "parent_conv_id", *_SUMS)],
              ("ends", pa.string()), ("part", pa.int32()), ("s", longs), ("key", pa.list_(longs)), ("chars", pa.list_(longs)),
              ("more", pa.bool_())]

    def edge(table: pa.Table, kind: int):
        part = TaskContext.get().partitionId()
        return _batch({"kind": np.array([kind]), "part": np.array([part]), "a": table.column("sa").combine_chunks(),
                       "b": table.column("sb").combine_chunks()}
                      | {c: table.column(c).combine_chunks() for c in ("conv_id", "s", "key", "chars", "more")}, fields)

    def work(batches):
        held, before, start = None, -1, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is None:
                yield edge(table.slice(0, 1), FIRST)
            else:
                table = pa.concat_tables([held, table])
            if table.num_rows > 1:
                b = _Block(table, before)
                for columns in _nodes(b, table.num_rows - 1, start, False, size):
                    yield _batch(columns, fields)
                before, start = int(b.lcp[-1]), False
            held = table.slice(table.num_rows - 1).combine_chunks()
        if held is not None:
            for columns in _nodes(_Block(held, before), 1, start, True, size):
                yield _batch(columns, fields)
            yield edge(held, LAST)

    rows = by_range(rows.select("conv_id", "s", "sa", "sb", "key", "chars", "n", "more"),
                    "s", "sa", "sb", "key", "more", "conv_id")
    return rows.transform(map_arrow, work, _OUT)


def _corrections(edges: list, size: int) -> list[tuple]:
    """(kind, depth, a, b, conv_id, s, n_children, n_leaves, saved_tokens): what the last row of a range
    partition and the first of the next one counted twice."""
    out = []
    edges = sorted(edges, key=lambda r: (r["part"], r["kind"]))
    for x, y in zip(edges[1::2], edges[2::2], strict=False):
        if (x["s"], x["a"], x["b"]) != (y["s"], y["a"], y["b"]):
            continue
        key = list(zip(y["key"][::2], y["key"][1::2], strict=True))
        lcp = 0
        for p, q in zip(zip(x["key"][::2], x["key"][1::2], strict=True), key, strict=False):
            if p != q:
                break
            lcp += 1
        leaf = int(not x["more"] and lcp == len(x["key"]) // 2)
        upto = np.append(0, np.cumsum(y["chars"], dtype=np.int64)).tolist()
        a, b, s = y["a"], y["b"], y["s"]
        for d in range(lcp + 1):
            if d:
                a, b = a ^ key[d - 1][0], b ^ key[d - 1][1]
            if d or not s:
                out.append((OPEN, s * size + d, a, b, None, None, -int(d < lcp), -leaf, upto[lcp] - upto[max(d - 1, 0)]))
        if y["more"] or s:
            out.append((FACTS, None, None, None, y["conv_id"], s, -int(lcp > 0), 0, upto[lcp]))
        if s and leaf:
            out.append((FACTS, None, None, None, x["conv_id"], s, 0, -1, 0))
    return out


def _below(placed: DataFrame, facts: DataFrame, size: int) -> DataFrame:
    """What the segments below add to the nodes of a segment of a long conversation: (node, sums)."""
    facts = facts.groupBy("conv_id", "s").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    last = placed.groupBy("conv_id").agg(F.max("s").alias("last"))
    tails = _running(facts.join(last, "conv_id"), F.col("last") - F.col("s"),
                     {"n_leaves": (F.sum, "n_leaves"), "saved_tokens": (F.sum, "saved_tokens")})
    child = facts.select("conv_id", (F.col("s") - 1).alias("s"), "n_children")
    rows = placed.where("more").join(tails, ["conv_id", "s"]).join(child, ["conv_id", "s"], "left").fillna(0, ["n_children"])

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b, top = r["sa"], r["sb"], 0 if r["s"] == 0 else 1
                ids = [(a, b)] + [(a := a ^ p, b := b ^ q) for p, q in zip(r["key"][::2], r["key"][1::2], strict=True)]
                ids = np.array(ids[top:], np.int64)
                k = len(ids)
                child = np.zeros(k, np.int64)
                child[-1] = r["n_children"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["s"] * size + top + np.arange(k)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(child),
                     pa.array(np.full(k, r["n_leaves"], np.int64)), pa.array(np.full(k, r["saved_tokens"], np.int64))],
                    names=["depth", "a", "b", "n_children", "n_leaves", "saved_tokens"])

    return (rows.select("s", "sa", "sb", "key", "n_children", "n_leaves", "saved_tokens")
            .transform(map_arrow, work, f"{_NODE}, n_children bigint, n_leaves bigint, saved_tokens bigint"))


def _hashed(chunks: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of each node's chunks, joined in the order of their first id."""
    def work(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if (here := (r["depth"], r["a"], r["b"])) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(r["ends"].encode())
                else:
                    state.update(f",{r['ends']}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "a", "b", "ends"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=["depth", "a", "b", "ends"])

    keys = ["depth", "a", "b"]
    return (chunks.select(*keys, "conv_id", "ends").repartition(*keys).sortWithinPartitions(*keys, "conv_id")
            .transform(map_arrow, work, f"{_NODE}, ends string"))


def trie(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node,
    from (conv_id, depth, digest, chars), where a row of depth 0 stands for the conversation."""
    rows, placed = _segments(turns, size)
    found = write_table(_blocks(write_table(rows, "sorted"), size), "blocks")
    spark = found.sparkSession
    edges = [r.asDict() for r in found.where(F.col("kind").isin(FIRST, LAST)).select(
        "kind", "part", "s", "a", "b", "conv_id", "key", "chars", "more").collect()]
    fixes = spark.createDataFrame(_corrections(edges, size), "kind int, depth bigint, a bigint, b bigint, conv_id bigint, "
                                  "s bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")
    keys, sums = ["depth", "a", "b"], ["n_children", "n_leaves", "saved_tokens"]
    parts = (found.where(F.col("kind") == OPEN).select(*keys, "up_a", "up_b", "conv_id", *_SUMS)
             .unionByName(fixes.where(F.col("kind") == OPEN).select(*keys, *sums), allowMissingColumns=True))
    if placed is not None:
        facts = (found.where(F.col("kind") == FACTS).select("conv_id", "s", *sums)
                 .unionByName(fixes.where(F.col("kind") == FACTS).select("conv_id", "s", *sums)))
        parts = parts.unionByName(_below(placed, facts, size), allowMissingColumns=True)
    open_ = parts.groupBy(*keys).agg(F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"),
                                     *[F.sum(c).alias(c) for c in _SUMS])
    ends = _hashed(found.where(F.col("kind") == ENDS))
    open_ = write_table(open_.join(ends, keys, "left").fillna(_NO_ENDS, ["ends"]), "open")
    closed = found.where(F.col("kind") == CLOSED)
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, F.col("ends").alias("ends_sha256")]
    parents = open_.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    rest = ["depth", "up_a", "up_b", "conv_id", *_SUMS, "ends"]
    hanging = closed.where("parent_conv_id is null and depth > 0").select(*rest).unionByName(open_.select(*rest))
    hanging = hanging.join(parents, ["depth", "up_a", "up_b"], "left")
    return closed.where("parent_conv_id is not null or depth = 0").select(*columns).unionByName(hanging.select(*columns))
