"""Operator 10: embedding near-duplicates by an epsilon grid order join.

Vectors are turned to principal axes (fitted on a bounded sample) and sorted by their grid cells, of
width epsilon, on the ``GRID_AXES`` leading ones; epsilon is the distance of unit vectors at the wanted
cosine.  The sequence is cut into blocks of about ``BLOCK`` vectors, with the bounds of each block on the
leading ``BOUND_AXES`` axes and of the norm of the rest.  The join starts from the whole sequence with
itself and halves into intervals ``FAN`` at a time, as joins with the table of interval bounds; a pair of
intervals whose bounds are provably further apart than epsilon is dropped.  The pairs of blocks that are
left are joined in tasks, in tiles of ``TILE`` by ``TILE`` blocks, so that a block is sent once per tile and not
once per partner: again by sub-blocks with their bounds, then a matrix product in single
precision with a margin, and the cosine in double precision wherever it is within the margin.

Equal vectors are one vector with a count.  A block pair returns at most one row per vector, with its
number of links there and the smallest vector it is tied to there, never the pairs.

On vectors without structure (nearly equal variances on all axes) few blocks are provably distant, and
the join is quadratic in single precision; the result is the same.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing
(n_links 0, component_id = vec_id); a row without vec_id links with nothing and has a null component;
vectors of unequal length compare as if padded with zeros; repeated rows link with each other; rows that
share a vec_id are one vertex; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest, map_arrow, runs, starts_of, write_table
from .graph import components

BLOCK = 4096
SUB_BLOCK = 512
#: Blocks on each side of the pairs that one task joins.
TILE = 4
FAN = 8
GRID_AXES = 6
BOUND_AXES = 12
SAMPLE_BYTES = 16 << 20
#: Cosines this close to the threshold in single precision are computed in double precision.
MARGIN = 1e-4


def valid(vector):
    """Whether a vector column can link: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of a sample of at most SAMPLE_BYTES, the leading first."""
    n = max(width, SAMPLE_BYTES // (8 * width))
    sample = vectors.select("vector").orderBy(F.xxhash64("rep", F.lit(41))).limit(n).toArrow()
    if not sample.num_rows:
        return np.eye(width)
    x = _unit(_padded(sample.column("vector"), width))
    x -= x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def _bounds(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of rotated vectors: leading axes and the norm of the rest."""
    lead = y[:, :BOUND_AXES]
    rest = np.linalg.norm(y[:, BOUND_AXES:], axis=1, keepdims=True)
    z = np.concatenate([lead, rest], axis=1)
    return z.min(axis=0), z.max(axis=0)


def _blocks(vectors: DataFrame, turn, width: int, eps: float, block: int) -> tuple[DataFrame, int]:
    """Blocks of the vectors in grid order, (block, ids, copies, data, lo, hi), and their number."""
    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                y = _unit(_padded(batch.column("vector"), width)) @ turn.value[:, :GRID_AXES]
                cell = np.floor(y / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), cell.shape[1])
                     .cast(pa.list_(pa.int32())), pa.array(y[:, 0])],
                    names=[*batch.schema.names, "cell", "lead"])

    kind = vectors.schema["vector"].dataType.simpleString()
    order = ["cell", "lead", "rep"]
    seq = write_table(
        vectors.select("rep", "copies", "vector")
        .transform(map_arrow, cells, f"rep bigint, copies bigint, vector {kind}, cell array<int>, lead double")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("rep", "copies", "vector", F.monotonically_increasing_id().alias("at")), "vector-sequence")
    # The place in the whole sequence, from the row count of each partition; then blocks of one size.
    part = F.shiftright("at", 33).cast("int")
    offset, total = {}, 0
    for r in sorted(seq.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offset[r["part"]] = total
        total += r["n"]
    known = seq.sparkSession.createDataFrame(list(offset.items()), "part int, before bigint")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = (seq.withColumn("part", part).join(known, "part").withColumn("place", place)
              .withColumn("block", F.floor(F.col("place") / block).cast("int")))
    n_blocks = -(-total // block)

    def pack(batches):
        for table in runs(batches, ["block"]):
            begin = starts_of(table.column("block").to_numpy()).tolist()
            for s, e in zip(begin, [*begin[1:], table.num_rows], strict=True):
                rows = table.slice(s, e - s)
                raw = _padded(rows.column("vector"), width)
                lo, hi = _bounds(_unit(raw) @ turn.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("block")[0].as_py()], pa.int32()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (
                         rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), raw.astype(dtype))],
                     pa.array([lo.tolist()], pa.list_(pa.float64())), pa.array([hi.tolist()], pa.list_(pa.float64()))],
                    names=["block", "ids", "copies", "data", "lo", "hi"])

    dtype = "<f4" if "float" in kind else "<f8"
    packed = (placed.select("block", "place", "rep", "copies", "vector").repartition(max(1, n_blocks), "block")
              .sortWithinPartitions("block", "place")
              .transform(map_arrow, pack, "block int, ids binary, copies binary, data binary, "
                                          "lo array<double>, hi array<double>"))
    return write_table(packed, "vector-blocks"), n_blocks


def interval_join(blocks: DataFrame, total: int, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks that aren't provably further apart than eps."""
    spark = blocks.sparkSession
    dims = range(BOUND_AXES + 1)
    flat = write_table(blocks.select("block", *[F.get("lo", F.lit(i)).alias(f"lo{i}") for i in dims],
                                     *[F.get("hi", F.lit(i)).alias(f"hi{i}") for i in dims]), "vector-bounds")
    levels = max(1, math.ceil(math.log(max(total, 2), FAN) - 1e-9))
    pairs = spark.createDataFrame([(0, 0)] if total else [], "a int, b int")
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("block") / FAN ** level).cast("int")
        bounds = flat.groupBy(node.alias("node")).agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in dims],
                                                      *[F.max(f"hi{i}").alias(f"hi{i}") for i in dims])
        child = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = (pairs.withColumn("i", F.explode(child)).withColumn("j", F.explode(child))
                 .select((F.col("a") * FAN + F.col("i")).alias("a"), (F.col("b") * FAN + F.col("j")).alias("b"))
                 .where("a <= b"))
        x = bounds.select(F.col("node").alias("a"), *[F.col(f"{s}{i}").alias(f"x{s}{i}") for s in ("lo", "hi") for i in dims])
        y = bounds.select(F.col("node").alias("b"), *[F.col(f"{s}{i}").alias(f"y{s}{i}") for s in ("lo", "hi") for i in dims])
        gap2 = F.lit(0.0)
        for i in dims:
            gap = F.greatest(F.col(f"xlo{i}") - F.col(f"yhi{i}"), F.col(f"ylo{i}") - F.col(f"xhi{i}"), F.lit(0.0))
            gap2 = gap2 + gap * gap
        pairs = pairs.join(x, "a").join(y, "b").where(gap2 <= (eps + 1e-6) ** 2).select("a", "b")
    return pairs


def join_blocks(a, b, width: int, turn: np.ndarray, cosine: float, eps: float, same: bool):
    """Links between two blocks (ids, copies, raw vectors): (ids, links, smallest tied id) of the
    vectors that have any."""
    (ids_a, n_a, raw_a), (ids_b, n_b, raw_b) = a, b
    unit_a, unit_b = _unit(raw_a), _unit(raw_b)
    low_a, low_b = unit_a.astype(np.float32), unit_b.astype(np.float32)
    boxes = [[_bounds(u[s:s + SUB_BLOCK] @ turn) for s in range(0, len(u), SUB_BLOCK)] for u in (unit_a, unit_b)]
    shift = 0 if same else len(ids_a)
    left, right = [], []
    links = np.zeros(len(ids_a) + (0 if same else len(ids_b)), np.int64)
    root = np.arange(len(links))
    for i, (alo, ahi) in enumerate(boxes[0]):
        for j, (blo, bhi) in enumerate(boxes[1]):
            if same and j < i:
                continue
            gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
            if (gap * gap).sum() > (eps + 1e-6) ** 2:
                continue
            s, t = i * SUB_BLOCK, j * SUB_BLOCK
            dots = low_a[s:s + SUB_BLOCK] @ low_b[t:t + SUB_BLOCK].T
            p, q = np.nonzero(dots >= cosine - MARGIN)
            if same and i == j:
                p, q = p[q > p], q[q > p]
            near = np.flatnonzero(dots[p, q] < cosine + MARGIN)
            x, y = p + s, q + t
            fine = np.ones(len(x), bool)
            fine[near] = np.einsum("ij,ij->i", unit_a[x[near]], unit_b[y[near]]) >= cosine
            x, y = x[fine], y[fine]
            if len(x):
                links += np.bincount(x, n_b[y], len(links)).astype(np.int64)
                links += np.bincount(y + shift, n_a[x], len(links)).astype(np.int64)
                left.append(x)
                right.append(y + shift)
                if sum(map(len, left)) > 1 << 20:
                    root = forest(len(links), np.concatenate([root, *left]), np.concatenate([np.arange(len(root)), *right]))
                    left, right = [], []
    root = forest(len(links), np.concatenate([root, *left]), np.concatenate([np.arange(len(root)), *right]))
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    at = np.flatnonzero(links)
    least = ids.copy()
    np.minimum.at(least, root, ids)
    return ids[at], links[at], least[root[at]]


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, block: int = BLOCK,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    eps = math.sqrt(2 - 2 * cosine)
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("vector", F.when(valid(F.col("vector")) & F.col("vec_id").isNotNull(), F.col("vector")))
    classes = write_table(rows.where("vector is not null").groupBy("vector")
                          .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    width = classes.agg(F.max(F.size("vector")).alias("w")).first()["w"] or 1
    turn = embeddings.sparkSession.sparkContext.broadcast(axes(classes, width))
    blocks, total = _blocks(classes, turn, width, eps, block)
    pairs = interval_join(blocks, total, eps)
    kind = "<f4" if "float" in rows.schema["vector"].dataType.simpleString() else "<f8"

    def block_of(row) -> tuple:
        return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64),
                np.frombuffer(row["data"], kind).reshape(-1, width).astype(np.float64))

    def work(batches):
        tile, left = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["ta"], row["tb"]) != tile:
                    tile, left = (row["ta"], row["tb"]), {}
                if row["partners"] is None:  # the left side of a tile comes first
                    left[row["block"]] = block_of(row)
                    continue
                right = block_of(row)
                for a in sorted(row["partners"]):
                    ids, links, root = join_blocks(left[a], right, width, turn.value, cosine, eps, a == row["block"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)],
                                                     names=["rep", "n", "root"])

    tiled = write_table(pairs.withColumns({"ta": F.floor(F.col("a") / TILE).cast("int"), "tb": F.floor(F.col("b") / TILE).cast("int")}),
                        "vector-pairs")
    none = F.lit(None).cast("array<int>").alias("partners")
    sides = (tiled.select("ta", "tb", F.col("a").alias("block"), none).distinct()
             .unionByName(tiled.groupBy("ta", "tb", F.col("b").alias("block")).agg(F.collect_list("a").alias("partners"))))
    n_tiles = -(-total // TILE)
    joined = (sides.join(blocks.select("block", "ids", "copies", "data"), "block")
              .repartition(max(1, min(4 * n_tiles * (n_tiles + 1), 20_000)), "ta", "tb")
              .sortWithinPartitions("ta", "tb", F.col("partners").isNotNull(), "block"))
    found = write_table(joined.transform(map_arrow, work, "rep bigint, n bigint, root bigint"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("links"))
    tied = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (classes.join(counts, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
             .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(named, "vector", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
