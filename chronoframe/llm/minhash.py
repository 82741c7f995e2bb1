"""Operator 1: near-duplicate documents by a Chosen Path set similarity join.

1. Every whole text becomes its set of word shingles, ``PLACES`` minwise tokens, a sketch of the low bytes
   of ``SKETCH`` of them, and a 128-bit digest of the set.  Equal sets are one class, named by its smallest doc_id.
2. ``TREES`` trees branch the classes: a node picks one of the places, or for a
   quarter of the nodes two (1.25 on average, which for pairs at 0.8 keeps one expected path per
   level), by a hash of its path, and its members go to children by their minwise token there.  A node
   of at most ``LEAF`` members is compared exhaustively by sketches.  A larger one is compared in parts of
   about ``LEAF`` that all hold the node's hubs (about eight members).  Members that no candidate of their part
   ties to the main hubs are open: up to ``LEAF`` open ones are compared with every part, which ends the node,
   as the others are tied together already; so a group of near copies doesn't branch.  Nodes with more
   branch again, whole, down to ``DEPTH`` levels.  Members of a node that is still larger agree on that many
   minwise tokens in a row and count as candidates of each other, by one minimum per node.
   A pair at 0.8 meets in a tree with probability 0.73 at two levels and 0.58 at all four.  The trees share
   the places, so a pair whose tokens agree at few of them is missed by several trees together: all of
   them missed 99 of 1,000,000 isolated pairs at 0.8 in the deepest nodes (measured on random sets of 45),
   and far fewer elsewhere.
3. Candidates form coarse groups (connected components).  The full sets of a group's members meet, in
   chunks of about ``CHUNK``, and only links confirmed on the full sets count.  In a group of several
   chunks every chunk also holds the group's hubs (about eight members).  Members that aren't tied in
   their chunk to the main hub, the one with the most members, are then compared with every chunk, so
   that no link between different components is left out, while the members that are tied together
   aren't compared pair by pair.
4. The components of the confirmed links are the result.

Nothing is collected.  A hot class is one row; node and group sizes are counted before rows move.

Cases: null texts and texts without words have an empty set and link with nothing; texts with fewer
words than a shingle are one shingle; a row without id gets its n_shingles, a null component and
kept = false; repeated rows are members of the same class; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, forest, map_arrow, mix, runs, series, starts_of, write_table
from .graph import components
from .words import hashes, spans, utf8

PLACES = 96
SKETCH = 64
TREES = 14
LEAF = 100
DEPTH = 4
#: Equal bytes of two sketches from which a pair is a candidate: four standard deviations under 0.8.
AGREE = 37
CHUNK = 256
HUBS = 8
#: UTF-8 bytes of text that are sketched at once: the arrays of their shingles stay in a core's cache.
TEXT_BYTES = 1 << 18

_BLANK = np.ones(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TIMES, _PLUS = series(11, PLACES) | np.uint64(1), series(12, PLACES)
_ORDER = series(13, 64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the sorted distinct shingle hashes of each text of a string column."""
    raw, rows = utf8(column)
    raw = _LOWER[raw]
    mask = _BLANK[raw]
    starts, ends = spans(mask, rows)
    word = hashes(raw, mask, starts, ends)
    row = np.searchsorted(rows, starts, "right") - 1
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    order = series(13, size) | np.uint64(1) if size > len(_ORDER) else _ORDER
    out = []
    with np.errstate(over="ignore"):
        m = max(0, len(word) - size + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(size):
            rolled += word[k:k + m] * order[k]
        rolled = mix(rolled)
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= size:
                out.append(_distinct(rolled[f:f + n - size + 1]))
            elif n:
                out.append(mix((word[f:f + n] * order[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    lengths = [len(x) for x in out]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: ``np.unique`` hashes integers before it sorts them, which takes six times as long."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _rows(matrix: np.ndarray) -> list[bytes]:
    width = matrix.shape[1] * matrix.itemsize
    flat = np.ascontiguousarray(matrix).tobytes()
    return [flat[i:i + width] for i in range(0, len(flat), width)]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, tokens, sketch): the digest of the set, its minwise tokens, and the
    low bytes of the first ``SKETCH``."""
    def work(batches):
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            values, offsets = shingle_sets(batch.column("text"), size)
            n = np.diff(offsets)
            full = n > 0
            at = offsets[:-1][full]
            tokens = np.zeros((len(n), PLACES), np.uint32)
            digest = np.zeros((len(n), 2), np.uint64)
            if len(at):
                turned = np.empty_like(values)
                with np.errstate(over="ignore"):
                    for i in range(PLACES):
                        np.multiply(values, _TIMES[i], out=turned)
                        np.add(turned, _PLUS[i], out=turned)
                        tokens[full, i] = np.minimum.reduceat(turned, at) >> np.uint64(32)
                    for i in range(2):
                        digest[full, i] = np.add.reduceat(mix(values + np.uint64(i + 1)), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), *[pa.array(digest[:, i].view(np.int64), mask=~full) for i in (0, 1)],
                 pa.array(_rows(tokens), pa.binary()), pa.array(_rows(tokens[:, :SKETCH].astype(np.uint8)), pa.binary())],
                names=["id", "n_shingles", "c1", "c2", "tokens", "sketch"])

    return (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
            .transform(map_arrow, work, "id bigint, n_shingles bigint, c1 bigint, c2 bigint, tokens binary, sketch binary")
            .withColumnRenamed("id", "doc_id"))


def children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, child): the children to which each member, at the node ``path``, goes."""
    with np.errstate(over="ignore"):
        one = mix(path + np.uint64(1)) % np.uint64(PLACES)
        two = (one + np.uint64(1) + mix(path + np.uint64(2)) % np.uint64(PLACES - 1)) % np.uint64(PLACES)
        both = np.flatnonzero(mix(path + np.uint64(3)) < np.uint64(1 << 62))
        member = np.concatenate([np.arange(len(path)), both])
        place = np.concatenate([one, two[both]])
        token = tokens[member, place.astype(np.int64)].astype(np.uint64)
        return member, mix(path[member] * np.uint64(3) + mix((place << np.uint64(32)) + token + np.uint64(1)))


def _branch(members: DataFrame, trees: int | None) -> DataFrame:
    """(node, rep) one level below: ``members`` has rep, tokens and, but for the roots, node."""
    def work(batches):
        for batch in by_bytes(batches, "tokens", 1 << 20):
            tokens, rep = _matrix(batch.column("tokens"), np.uint32), batch.column("rep").to_numpy()
            if trees is None:
                paths = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                paths = [np.full(len(rep), p) for p in series(21, trees)]
            for path in paths:
                member, child = children(path, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[member])],
                                                 names=["node", "rep"])

    return members.transform(map_arrow, work, "node bigint, rep bigint")


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal bytes in each row of two matrices of bytes, whose width is a multiple of eight: the flags are summed
    eight at a time, as the bytes of one integer."""
    flags = (a == b).view(np.uint64)
    total = flags[:, 0].copy()
    for k in range(1, flags.shape[1]):
        total += flags[:, k]
    with np.errstate(over="ignore"):
        return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _close(sketch: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): the candidate pairs by sketch within each of the groups that start at ``begin``.  The second half of
    two sketches is compared only where the first leaves ``AGREE`` within reach, which unrelated ones seldom do."""
    n, half = len(sketch), SKETCH // 2
    head, tail = np.ascontiguousarray(sketch[:, :half]), np.ascontiguousarray(sketch[:, half:])
    last = np.repeat(np.array([*begin[1:], n], np.int64), np.diff([*begin, n]))  # the end of each row's group
    left, right = [], []
    here = np.arange(n)
    step = 0
    while len(here):
        step += 1
        here = here[here + step < last[here]]
        there = here + step
        some = _agreeing(head.take(here, 0), head.take(there, 0))
        maybe = np.flatnonzero(some >= AGREE - (SKETCH - half))
        close = here[maybe]
        close = close[some[maybe] + _agreeing(tail.take(close, 0), tail.take(close + step, 0)) >= AGREE]
        left.append(close)
        right.append(close + step)
    return np.concatenate(left), np.concatenate(right)


def _leaf_links(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): a forest of the candidate pairs within each group of (keys, rep, sketch)."""
    def work(batches):
        for table in runs(batches, keys):
            rep = table.column("rep").to_numpy()
            sketch = _matrix(table.column("sketch").combine_chunks(), np.uint8)
            root = forest(len(rep), *_close(sketch, starts_of(*(table.column(k).to_numpy() for k in keys))))
            moved = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], names=["a", "b"])

    return (leaves.select(*keys, "rep", "sketch").repartition(*keys).sortWithinPartitions(*keys, "rep")
            .transform(map_arrow, work, "a bigint, b bigint"))


def main_hubs(hub: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hub of each group's largest set of hubs that candidate pairs between hubs tie together, of equal ones
    that with the first hub; -1 in groups without hubs.  Hubs alone decide, so all parts of a node agree."""
    both = hub[left] & hub[right]
    root = forest(len(hub), left[both], right[both])
    size = np.bincount(root[hub], minlength=len(hub))
    size[~hub] = 0
    main = []
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(hub)], strict=True):
        best = s + int(size[s:e].argmax())
        main.append(best if size[best] else -1)
    return np.array(main, np.int64)


def _part_links(parts: DataFrame) -> DataFrame:
    """(node, a, b, open) from (node, part, rep, hub, own, sketch), ``own`` false for the hubs of other parts: a forest of
    the candidate pairs within each part, and the members a that it doesn't tie to the main hubs."""
    def work(batches):
        for table in runs(batches, ["node", "part"]):
            node, rep = table.column("node").to_numpy(), table.column("rep").to_numpy()
            hub, own = (table.column(k).to_numpy().astype(bool) for k in ("hub", "own"))
            begin = starts_of(node, table.column("part").to_numpy())
            left, right = _close(_matrix(table.column("sketch").combine_chunks(), np.uint8), begin)
            root = forest(len(rep), left, right)
            main = np.repeat(main_hubs(hub, begin, left, right), np.diff([*begin, len(rep)]))
            open_ = own & ((main < 0) | (root != root[main]))
            out = np.flatnonzero(open_ | (root != np.arange(len(rep))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (node[out], rep[out], rep[root[out]], open_[out])], names=["node", "a", "b", "open"])

    return (parts.select("node", "part", "rep", "hub", "own", "sketch").repartition("node", "part")
            .sortWithinPartitions("node", "part", "rep").transform(map_arrow, work, "node bigint, a bigint, b bigint, open boolean"))


def _every_part(members: DataFrame) -> DataFrame:
    """Each row in every part of its node but its own."""
    return (members.withColumn("at", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .where("part <> at").drop("at").withColumn("own", F.lit(False)))


def _settle(large: DataFrame, reps: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) within nodes of more than ``leaf`` members, and (node) of those which must branch: the
    links connect all similar members of the others.  ``large``: (node, rep, n)."""
    members = write_table(
        large.join(reps.select("rep", "sketch"), "rep").withColumn("parts", F.ceil(F.col("n") / leaf).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep", F.lit(34)), F.col("parts")).cast("int"))
        .withColumn("hub", F.pmod(F.xxhash64("rep", F.lit(35)), F.greatest(F.lit(1), F.floor(F.col("n") / HUBS))) == 0)
        .withColumn("own", F.lit(True)), "parts")
    found = write_table(_part_links(members.unionByName(_every_part(members.where("hub")))), "parted")
    links = [found.where("a <> b").select("a", "b")]
    open_ = found.where("open").select("node", F.col("a").alias("rep"))
    counts = write_table(open_.groupBy("node").agg(F.count("*").alias("m")), "open_nodes")
    few = counts.where(F.col("m") <= leaf).select("node")
    if not few.isEmpty():
        theirs = members.join(few, "node", "left_semi")
        links.append(_leaf_links(theirs.unionByName(_every_part(theirs.join(open_, ["node", "rep"], "left_semi"))),
                                 ["node", "part"]))
    return links, counts.where(F.col("m") > leaf).select("node")


def candidates(reps: DataFrame, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(a, b): links that connect all classes which met as similar in a node of some tree."""
    small, links = [], []
    rows = _branch(reps.select("rep", "tokens"), trees)
    for level in range(1, depth + 1):
        rows = write_table(rows, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = write_table(rows.join(sizes, "node"), "nodes")
        small.append(rows.where(F.col("n") <= leaf))
        large = rows.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        if level == depth:
            least = large.groupBy("node").agg(F.min("rep").alias("low"))
            links.append(large.join(least, "node").select(F.col("rep").alias("a"), F.col("low").alias("b")))
        else:
            tied, mixed = _settle(large, reps, leaf)
            links += tied
            if mixed.isEmpty():
                break
            large = large.join(mixed, "node", "left_semi")
            rows = _branch(large.join(reps.select("rep", "tokens"), "rep").select("node", "rep", "tokens"), None)
    leaves = reduce(DataFrame.union, small).select("node", "rep").join(reps.select("rep", "sketch"), "rep")
    return reduce(DataFrame.union, links, _leaf_links(leaves, ["node"]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _partners(sets: list[np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """For each set the earlier ones with which it can share enough: all that have one of its rarest values among their own
    rarest.  Of a set of n values every linked set holds at least percent of n, so in one order for all, the first
    n - percent of n + 1 values of two linked sets have a value in common.  Nothing that is linked is left out."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    key = often[value] * len(often) + value  # rare values first
    first = np.minimum(lengths, lengths + (-percent * lengths) // 100 + 1).tolist()
    ends = np.cumsum(lengths).tolist()
    held = [np.partition(key[e - k:e], f - 1)[:f] if f else key[:0] for e, k, f in zip(ends, lengths.tolist(), first, strict=True)]
    held = [h[h >= 2 * len(often)] for h in held]  # a value of one set alone leads nowhere
    keys, owner = np.concatenate(held), np.repeat(np.arange(n), [len(h) for h in held])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    none = np.flatnonzero(lengths == 0)
    for i, h in enumerate(held):
        begin, end = np.searchsorted(keys, h).tolist(), np.searchsorted(keys, h, "right").tolist()
        mine = np.zeros(n, bool)
        for s, e in zip(begin, end, strict=True):
            mine[owner[s:e]] = True
        if not lengths[i]:
            mine[none] = True
        yield np.flatnonzero(mine[:i])


def _ties(sets: list[np.ndarray], side: np.ndarray, percent: int, few: int = 16) -> np.ndarray:
    """Smallest linked index of each set.  Members of one component aren't compared again; with two
    sides only pairs across them are.  Equal sets of a side are compared once, and of more than ``few`` sets only
    those that can be linked."""
    seen: dict[tuple[int, bytes], int] = {}
    equal = np.array([seen.setdefault((s, x.tobytes()), i) for i, (s, x) in enumerate(zip(side.tolist(), sets, strict=True))])
    own = np.flatnonzero(equal == np.arange(len(sets)))
    there, theirs = [sets[i] for i in own], side[own]
    partners = _partners(there, percent) if len(own) > few else (np.arange(i) for i in range(len(own)))
    found = np.arange(len(own))
    for i, other in enumerate(partners):
        other = other[(theirs[other] != theirs[i]) | (theirs[i] == 0)]
        while len(other := other[found[other] != found[i]]):
            m, other = other[0], other[1:]
            if linked(there[i], there[m], percent):
                low, high = sorted((found[i], found[m]))
                found[found == high] = low
    root = np.arange(len(sets))
    root[own] = own[found]
    # Equal sets of one of two sides are tied by what both are linked to alone.
    tied = (theirs == 0) | (np.bincount(found, minlength=len(own))[found] > 1)
    at = np.searchsorted(own, equal)
    return np.where(tied[at], root[equal], root)


def _confirmed(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(keys, a, b): each member a of a group of (keys, rep, side, shingles) and the smallest member b
    that confirmed links within the group tie it to, itself if none."""
    def work(batches):
        for table in runs(batches, keys):
            begin = starts_of(*(table.column(k).to_numpy() for k in keys)).tolist()
            rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
            sets = table.column("shingles")
            root = np.concatenate([
                s + _ties([np.frombuffer(x, np.uint64) for x in sets.slice(s, e - s).to_pylist()], side[s:e], percent)
                for s, e in zip(begin, [*begin[1:], len(rep)], strict=True)])
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in keys), pa.array(rep), pa.array(rep[root])],
                                             names=[*keys, "a", "b"])

    fields = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)
    return (members.select(*keys, "rep", "side", "shingles").repartition(*keys).sortWithinPartitions(*keys, "rep")
            .transform(map_arrow, work, f"{fields}, a bigint, b bigint"))


def _open(first: DataFrame, several: DataFrame, hubs: DataFrame) -> DataFrame:
    """(grp, rep): members of groups of several chunks that no link within their chunk ties to the main
    hub, which is the hub with the most members tied to it."""
    tied = first.join(several.select("grp").distinct(), "grp", "left_semi")
    sizes = tied.groupBy("grp", "chunk", "b").agg(F.count("*").alias("k"))
    places = (tied.join(hubs.select("grp", F.col("rep").alias("a")).distinct(), ["grp", "a"])
              .select("grp", "chunk", "b", F.col("a").alias("hub")))
    main = (places.join(sizes, ["grp", "chunk", "b"]).groupBy("grp", "hub").agg(F.sum("k").alias("k"))
            .groupBy("grp").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub")))
    held = places.join(main, ["grp", "hub"]).select("grp", "chunk", "b")
    return (tied.join(several.select("grp", "chunk", F.col("rep").alias("a")), ["grp", "chunk", "a"], "left_semi")
            .join(held, ["grp", "chunk", "b"], "left_anti").select("grp", F.col("a").alias("rep")))


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(grp, n, rep, shingles) from (grp, n, rep, text)."""
    def work(batches):
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            values, offsets = shingle_sets(batch.column("text"), size)
            flat = values.tobytes()
            sets = [flat[8 * a:8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())],
                                             names=["grp", "n", "rep", "shingles"])

    return docs.transform(map_arrow, work, "grp bigint, n bigint, rep bigint, shingles binary")


def confirm(docs: DataFrame, coarse: DataFrame, size: int, percent: int, id_col: str, text_col: str,
            chunk: int = CHUNK) -> DataFrame:
    """(node, component) of the links confirmed on full sets.  ``coarse``: (node, component)."""
    groups = coarse.groupBy("component").agg(F.count("*").alias("n"))
    named = coarse.join(groups, "component").select(F.col("node").alias("rep"), F.col("component").alias("grp"), "n")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    # A sort-merge join at every size: a broadcast of the members would grow with the documents.
    joined = texts.join(named.hint("merge"), "rep").select("grp", "n", "rep", "text")
    chunks = F.ceil(F.col("n") / chunk)
    members = write_table(
        _full_sets(joined, size).withColumn("chunks", chunks.cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(31)), F.col("chunks")).cast("int")), "members")
    hubs = (members.where((F.col("chunks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(32)), F.floor(F.col("n") / HUBS)) == 0))
            .withColumn("own", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .where("chunk <> own").drop("own"))
    first = write_table(_confirmed(members.unionByName(hubs).withColumn("side", F.lit(0)), ["grp", "chunk"], percent),
                        "confirmed")
    several = members.where("chunks > 1")
    if several.isEmpty():
        return components(first)
    open_ = write_table(_open(first, several, hubs), "open")
    if open_.isEmpty():
        return components(first)
    blocks = (open_.groupBy("grp").agg(F.count("*").alias("m"))
              .select("grp", F.ceil(F.col("m") / chunk).cast("int").alias("blocks")))
    theirs = several.join(blocks, "grp")
    left = (theirs.join(open_, ["grp", "rep"], "left_semi")
            .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(33)), F.col("blocks")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1)))
    right = theirs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(2))
    second = _confirmed(left.unionByName(right), ["grp", "chunk", "block"], percent)
    return components(first.select("a", "b").union(second.select("a", "b")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = TREES,
                    leaf: int = LEAF, depth: int = DEPTH, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    rows = write_table(sketches(docs, words, id_col, text_col), "sketches")
    classes = (rows.where("c1 is not null and doc_id is not null").groupBy("c1", "c2")
               .agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    classes = write_table(classes, "classes")
    coarse = components(candidates(classes.select("rep", "tokens", "sketch"), trees, leaf, depth))
    fine = confirm(docs, coarse, words, percent, id_col, text_col, chunk)
    named = (classes.select("c1", "c2", "rep").join(fine, F.col("rep") == F.col("node"), "left")
             .select("c1", "c2", F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of near-duplicate rows the one with the smallest id (null last), with its columns.  Rows are told
    apart by a 64-bit hash of id and text, so texts that share an id, or have none, are documents each; rows that
    are equal in both are one document."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col).isNull(), id_col, text.isNull(), text).alias("key")
    found = near_duplicates(docs.select(key, text.alias("text")), words, percent, id_col="key").select(
        F.col("doc_id").alias("key"), F.col("component_id").alias("grp"))
    ids = docs.select(key, F.col(id_col).alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    kept = (found.distinct().join(ids, "key").groupBy("grp").agg(F.min(order).alias("best"))
            .select(F.col("best.key").alias("key")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key).dropDuplicates(["key"])
    return rows.join(kept, "key", "left_semi").select("row.*")
