"""Operator 11 against brute force, with blocks and segments of few rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chronoframe.llm import convtrie
from chronoframe.llm.common import write_table

TURN = "conv_id long, turn long, role string, text string"


def brute(rows, group=100, modulus=6):
    own = {}
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    for c, *t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], order(r[1:4]))):
        own.setdefault(c, []).append((t[1] or "", t[2] or ""))
    conv = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        conv[c] = tuple(own.get(c - int(np.fmod(c, group)), [])[:h] + turns[h:])
    members = {}
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            members.setdefault(conv[c][:d], []).append(c)
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p, m in members.items():
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in m if len(conv[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def found(spark, rows, size=convtrie.SEGMENT, schema=TURN):
    table = write_table(spark.createDataFrame(rows, schema).repartition(3), "turns")
    return sorted((tuple(r) for r in convtrie.trie(convtrie.rebuilt(convtrie.ordered_turns(table)), size).collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        k = rng.choice([1, 2, 3, longest])
        same = rng.random() < 0.5
        for t in range(k):
            text = "ab" if same else rng.choice(["", "x", "yy", "zé", None])
            out.append((c * rng.choice([1, 1, 7]), rng.choice([t, t, None]), rng.choice(["user", "user", None]), text))
    return out


@pytest.mark.parametrize("size,seed", [(64, 1), (2, 2), (1, 3), (3, 4)])
def test_brute_force(spark, size, seed):
    rows = conversations(seed, 150, 9)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, size) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_copies_and_long_conversations(spark):
    """A group of copies over several partitions, two copies of a conversation of many segments (and of
    several blocks of the prefix sums), and one that goes on where a full segment of another ends."""
    rows = [(100 * c + 100, t, "user", f"copy {t}") for c in range(60) for t in range(5)]
    rows += [(c, t, "user", f"turn {t}") for c in (1, 100001) for t in range(300)]
    rows += [(100005, t, "user", f"copy {t}") for t in range(4)]
    old = convtrie.SCAN
    convtrie.SCAN = 16
    try:
        assert found(spark, rows, 4) == brute(rows)
    finally:
        convtrie.SCAN = old


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (-7, None, None, None), (-7, None, "a", "b"), (-7, 1, "a", "b"), (-7, 1, "a", "b"),
            (0, 0, "user", "x" * 100_000), (0, 1, "user", ""), (3, 0, "user", "x" * 100_000), (400, 1, "u", "t"), (455, 1, "u", "t")]
    wide = [(*r, 1, "s", 2) for r in rows]
    assert found(spark, wide, 64, TURN + ", digest long, key string, s long") == brute(rows)
    assert found(spark, [], 64) == []
    assert found(spark, [(None, 1, "user", "lost")], 64) == []


def test_extents_search_both_ways():
    rng = np.random.default_rng(5)
    lcp = rng.integers(0, 4, 200)
    table = convtrie.sparse_table(lcp)
    row, depth = np.arange(200), rng.integers(0, 5, 200)
    left, right = convtrie.extents(table, row, depth)
    for i, d, lo, hi in zip(row, depth, left, right, strict=True):
        a = b = i
        while a > 0 and lcp[a] >= d:
            a -= 1
        while b < 199 and lcp[b + 1] >= d:
            b += 1
        assert (a, b) == (lo, hi)
    lo, hi = np.minimum(row, row[::-1]), np.maximum(row, row[::-1])
    assert convtrie.range_min(table, lo, hi).tolist() == [lcp[a:b + 1].min() for a, b in zip(lo, hi, strict=True)]
