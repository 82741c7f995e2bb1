"""Operator 13 against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import resample
from chronoframe.llm.common import read, write_table

from .conftest import SF


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(rows, target, percent=25, min_words=20):
    s, t = np.zeros(10000), np.zeros(10000)
    parsed = [(d, *features(x)) for d, x in rows]
    for _, _, f in parsed:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    out = []
    for d, w, f in parsed:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def check(spark, docs, target, **options):
    got = resample.resample(docs, target, **options)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [r[0] for r in target.select("text").collect()], **options)


def test_documents(spark, docs):
    check(spark, docs, read(spark, SF, "benchmark"))


def test_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    for percent in (0, 25, 60, 100):
        check(spark, odd, target, percent=percent, min_words=1)
    check(spark, odd, target.limit(0))
    assert resample.resample(empty, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resample.resample(empty, target).count() == 0


def test_repeated_rows_at_the_last_place(spark):
    """The k-th key belongs to many equal rows: exactly k are ranked."""
    text = " ".join(["word"] * 30)
    docs = spark.createDataFrame([(1, text)] * 40 + [(i, text + f" w{i}") for i in range(2, 30)], "doc_id long, text string")
    check(spark, docs, spark.createDataFrame([("word word",)], "text string"), percent=50)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join("ab"[:rng.randint(1, 2)] * rng.randint(1, 90) for _ in range(3000)) + "x" * 5000
    words, want = features(text)
    import pyarrow as pa

    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(resample, "PIECE_BYTES", size)
        batch = pa.RecordBatch.from_arrays([pa.array(["A b", None, text, ""])], names=["text"])
        got = [(r, b) for row, bucket, _ in resample._slices(batch, 10000) for r, b in zip(row.tolist(), bucket.tolist(), strict=True)]
        assert sorted(b for r, b in got if r == 2) == sorted(want)
        assert sorted(b for r, b in got if r == 0) == sorted(features("a b")[1])
        assert sum(n[2] for _, _, n in resample._slices(batch, 10000)) == len(words)


@pytest.mark.parametrize("k", [1, 2, 250, 499, 500])
def test_kth_key(spark, k):
    rows = write_table(spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), F.col("id").alias("b")), "rows")
    key = F.struct("a", "b")
    want = sorted(tuple(r) for r in rows.collect())[k - 1]
    assert tuple(rows.select(resample.kth_key(rows, key, k, pivots=3)).first()[0]) == want
