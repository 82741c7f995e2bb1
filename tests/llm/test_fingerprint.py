"""Operator 12 against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.llm import bloom, fingerprint

from .test_near_dedup import brute, shingles


def jaccard(a, b, k=5):
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, found):
    """``rows``: (doc_id, text) whose ids differ."""
    got = {r["doc_id"]: r for r in found.collect()}
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    ties = brute([(d, shingles(t, 5)) for d, t in ordered])
    prints = {}
    errors = []
    for (d, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        r, half = got[d], len(a) // 2
        edit = a[:len(a) - half] + b[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(edit.encode()).hexdigest())
        assert prints.setdefault(a, r["fingerprint"]) == r["fingerprint"]
        own, new, after = (np.frombuffer(bytes.fromhex(x), np.uint8)[None, :] for x in
                           (r["fingerprint"], r["edited_fingerprint"], got[dict(zip([o[0] for o in ordered], [o[0] for o in ordered[1:] + ordered[:1]], strict=True))[d]]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(fingerprint.likeness(own, new)[0])
        assert r["near_next"] == pytest.approx(fingerprint.likeness(own, after)[0])
        if shingles(a, 5) and shingles(edit, 5):
            errors += [r["near_edited"] - jaccard(a, edit)]
        assert r["component_id"] == (None if d is None else ties.get(d, d))
    assert max(map(abs, errors)) < 0.25 and abs(float(np.mean(errors))) < 0.03


def test_documents(spark, docs):
    check([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], fingerprint.fingerprints(docs))


def test_odd_rows(spark, odd, empty):
    once = odd.dropDuplicates(["doc_id"])
    check([(r["doc_id"], r["text"]) for r in once.collect()], fingerprint.fingerprints(once))
    assert fingerprint.fingerprints(odd).count() == odd.count()
    assert fingerprint.fingerprints(empty).collect() == []
    alone = fingerprint.fingerprints(odd.where("doc_id = 6")).first()
    assert (alone["near_next"], alone["component_id"]) == (1.0, 6)


def test_copies_and_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(200)]
    for i in range(200, 420):
        text = base[:]
        text[rng.randrange(120)] = "new"
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(100))) for i in range(420, 480)]
    check(rows, fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))


def test_minima_against_python():
    texts = ["One two  three four FIVE six", "one", "", None, "a b", "x " * 40, "é" * 9000 + " b c d e f g"]
    low = fingerprint.minima(pa.array(texts), 5, 7)
    by = {}
    for values, row in fingerprint.shingles(pa.array(texts), 5):
        for v, r in zip(values.tolist(), row.tolist(), strict=True):
            by.setdefault(r, set()).add(v)
    assert [len(by.get(i, ())) for i in range(len(texts))] == [len(shingles(t, 5)) for t in texts]
    for i in range(len(texts)):
        for j in range(7):
            a, b = int(fingerprint._TIMES[j]), int(fingerprint._PLUS[j])
            want = min(((v * a + b) % 2**64 for v in by.get(i, ())), default=2**64 - 1)
            assert int(low[i, j]) == want


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "é", "word"]) + rng.choice(["", "\n", "\t "]) for _ in range(400)), "x" * 900,
             " " * 900, "one two " + "y" * 900, None, "short text"]
    want = fingerprint.minima(pa.array(texts), 5, 9)
    for limit in (7, 100, 899):
        monkeypatch.setattr(fingerprint, "PIECE_BYTES", limit)
        assert (fingerprint.minima(pa.array(texts), 5, 9) == want).all()


def test_bloom_keeps_every_member(spark):
    keys = spark.range(0, 5000, 3)
    made = bloom.broadcast(keys, 1 << 17)
    got = {r[0] for r in bloom.kept(spark.range(20000).selectExpr("id", "1 as n"), "id", made, 1 << 17).select("id").collect()}
    assert got >= set(range(0, 5000, 3)) and len(got) < 4000
    assert not bloom.build(keys.limit(0)).any()
