"""Operator 12: MinHash fingerprints of documents, and how they follow an edit.

1. ``minima`` maps the word shingles of a slice of texts through ``PERMUTATIONS`` universal hash
   permutations a * x + b of 64-bit integers (a odd), in numpy, and keeps each text's minimum under each.
   The fingerprint is the low byte of every minimum, in hex; two fingerprints agree at a place with the
   sets' Jaccard similarity, plus one in 256 of the rest by chance, which ``likeness`` takes off.
2. ``edited`` sorts the texts, compressed, by range of doc_id, and every range partition is a stream in which each
   text meets the next one: so the edited text (its last half replaced by the next one's first
   characters) is fingerprinted without a window over the table.  The last text of a partition is joined
   with the first of the next one.
3. ``components`` joins ``BANDS`` bands of ``ROWS`` minima in Spark: a band that several texts share ties each
   to the smallest doc_id there, so no pairs are listed.  Candidates are verified on the full shingle
   sets (100 * intersection >= 80 * union of five-word shingles) and verified links give components.
   Two texts at 0.8 share no band with probability (1 - 0.8^4)^16 = 2 in 10,000, and fewer above.
   Copies are one class first.  Bloom filters of fixed size keep rows without a partner out of shuffles.

Cases: a null text counts as empty; an empty or blank text has no shingle, a fingerprint of its own
kind, and links with nothing; fewer words than a shingle has are one shingle; a null doc_id comes
first, and its rows link with nothing; rows of one doc_id follow each other in the order of a hash of
their text; the next of the last document is the first, that of a single document itself; repeated rows
are documents each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, graph, minhash
from .common import SLICE_BYTES, by_bytes, map_arrow, mix, series, write_table
from .order import by_range
from .words import hashes, spans, utf8

WORDS = 5
PERCENT = 80
PERMUTATIONS = 128
BANDS = 16
ROWS = 4

_TIMES = series(61, PERMUTATIONS) | np.uint64(1)
_PLUS = series(62, PERMUTATIONS)
_ORDER = series(63, 16) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False
_CODEC = "zstd"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of one text from which it is shingled in pieces.
PIECE_BYTES = 4 << 20


def shingles(column: pa.Array, size: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, rows) of the hashed word shingles of each text, those of texts with too few words apart."""
    raw, rows = utf8(column)
    raw = _LOWER[raw]
    mask = _INK[raw]
    starts, ends = spans(mask, rows)
    word = hashes(raw, mask, starts, ends)
    row = np.searchsorted(rows, starts, "right") - 1
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        m = max(0, len(word) - size + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(size):
            rolled += word[k:k + m] * _ORDER[k]
        whole = np.flatnonzero(row[:m] == row[size - 1:size - 1 + m])
        few = np.flatnonzero((count > 0) & (count < size))
        short = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = count[few] > k
            short[has] += word[first[few[has]] + k] * _ORDER[k]
        return [(mix(rolled[whole]), row[whole]), (mix(short + count[few].astype(np.uint64)), few)]


def _least(out: np.ndarray, values: np.ndarray, row: np.ndarray) -> None:
    """Lower the minima ``out`` of the texts ``row`` to those of their shingles."""
    if len(values):
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        with np.errstate(over="ignore"):
            for i in range(out.shape[1]):
                low = np.minimum.reduceat(values * _TIMES[i] + _PLUS[i], at)
                out[row[at], i] = np.minimum(out[row[at], i], low)


def pieces(raw: bytes, size: int, limit: int) -> Iterator[bytes]:
    """A long text in pieces of about ``limit`` bytes, cut at blanks; each begins with the last ``size`` - 1 words of the
    one before, so that no shingle is lost."""
    start, before = 0, b""
    while start < len(raw):
        found = _BLANK.search(raw, start + limit)
        stop = found.start() if found else len(raw)
        piece = before + raw[start:stop]
        yield piece
        before = b" ".join(piece.split()[1 - size:]) + b" " if size > 1 else b""
        start = stop


def minima(column: pa.Array, size: int = WORDS, n: int = PERMUTATIONS) -> np.ndarray:
    """(texts, n): the least value of each text's shingles under each permutation.  A text of more than
    ``PIECE_BYTES`` goes through in pieces."""
    out = np.full((len(column), n), _NONE)
    raw = column.cast(pa.large_binary())
    long = np.flatnonzero(pa.compute.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False) > PIECE_BYTES)
    if len(long):
        texts = raw.to_pylist()
        for i in long.tolist():
            few = None
            for piece in pieces(texts[i], size, PIECE_BYTES):
                (values, row), few = shingles(pa.array([piece], pa.large_binary()), size)
                _least(out[i:i + 1], values, row)
            if (out[i] == _NONE).all() and few is not None:  # too few words for a shingle, however long
                _least(out[i:i + 1], *few)
            texts[i] = None
        raw = pa.array(texts, pa.large_binary())
    for values, row in shingles(raw, size):
        _least(out, values, row)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row."""
    share = (a == b).mean(axis=1)
    return np.maximum(0.0, (share - 1 / 256) / (1 - 1 / 256))


def _shown(rows: DataFrame) -> DataFrame:
    """Digests and fingerprints, binary in tables, as lower-case hex."""
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def replaced(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(ids: list, texts: list[str], size: int) -> dict:
    """Result columns of all texts but the last, each with the next one."""
    edits = [replaced(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own = minima(pa.array(texts, pa.large_string()), size).astype(np.uint8)
    new = minima(pa.array(edits, pa.large_string()), size).astype(np.uint8)
    return {"doc_id": ids, "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).digest() for t in edits],
            "fingerprint": [x.tobytes() for x in own[:-1]], "edited_fingerprint": [x.tobytes() for x in new],
            "near_edited": likeness(own[:-1], new), "near_next": likeness(own[:-1], own[1:])}


_TYPES = {"kind": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(),
          "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(),
          "near_next": pa.float64(), "c1": pa.int64(), "c2": pa.int64(), "part": pa.int32(), "size": pa.int64(), "z": pa.binary()}
_SCHEMA = ("kind int, doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double, c1 bigint, c2 bigint, part int, size bigint, z binary")
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
FIRST, LAST, ALONE, MAYBE = range(4)


def _batch(columns: dict) -> pa.RecordBatch:
    rows = len(columns["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.nulls(rows, t) if columns.get(c) is None else pa.array(columns[c], t) for c, t in _TYPES.items()], names=list(_TYPES))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, c1, c2, size, z): the texts compressed, with a 128-bit hash that is the same for copies."""
    def work(batches):
        codec = pa.Codec(_CODEC, compression_level=3)
        for batch in by_bytes(batches, "z"):
            z = batch.column("z")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.compute.binary_length(z).cast(pa.int64()),
                 pa.array([codec.compress(x.as_buffer()).to_pybytes() for x in z], pa.binary())], names=["doc_id", "c1", "c2", "size", "z"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("c1"),
                        F.xxhash64(F.lit(17), text).alias("c2"), text.cast("binary").alias("z"))
            .transform(map_arrow, work, "doc_id bigint, c1 bigint, c2 bigint, size bigint, z binary"))


def _unpack(batch: pa.RecordBatch) -> list[str]:
    codec = pa.Codec(_CODEC)
    return [codec.decompress(z.as_buffer(), n).to_pybytes().decode() if n else ""
            for z, n in zip(batch.column("z"), batch.column("size").to_pylist(), strict=True)]


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SLICE_BYTES`` of unpacked text; every row stays whole."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(batch.column("size").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield batch.slice(a, b - a)


def edited(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text", copies=None) -> DataFrame:
    """(kind, RESULT, c1, c2), one row per document, written, digests and fingerprints binary: kind ``MAYBE`` where the hash c1 may be in
    the broadcast Bloom filter ``copies``, else ``ALONE``."""
    def rows(ids, c1, c2, texts):
        c = np.array(c1, np.int64)
        kind = np.where(bloom.maybe(copies.value, c), MAYBE, ALONE) if copies is not None else np.full(len(c), ALONE)
        return _batch(_pairs(ids, texts, size) | {"kind": kind, "c1": c1, "c2": c2})

    def stream(batches):
        held, part = None, TaskContext.get().partitionId()
        for batch in _by_size(batches):
            texts, meta = _unpack(batch), [batch.column(c).to_pylist() for c in ("doc_id", "c1", "c2", "size", "z")]
            if held is None:
                yield _batch({"kind": [FIRST], "part": [part], "size": meta[3][:1], "z": meta[4][:1]})
            else:
                texts, meta = [held[0], *texts], [[h, *m] for h, m in zip(held[1], meta, strict=True)]
            if len(texts) > 1:
                yield rows(*(m[:-1] for m in meta[:3]), texts)
            held = texts[-1], [m[-1] for m in meta]
        if held is not None:
            yield _batch({"kind": [LAST], "part": [part]} | {c: [m] for c, m in zip(("doc_id", "c1", "c2", "size", "z"), held[1], strict=True)})

    def last(batches):
        for batch in batches:
            following = _unpack(batch.select(["next_size", "next_z"]).rename_columns(["size", "z"]))
            for i, (a, b) in enumerate(zip(_unpack(batch), following, strict=True)):
                yield rows(*([batch.column(c)[i].as_py()] for c in ("doc_id", "c1", "c2")), [a, b])

    found = write_table(by_range(packed(docs, id_col, text_col), "doc_id", "c1").transform(map_arrow, stream, _SCHEMA), "fingerprints")
    parts = sorted(r["part"] for r in found.where(F.col("kind") == FIRST).select("part").collect())
    after = found.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    firsts = found.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("size").alias("next_size"), F.col("z").alias("next_z"))
    lasts = found.where(F.col("kind") == LAST).select("part", "doc_id", "c1", "c2", "size", "z").join(after, "part").join(firsts, "next")
    columns = ["kind", *RESULT, "c1", "c2"]
    return (found.where(F.col("kind") >= ALONE).select(*columns)
            .unionByName(lasts.transform(map_arrow, last, _SCHEMA).select(*columns)))


def _classes(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(c1, c2, rep, n, bands) of every distinct text with a shingle."""
    def work(batches):
        for batch in by_bytes(batches, "text"):
            low = minima(batch.column("text"), size, BANDS * ROWS)
            with np.errstate(over="ignore"):
                bands = mix((low.reshape(len(low), BANDS, ROWS) * _ORDER[:ROWS]).sum(axis=2) + series(64, BANDS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.tobytes() for x in bands], pa.binary(), mask=low[:, 0] == _NONE)],
                names=["doc_id", "c1", "c2", "bands"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(17), text).alias("c2"),
        text.alias("text")).transform(map_arrow, work, "doc_id bigint, c1 bigint, c2 bigint, bands binary"))
    return rows.where("bands is not null").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))


def _exploded(classes: DataFrame, shared=None) -> DataFrame:
    """(key, rep) per band, of those that may be in the broadcast filter ``shared``."""
    def work(batches):
        for batch in by_bytes(batches, "bands"):
            key = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
            if shared is not None:
                ok = bloom.maybe(shared.value, key)
                key, rep = key[ok], rep[ok]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep)], names=["key", "rep"])

    return classes.select("bands", "rep").transform(map_arrow, work, "key bigint, rep bigint")


def components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(c1, c2, component_id), written, of every text that several documents have or that links with another:
    the smallest doc_id reachable by copies and verified links."""
    classes = write_table(_classes(docs, size, id_col, text_col), "classes")
    keys = write_table(_exploded(classes).groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"))
                       .where("n > 1").select("key", "hub"), "keys")
    met = _exploded(classes, bloom.broadcast(keys.select("key"))).join(keys, "key").where("rep <> hub")
    coarse = write_table(graph.components(met.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()), "coarse")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = bloom.kept(texts, "doc_id", bloom.broadcast(coarse.select("node")))
    fine = minhash.confirm(texts, coarse, size, percent, "doc_id", "text")
    tied = classes.select("c1", "c2", "rep", "n").join(fine, F.col("rep") == F.col("node"), "left")
    return write_table(tied.where("n > 1 or component is not null")
                       .select("c1", "c2", F.coalesce("component", "rep").alias("component_id")), "copies")


def fingerprints(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RESULT, component_id), one row per document."""
    copies = components(docs, size, percent, id_col, text_col)
    rows = edited(docs, size, id_col, text_col, bloom.broadcast(copies.select("c1")))
    tied = rows.where(F.col("kind") == MAYBE).join(copies, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    alone = rows.where(F.col("kind") == ALONE).select(*RESULT, F.col("doc_id").alias("component_id"))
    return _shown(tied.select(*RESULT, component).unionByName(alone))
