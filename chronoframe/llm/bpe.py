"""Operator 7: byte-level BPE encoding and decoding with a local rank file.

``encode`` runs the tiktoken library in Arrow batches; no shuffle, one output row per input row.
Long texts are cut first, at boundaries where the split pattern starts a match whatever
precedes it, so the ids equal those of the whole text and no call holds more than about
``PIECE_CHARS`` characters unless a text has no boundary.  ``decode`` joins the raw bytes of the
ids, which need not be valid UTF-8 on their own.  ``encode(decoded=True)`` does both in one Python
pass, so that a task has one worker with one rank table.

Cases: a null text counts as empty (0 ids, empty bytes); null or repeated ids pass through with
their row; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow

#: Characters after which the next safe boundary is looked for.
PIECE_CHARS = 1 << 16
#: The rank file goes to every worker; a larger one is refused.
MAX_RANK_BYTES = 64 << 20
# A blank between two characters that aren't white space: no match of the pattern spans it from
# the left, and the match that starts with it depends only on what follows.
SAFE = re.compile(r"(?<=\S) (?=\S)")

_codecs: dict = {}


def default_ranks() -> tuple[str, str]:
    """Path of the rank file and the split pattern that belongs to it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        blob = f.read(MAX_RANK_BYTES + 1)
    if len(blob) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return blob


def codec(blob: bytes, pattern: str):
    """The encoding of a rank file, built once per worker."""
    import tiktoken

    key = (hash(blob), pattern)
    if key not in _codecs:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in blob.splitlines() if line)}
        _codecs[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries, each at the first one after ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _token_ids(enc, text: str | None) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=())
                    .astype("<u4").tobytes() for p in pieces(text)) if text else b""


def _bytes_of(enc, ids: bytes) -> bytes:
    """The raw bytes of the ids, decoded in pieces of ``PIECE_CHARS`` ids."""
    flat = np.frombuffer(ids, "<u4")
    return b"".join(enc.decode_bytes(flat[i:i + PIECE_CHARS].tolist()) for i in range(0, len(flat), PIECE_CHARS))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in one binary.  With ``decoded``
    the same pass decodes the ids again, and the raw bytes are a last column."""
    default_path, default_pattern = default_ranks()
    blob = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path or default_path))
    split = pattern or default_pattern

    def work(batches):
        enc = codec(blob.value, split)
        for batch in by_bytes(batches, "text"):
            ids = [_token_ids(enc, t) for t in batch.column("text").to_pylist()]
            columns = {"id": batch.column("id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([_bytes_of(enc, x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = f"id {kind}, n_tokens bigint, ids binary" + (", decoded binary" if decoded else "")
    return out.transform(map_arrow, work, fields).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The encoded rows with ``decoded``, the raw bytes of their ids.  Null ids give null."""
    default_path, default_pattern = default_ranks()
    blob = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path or default_path))
    split = pattern or default_pattern
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def work(batches):
        enc = codec(blob.value, split)
        for batch in by_bytes(batches, "ids"):
            raw = [None if x is None else _bytes_of(enc, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return encoded.transform(map_arrow, work, f"{fields}, decoded binary")
