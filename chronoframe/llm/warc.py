"""Operator 4: WARC records in seekable Zstandard bundles.

Pages are dealt to archives of about ``ARCHIVE_BYTES`` by a hash of id and payload.  A task sorts its
archive by page and packs records into independent Zstandard frames of about ``FRAME_BYTES``; the last
row of an archive is its seek table, a skippable frame, so the frames in order are one valid
``.warc.zst`` bundle.  Each frame row also maps its record ids to offsets within the decompressed
frame, so one record is read by decompressing one frame.

``write_bundles`` has each task write its archive as one file and returns the record index; ``read_bundles`` goes
from a record's index row to the seek table at the end of its file, from there to the frame's bytes, and
to the record's place in the frame.  Files go to a store that pyarrow's file systems reach from all
executors.  ``write`` and ``read`` keep the same frames in a table, which reaches any store that Spark
writes, and ``export`` makes files of it.

Of records with equal payloads of at least ``MIN_DUPLICATE`` bytes the one with the smallest page_id is
a response and the others revisit it.  Only (digest, id) pairs meet for this, summed before the shuffle.

Cases: a null html is an empty payload; a null url leaves out the target; a page without id is always a
response; rows that repeat the smallest page_id are responses, those that repeat another are revisits
each; no pages give no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path
from .common import by_bytes, map_arrow, write_table

ARCHIVE_BYTES = 32 << 20
FRAME_BYTES = 256 << 10
MIN_DUPLICATE = 100
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Magic numbers of the seekable format (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

FRAMES = ("archive int, frame int, data binary, record_ids array<bigint>, "
          "record_offsets array<bigint>, record_lengths array<bigint>")
RECORDS = ("page_id bigint, record_type string, refers_to bigint, payload_digest string, "
           "payload_bytes bigint, url string, payload binary")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no block."""
    kind, block = ("response", HTTP + payload) if refers_to is None else ("revisit", b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
             f"WARC-Record-ID: <{URN}{digest if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields and the payload of one record (payload None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    name = fields["WARC-Record-ID"][1 + len(URN):-1]
    response = fields["WARC-Type"] == "response"
    return {"page_id": int(name) if name.lstrip("-").isdigit() and len(name) < 20 else None,
            "record_type": fields["WARC-Type"],
            "refers_to": None if response else int(fields["WARC-Refers-To"][1 + len(URN):-1]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "payload_bytes": int(fields["X-Payload-Length"]), "url": fields.get("WARC-Target-URI"),
            "payload": block.partition(b"\r\n\r\n")[2] if response else None}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and the plain size of every frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame of a whole bundle."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for i in range(n):
        size, _ = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (n - i))
        out.append((at, size))
        at += size
    return out


def _pack(batches: Iterator[pa.RecordBatch], archive: int) -> Iterator[tuple]:
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    sizes, ids, parts, total = [], [], [], 0

    def frame():
        plain = b"".join(parts)
        data = press.compress(plain)
        offsets, at = [], 0
        for p in parts:
            offsets.append(at)
            at += len(p)
        row = (archive, len(sizes), data, ids[:], offsets, [len(p) for p in parts])
        sizes.append((len(data), len(plain)))
        ids.clear()
        parts.clear()
        return row

    for batch in by_bytes(batches, "payload"):
        for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = record(page_id, url, payload, digest, refers_to)
            if parts and total + len(raw) > FRAME_BYTES:
                yield frame()
                total = 0
            ids.append(page_id)
            parts.append(raw)
            total += len(raw)
    if parts:
        yield frame()
    if sizes:
        yield archive, len(sizes), seek_table(sizes), [], [], []


def _dealt(pages: DataFrame, archive_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to), one partition per archive, sorted."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    total = rows.agg(F.sum(F.octet_length("payload")).alias("b")).first()["b"] or 0
    n = max(1, math.ceil(total / archive_bytes))
    ids = rows.where(F.octet_length("payload") >= MIN_DUPLICATE).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = (ids.join(first, "digest").where(F.col("page_id") > F.col("refers_to"))
                .groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to")))
    keys = ["page_id", "digest"]
    return (rows.repartition(n, *keys).join(revisits.repartition(n, *keys), keys, "left")
            .sortWithinPartitions(*keys).select("page_id", "url", "payload", "digest", "refers_to"))


_FRAME = pa.schema([("archive", pa.int32()), ("frame", pa.int32()), ("data", pa.binary()),
                    *[(c, pa.list_(pa.int64())) for c in ("record_ids", "record_offsets", "record_lengths")]])


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the bundles as a table of frames (see FRAMES) in the shared folder."""
    def work(batches):
        for row in _pack(batches, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FRAME, strict=True)],
                                             schema=_FRAME)

    dealt = _dealt(pages, archive_bytes, id_col, url_col, html_col)
    return write_table(dealt.transform(map_arrow, work, FRAMES), "warc")


def _store(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bundles(pages: DataFrame, uri: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one seekable file per archive under ``uri`` (by default in the shared folder); the record index,
    written: (file, frame, record_ids, record_offsets, record_lengths) per frame.  A task writes beside the
    file and renames at its end, so a task that runs again replaces its file by an equal one."""
    uri = uri or scratch_path(pages.sparkSession, "warc")
    names = ["file", "frame", "record_ids", "record_offsets", "record_lengths"]

    def work(batches):
        store, root = _store(uri)
        archive = TaskContext.get().partitionId()
        file = f"{root}/archive-{archive}.warc.zst"
        beside, out = f"{root}/.archive-{archive}-{uuid.uuid4().hex}", None
        for _, frame, data, ids, offsets, lengths in _pack(batches, archive):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(beside, compression=None)
            out.write(data)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([frame], pa.int32()), *[pa.array([v], pa.list_(pa.int64())) for v in (ids, offsets, lengths)]],
                    names=names)
        if out is not None:
            out.close()
            store.move(beside, file)

    dealt = _dealt(pages, archive_bytes, id_col, url_col, html_col)
    return write_table(dealt.transform(map_arrow, work, "file string, frame int, record_ids array<bigint>, "
                                       "record_offsets array<bigint>, record_lengths array<bigint>"), "warc-index")


def frame_places(f) -> list[tuple[int, int]]:
    """(offset, compressed size) of the frames of an open bundle file, from the seek table at its end."""
    size = f.size()
    n = struct.unpack("<I", f.read_at(9, size - 9)[:4])[0]
    return read_seek_table(f.read_at(9 + 8 * n, size - 9 - 8 * n))


def read_bundles(index: DataFrame, uri: str | None = None, page_ids: list[int] | None = None) -> DataFrame:
    """The records (see RECORDS) of the bundle files, all or those of a few pages: seek table, frame, record.
    ``uri``: of the store, where it isn't that of the shared folder."""
    uri = uri or checkpoint_root(index.sparkSession)
    n = max(1, index.select("file").distinct().count())
    if page_ids is not None:
        index = index.where(F.arrays_overlap("record_ids", F.array(*[F.lit(i).cast("bigint") for i in page_ids])))

    def work(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        store, _ = _store(uri)
        at, f, places = None, None, []
        for batch in batches:
            for file, frame, ids, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    at, f = file, store.open_input_file(file)
                    places = frame_places(f)
                offset, size = places[frame]
                plain = press.decompress(f.read_at(size, offset))
                yield _records(plain, ids, offsets, lengths, page_ids)

    # By frame, not by the index' few bytes; frames of one file come together.
    spread = index.repartition(n, "file", F.floor(F.col("frame") / 8)).sortWithinPartitions("file", "frame")
    return spread.select("file", "frame", "record_ids", "record_offsets", "record_lengths").transform(map_arrow, work, RECORDS)


def _records(plain: bytes, ids, offsets, lengths, page_ids) -> pa.RecordBatch:
    """The records (see RECORDS) of one decompressed frame; a response's digest is that of the payload read."""
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    got = [parse(plain[o:o + n]) for i, o, n in zip(ids, offsets, lengths, strict=True) if page_ids is None or i in page_ids]
    for r in got:
        if r["payload"] is not None:
            r["payload_digest"] = hashlib.sha256(r["payload"]).hexdigest()
            r["payload_bytes"] = len(r["payload"])
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], t) for c, t in zip(names, types, strict=True)], names=names)


def index(frames: DataFrame) -> DataFrame:
    """(page_id, archive, frame, offset, length): where each record lies in its plain frame."""
    zipped = F.arrays_zip(F.col("record_ids").alias("i"), F.col("record_offsets").alias("o"),
                          F.col("record_lengths").alias("l"))
    return (frames.select("archive", "frame", F.explode(zipped).alias("r"))
            .select(F.col("r.i").alias("page_id"), "archive", "frame", F.col("r.o").alias("offset"),
                    F.col("r.l").alias("length")))


def read(frames: DataFrame, page_ids: list[int] | None = None) -> DataFrame:
    """The records (see RECORDS), all or those of a few pages.  Each frame is decompressed by itself
    and each record cut at its mapped offset; the digest of a response is that of the payload read."""
    wanted = frames.where(F.size("record_ids") > 0)
    if page_ids is not None:
        wanted = wanted.where(F.arrays_overlap("record_ids", F.array(*[F.lit(i).cast("bigint") for i in page_ids])))

    def work(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, ids, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _records(press.decompress(data), ids, offsets, lengths, page_ids)

    return wanted.select("data", "record_ids", "record_offsets", "record_lengths").transform(map_arrow, work, RECORDS)


def export(frames: DataFrame, uri: str) -> DataFrame:
    """Write each archive as ``archive-N.warc.zst`` under a URI that pyarrow's file systems reach
    from the executors; (archive, bytes)."""
    ordered = (frames.select("archive", "frame", "data").repartition("archive")
               .sortWithinPartitions("archive", "frame"))

    def work(batches):
        store, root = _store(uri)
        out, at, size, done = None, None, 0, []
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if archive != at:
                    if out is not None:
                        out.close()
                        done.append((at, size))
                    # The name's suffix would have the stream compressed once more.
                    out = store.open_output_stream(f"{root}/archive-{archive}.warc.zst", compression=None)
                    at, size = archive, 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done.append((at, size))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.int32()),
                                          pa.array([b for _, b in done], pa.int64())], names=["archive", "bytes"])

    return ordered.transform(map_arrow, work, "archive int, bytes bigint")
