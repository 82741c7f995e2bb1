"""Operators 4, 5 and 8, and the pipeline."""

import hashlib
import os
import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from chronoframe.llm import chat, decontam, minhash, queries, secrets, sharding, warc
from chronoframe.llm.common import read, write_table

from .conftest import SF

PAGES = [(3, "http://a/ü b\r\nX: 1", "<p>" + "x" * 200), (1, None, "<p>" + "x" * 200), (2, "u", "<p>" + "x" * 200),
         (2, "u", "<p>" + "x" * 200), (4, "u", "short"), (5, "v", "short"), (6, "w", None), (7, "w", ""),
         (None, "n", "<p>" + "x" * 200), (8, "big", "é" * 300000), (9, "sep", "a\r\n\r\nb" * 40)]


def brute_pages(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and i > first[h]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                    first[h] if again else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as archive")
    frames = warc.write(df, archive_bytes=300_000)
    got = warc.read(frames)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == brute_pages(PAGES)
    text = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response' and page_id > 3").collect()}
    assert text == {i: h or "" for i, _, h in PAGES if i and i > 3}
    assert warc.read(frames, [8]).count() == 1
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_seekable_bundles(spark, tmp_path):
    import zstandard

    frames = warc.write(read(spark, SF, "pages"), archive_bytes=1 << 16)
    where = {r["page_id"]: r for r in warc.index(frames).collect()}
    assert warc.export(frames, f"file://{tmp_path}").count() == len(os.listdir(tmp_path)) > 1
    seen = 0
    for name in os.listdir(tmp_path):
        bundle = (tmp_path / name).read_bytes()
        table = warc.read_seek_table(bundle)
        archive = int(name.split("-")[1].split(".")[0])
        whole = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
        for page, at in where.items():
            if at["archive"] == archive:
                offset, size = table[at["frame"]]
                plain = zstandard.ZstdDecompressor().decompress(bundle[offset:offset + size], max_output_size=1 << 22)
                raw = plain[at["offset"]:at["offset"] + at["length"]]
                assert warc.parse(raw)["page_id"] == page and raw in whole
                seen += 1
    assert seen == len(where) == read(spark, SF, "pages").count()


def test_bundle_files(spark, tmp_path):
    """Files from tasks, read back by seek table, frame and record; a rerun leaves the same files."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as file", "2 as frame")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for uri in (None, f"file://{tmp_path}/out"):
        index = warc.write_bundles(df, uri, archive_bytes=300_000)
        got = warc.read_bundles(index, uri)
        assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == brute_pages(PAGES)
        assert [r["page_id"] for r in warc.read_bundles(index, uri, [8]).collect()] == [8]
    first = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(tmp_path / "out") if not n.endswith(".crc")}
    assert len(first) > 1 and all(n.endswith(".warc.zst") for n in first)
    warc.write_bundles(df, f"file://{tmp_path}/out", archive_bytes=300_000)
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(tmp_path / "out") if not n.endswith(".crc")} == first
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).collect() == []
    pages = read(spark, SF, "pages")
    index = warc.write_bundles(pages, archive_bytes=1 << 16)
    assert index.select("file").distinct().count() > 1 and warc.read_bundles(index).count() == pages.count()


def test_equal_rows_spread(spark):
    """Rows that repeat one id and text fill several buckets; the others stay where they are."""
    hot = [(None, "the same text in many rows")] * 3000
    rest = [(i, f"text {i}") for i in range(300)]
    df = write_table(spark.createDataFrame(hot + rest, "doc_id long, text string").repartition(4), "rows")
    sizes = dict(bucket_bytes=2000, hot=100)
    out = sharding.shard(df, 4, **sizes)
    rows = out.collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 3300 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = {r["row"]["doc_id"]: r["shard"] for r in rows}
    assert place == {r["row"]["doc_id"]: r["shard"] for r in sharding.shard(df, 4).collect()}
    assert len({r["shard"] for r in rows if r["row"]["doc_id"] is None}) == 1
    same = sharding._placed(df, F.xxhash64("doc_id", "text"), 100)
    assert same.where("place > 0").select("place").distinct().count() >= 2999


def test_shards_against_brute_force(spark, docs):
    """The winning hash of each document, computed apart; one more shard takes rows only into itself."""
    import xxhash

    def weight(key, i, seed):
        h = 42
        for x, size in ((key, 8), (i, 4), (seed, 4)):
            if x is not None:
                h = xxhash.xxh64_intdigest(int(x).to_bytes(size, "little", signed=True), h)
        return h - 2**64 if h >= 2**63 else h

    for r in sharding.shard(docs, 8).collect():
        d = r["row"]["doc_id"]
        assert r["shard"] == max(range(8), key=lambda i, d=d: (weight(d, i, 7), i))
        assert r["grown_shard"] == max(range(9), key=lambda i, d=d: (weight(d, i, 7), i))


def test_chat_with_null_turns(spark):
    rows = [(1, None, "ann" if i % 2 else "bob", f"t{i:03d}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df).where("speaker = 'ann'").orderBy("seq").collect()
    want = sorted((r[2], r[3]) for r in rows)
    assert [(s["seq"], w[1] in s["segment"]) for s, w in zip(got, want, strict=True)] == [(i, True) for i in range(500)]
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x|>"), (1, 5000, "bob", "yo"), (1, 5000, "bob", "yo"),
            (1, 9000, "cy", None), (2, 0, "system", "alone"), (None, 1, None, "lost"), (3, None, "ann", "first"), (3, 0, "bob", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as speaker", "2 as seq")
    segments = chat.rotate(df)
    samples = {(r["conv_id"], r["speaker"]): r for r in chat.render(segments).collect()}
    assert set(samples) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown"), (3, "ann"), (3, "bob")}
    ann = samples[1, "ann"]
    assert ann["text"] == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |x|><|end|>\n<|user name=bob|>\nyo<|end|>\n"
                           "<|user name=bob|>\nyo<|end|>\n<|user name=cy|>\n<|end|>\n")
    assert [ann["text"][m["start"]:m["end"]] for m in ann["mask"]] == ["hi < |x|><|end|>"]
    assert len(samples[1, "bob"]["mask"]) == 2 and samples[3, "ann"]["text"].startswith("<|assistant|>\nfirst")
    for r in segments.collect():
        assert samples[r["conv_id"], r["speaker"]]["text"][r["start"]:r["end"]] == r["segment"]
    assert chat.rotate(df.limit(0)).collect() == []


def test_sharding(spark, docs, odd, empty, tmp_path):
    for df in (docs, odd):
        rows = sharding.shard(df, 8, bucket_bytes=20_000).collect()
        def key(r):
            return repr(tuple(r))

        assert Counter(key(r["row"]) for r in rows) == Counter(key(r) for r in df.collect())
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = {r["row"]["doc_id"]: r for r in sharding.shard(docs, 8, bucket_bytes=20_000).collect()}
    again = {r["row"]["doc_id"]: r for r in sharding.shard(docs.repartition(5), 8, bucket_bytes=20_000).collect()}
    nine = {r["row"]["doc_id"]: r["shard"] for r in sharding.shard(docs, 9).collect()}
    assert all((place[d]["shard"], place[d]["slot"]) == (again[d]["shard"], again[d]["slot"]) for d in place)
    assert all(nine[d] == place[d]["grown_shard"] for d in place)
    ordered = [d for d, r in sorted(place.items(), key=lambda x: (x[1]["shard"], x[1]["slot"])) if r["shard"] == 0]
    assert ordered != sorted(ordered)
    assert sharding.shard(empty, 8).collect() == []
    sharding.write_shards(sharding.shard(docs, 8), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_sharding_query(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op8_sharding(spark, SF).collect():
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")


def test_pipeline_stages(spark, docs):
    """Each stage on what its predecessor kept, against the operators and brute force."""
    out = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, kept, SF)
        if name != "byte_bpe":
            assert now.columns == docs.columns
        out[name] = now = now.checkpoint()
        kept, before = now, kept
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        old = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name == "language_id":
            assert len(ids) >= 0.98 * len(old)
        elif name == "near_dedup":
            groups = minhash.near_duplicates(before, words=5).collect()
            assert ids == {r["component_id"] for r in groups}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontam.leaks(before, read(spark, SF, "benchmark")).collect()}
            assert ids == old - bad
        else:
            assert ids == old
    final = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, final.collect())) == sorted(map(repr, out["byte_bpe"].collect()))
    texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out["secret_scan"].collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in final.collect()} == texts
    held = {r["doc_id"] for r in secrets.scan(out["decontamination"]).where("spans <> ''").collect()}
    assert {r["doc_id"] for r in out["secret_scan"].where(F.col("text").contains("[SECRET]")).collect()} == held


def test_pipeline_odd_rows(spark, odd):
    kept = odd
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        if name == "language_id":
            assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, None}
        if name != "byte_bpe":
            assert kept.columns == odd.columns
    assert kept.count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, odd.limit(0), SF).collect() == []
