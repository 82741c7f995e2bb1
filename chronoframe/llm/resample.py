"""Operator 13: resampling a corpus towards a target distribution by importance weights.

1. ``bucket_counts`` hashes the words and word pairs of every text into ``BUCKETS`` buckets (crc32 of
   the feature's bytes, vectorised over a slice of texts) and sums one array per task.
2. ``gains`` sets the target's bucket frequencies against the corpus', and ``weigh`` gives each
   document the mean gain of its features: one gather from the array of gains.
3. ``draw`` adds seeded Gumbel noise (the highest scores are then a draw without replacement) and finds
   the k-th best composite key (score, id, features) by quickselect: random pivot keys out of the range that
   is left, exact counts of the rows below, at and above each, until a pivot is the k-th key itself.
   Only the winners are sorted and ranked.

The texts are read twice and never shuffled.  The driver sees ``BUCKETS`` sums, ``PIVOTS`` keys a round
and one count per partition of the winners.

Cases: a null or empty text has no words, no features and weight 0; a null id counts as an empty
one in the noise and comes last among equal scores; rows that are equal in all key columns are
interchangeable and ranked in any order; an empty table gives an empty table; an empty target leaves
the corpus' own frequencies to decide; a text of any length is read in pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, write_table
from .order import numbered
from .words import spans, utf8

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
#: Random pivots of one round of the quickselect.
PIVOTS = 16
#: Bytes of one text that are hashed at once.
PIECE_BYTES = 4 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the crc32 ``before`` it (0 for none)."""
    crc = before.astype(np.uint32) ^ _ALL
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes = lengths[order]
    for p in range(min(LONG_WORD, int(sizes[-1]) if len(sizes) else 0)):
        open_ = order[np.searchsorted(sizes, p, "right"):np.searchsorted(sizes, LONG_WORD, "right")]
        c = crc[open_]
        crc[open_] = _CRC[(c ^ raw[starts[open_] + p]) & 255] ^ (c >> np.uint32(8))
    crc ^= _ALL
    for i in order[np.searchsorted(sizes, LONG_WORD, "right"):].tolist():
        crc[i] = zlib.crc32(raw[starts[i]:ends[i]].tobytes(), int(crc[i]))
    return crc


def _features(raw: np.ndarray, rows: np.ndarray, last: int | None, buckets: int):
    """(row, bucket) of the words and word pairs of rows of lower-case bytes, words per row, and the crc32
    of the last word.  ``last``: that of the word before the first row, of the same text."""
    starts, ends = spans(_WORD[raw], rows)
    row = np.searchsorted(rows, starts, "right") - 1
    one = crc32(raw, starts, ends, np.zeros(len(starts), np.uint32))
    first = one[:-1]
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    first = first[pair - 1]
    if last is not None and len(one):
        pair, first = np.concatenate([[0], pair]), np.concatenate([np.array([last], np.uint32), first])
    c = first ^ _ALL
    blank = (_CRC[(c ^ np.uint32(32)) & 255] ^ (c >> np.uint32(8))) ^ _ALL
    two = crc32(raw, starts[pair], ends[pair], blank)
    at = np.concatenate([row, row[pair]])
    return (at, np.concatenate([one, two]) % np.uint32(buckets), np.bincount(row, minlength=len(rows) - 1),
            int(one[-1]) if len(one) else last)


def _slices(batch: pa.RecordBatch, buckets: int):
    """(row, bucket, words per row), in pieces; a text longer than a piece is cut between words."""
    raw, rows = utf8(batch.column("text"))
    raw = _LOWER[raw]
    n = len(rows) - 1
    if len(raw) <= PIECE_BYTES:
        yield _features(raw, rows, None, buckets)[:3]
        return
    for i in range(n):
        text, last, start = raw[rows[i]:rows[i + 1]], None, 0
        while start < len(text):
            stop = min(len(text), start + PIECE_BYTES)
            while stop < len(text) and _WORD[text[stop]]:
                ahead = np.flatnonzero(~_WORD[text[stop:stop + PIECE_BYTES]])
                stop = stop + int(ahead[0]) if len(ahead) else min(len(text), stop + PIECE_BYTES)
            piece = text[start:stop]
            at, bucket, words, last = _features(piece, np.array([0, len(piece)]), last, buckets)
            count = np.zeros(n, np.int64)
            count[i] = words[0]
            yield np.full(len(at), i), bucket, count
            start = stop


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: one array of ``buckets`` sums."""
    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches, "text"):
            for _, bucket, _ in _slices(batch, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = (docs.select(F.col(text_col).cast("string").alias("text")).transform(map_arrow, work, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed bucket frequencies, target over corpus."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches):
        for batch in by_bytes(batches, "text"):
            n = batch.num_rows
            words, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for row, bucket, piece in _slices(batch, len(gain)):
                words += piece
                count += np.bincount(row, minlength=n)
                np.add.at(total, row, table.value[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))],
                names=["id", "n_words", "n_features", "weight"])

    return (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
            .transform(map_arrow, work, "id bigint, n_words bigint, n_features bigint, weight bigint")
            .withColumnRenamed("id", "doc_id"))


def noise(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of Gumbel noise, a function of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def kth_key(rows: DataFrame, key: Column, k: int, seed: int = SEED, pivots: int = PIVOTS):
    """The ``k``-th smallest composite key of ``rows`` (a written table), by distributed quickselect."""
    left, below, round_ = rows.select(key.alias("key")), 0, 0
    names = left.schema["key"].dataType.names
    value = lambda r: F.struct(*[F.lit(r[n]).cast(left.schema["key"].dataType[n].dataType).alias(n) for n in names])
    while True:
        round_ += 1
        chance = F.xxhash64("key", F.lit(seed), F.lit(round_))
        sample = (left.groupBy(F.pmod(chance, F.lit(pivots)).alias("slot")).agg(F.min_by("key", chance).alias("key")))
        keys = [r["key"] for r in sample.collect()]
        counts = left.agg(*[c for i, r in enumerate(keys)
                            for c in (F.count_if(F.col("key") < value(r)).alias(f"l{i}"),
                                      F.count_if(F.col("key") == value(r)).alias(f"e{i}"))]).first()
        low, high = None, None
        for i, r in enumerate(keys):
            less, same = below + counts[f"l{i}"], counts[f"e{i}"]
            if less < k <= less + same:
                return value(r)
            if less + same < k and (low is None or less + same > low[0]):
                low = (less + same, r)
            if less >= k and (high is None or less < high[0]):
                high = (less, r)
        if low is not None:
            left, below = left.where(F.col("key") > value(low[1])), low[0]
        if high is not None:
            left = left.where(F.col("key") < value(high[1]))


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): all rows, ranked where drawn."""
    scored = write_table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    eligible = F.col("n_words") >= min_words
    k = scored.where(eligible).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return scored.select(*columns, none)
    key = F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("no_id"),
                   F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features")
    won = eligible & (key <= kth_key(scored.where(eligible), key, k, seed))
    winners = numbered(scored.where(won), [key], "rank")
    ranked = winners.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~won).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all ``docs``; ``target`` needs ``text_col`` alone."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    return draw(weigh(docs, gain, id_col, text_col), percent, min_words, seed)
