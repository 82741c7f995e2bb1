"""Operator 6: benchmark decontamination by template windows.

Texts become templates: words in lower case, numbers, names and units replaced by typed placeholders.
Windows of ``WINDOW`` template words of the documents are hash-joined with those of the benchmark.  Every
window also has a second key without names: its words in lower case with numbers and units replaced, or, with
fewer than ``MIN_LITERALS`` such words, all its real words.  So a copy in other case is found, and so is a
verbatim copy of what is mostly names and numbers.  In scripts without blanks a character (with its marks)
is a word.
Per document, item and alignment (place in the document minus place in the item) the slots are then
checked: each slot value of the item stands for the value of the document that most windows give it, and
windows with another one are dropped.  So a question whose numbers, names or units were changed is found,
also where two of them became equal or one place differs, and a chance match is not.

A document is a leak of an item if consistent windows cover at least ``COVER_WORDS`` words of it, or
the share ``COVER_SHARE`` of a shorter one.  Items shorter than a window are matched as one window of their
own length; those under ``MIN_WORDS`` words, which prose may hold by chance, by their real words and only where
they are a whole sentence or line of the document.

The documents are templated whole, in numpy, in one pass without a shuffle; only windows whose hash the
benchmark has leave the worker.  For this its hashes are broadcast: themselves while there are at most
``MAX_HASHES``, beyond that as a Bloom filter of ``BLOOM_BITS``, so that the windows in the (shuffled) join
stay few at every size of the benchmark; the result is the same.

Cases: null texts have no words; a null document id is one document of its own; repeated rows change
nothing; of different texts under one id each is compared on its own, and the one that covers the most
counts; empty tables give no leaks; other columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_bytes, map_arrow, mix, series, write_table
from .words import hashes, spans, utf8

WINDOW = 8
MIN_WORDS = 5
MIN_LITERALS = 4
COVER_WORDS = 13
COVER_SHARE = 0.6
MAX_HASHES = 1 << 21
#: Bits of the Bloom filter of a larger benchmark's hashes: 32 MB.
BLOOM_BITS = 1 << 28

# Units (fixed values), after a number only.
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "foot",
         "inch", "inches", "in", "yard", "yards", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
         "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
         "mph", "kmh", "degree", "degrees", "gram", "grams", "kilogram", "kilograms", "pound", "pounds")
LITERAL, NUMBER, NAME, UNIT = range(4)

_table = np.zeros(256, bool)
_table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r"]] = True
_SLOT = series(5, 4)
_FACTOR = series(6, 64) | np.uint64(1)

# Scripts without blanks (fixed ranges): Han, kana and bopomofo; Thai, Lao, Myanmar and Khmer.
_NO_BLANKS = ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C),
              (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
              (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
_LEADING = (*range(0x0E40, 0x0E45), *range(0x0EC0, 0x0EC5))  # vowels written before their consonant
PLAIN, SEPARATOR, ALONE, MARK, LEAD = range(5)


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point under 0x10000; those of another length in UTF-8 stay."""
    kinds = np.full(1 << 16, PLAIN, np.uint8)
    low = np.arange(1 << 16)
    for c in range(0x80, 1 << 16):
        ch = chr(c)
        small = ch.lower()
        if len(small) == 1 and (0x80 <= ord(small) < 0x800 if c < 0x800 else 0x800 <= ord(small) < 1 << 16):
            low[c] = ord(small)
        if unicodedata.category(ch)[0] in "PZ":
            kinds[c] = SEPARATOR
    for a, b in _NO_BLANKS:
        for c in range(a, b + 1):
            kind = unicodedata.category(chr(c))
            if kinds[c] != SEPARATOR and kind != "Nd":
                kinds[c] = MARK if kind in ("Mn", "Mc") else ALONE
    kinds[list(_LEADING)] = LEAD
    kinds[0x80:0xC0] = kinds[0x2000:0x2080] = SEPARATOR
    return kinds, low


_KINDS, _LOW = _code_points()


class Template:
    """Template words of a string column: row, class, hashes (``real``: of the word itself) and bytes of each."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        n = len(raw)
        ahead = np.concatenate([raw[1:], [0]]).astype(np.uint8) if n else raw
        behind = np.concatenate([[0], raw[:-1]]).astype(np.uint8) if n else raw
        digit = (raw >= 48) & (raw <= 57)
        word = _table[raw]
        point = (raw == 44) | (raw == 46)
        word |= point & (ahead >= 48) & (ahead <= 57) & (behind >= 48) & (behind <= 57)
        upper = ((raw >= 65) & (raw <= 90))
        low = raw + upper * np.uint8(32)
        two = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF))
        point2 = ((raw[two] & 31).astype(np.int64) << 6) | (raw[two + 1] & 63)
        three = np.flatnonzero((raw[:-2] >= 0xE0) & (raw[:-2] <= 0xEF))
        point3 = (((raw[three] & 15).astype(np.int64) << 12) | ((raw[three + 1] & 63).astype(np.int64) << 6)
                  | (raw[three + 2] & 63))
        small = _LOW[point2]
        low[two], low[two + 1] = 0xC0 | (small >> 6), 0x80 | (small & 63)
        upper[two] = small != point2
        small = _LOW[point3]
        low[three], low[three + 1], low[three + 2] = 0xE0 | (small >> 12), 0x80 | ((small >> 6) & 63), 0x80 | (small & 63)
        upper[three] = small != point3
        # Punctuation and blanks beyond ASCII separate words.
        two, kind3 = two[_KINDS[point2] == SEPARATOR], _KINDS[point3]
        apart = three[kind3 == SEPARATOR]
        word[np.concatenate([two, two + 1, apart, apart + 1, apart + 2])] = False
        # Scripts without blanks: cut before each character and after it, but not before its marks.
        alone, mark, lead = three[kind3 == ALONE], three[kind3 == MARK], three[kind3 == LEAD]
        wide = np.flatnonzero((raw[:-3] == 0xF0) & (raw[1:-2] >= 0xA0))  # ideographs from U+20000
        cut = np.zeros(n + 4, bool)
        cut[np.concatenate([alone, alone + 3, mark + 3, wide, wide + 4])] = True
        cut[mark] = False
        cut[lead] = True
        cut[lead + 3] = False
        starts, ends = spans(word, np.concatenate([offsets, np.flatnonzero(cut[:n])]))
        self.low, self.starts, self.ends = low, starts, ends
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.n_rows = len(column)
        h = hashes(low, word, starts, ends)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw] & ~word)])
        m = len(starts)
        self.new = new = np.ones(m, bool)  # a sentence or line begins here
        if m:
            new[1:] = (self.row[1:] != self.row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
        capital = upper[starts]
        digits = np.concatenate([[0], np.cumsum(digit)])
        self.kind = np.zeros(m, np.int8)
        self.kind[capital & ~new] = NAME
        number = digits[ends] > digits[starts]
        self.kind[number] = NUMBER
        if m:
            unit = np.isin(h, _unit_hashes())
            unit[1:] &= number[:-1] & (self.row[1:] == self.row[:-1])
            unit[0] = False
            self.kind[unit & ~number] = UNIT
        self.real = h
        self.hash = np.where(self.kind == LITERAL, h, _SLOT[self.kind])

    def windows(self, size: int, names: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the windows of ``size`` words within a row: with ``names`` as slots those
        with enough literals, else all, where one short of literals has the hash of its real words."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literal = (self.kind == LITERAL) | ((self.kind == NAME) & (not names))
        words = self.hash if names else np.where(literal, self.real, self.hash)
        count = np.concatenate([[0], np.cumsum(literal)])
        enough = count[size:] - count[:-size] >= min(size, MIN_LITERALS)
        inside = self.row[:m] == self.row[size - 1:]
        if size < MIN_WORDS:  # whole sentences and lines, by their real words
            at = np.flatnonzero(inside & self.new[:m] & np.append(self.new, True)[size:size + m])
            with np.errstate(over="ignore"):
                exact = sum((self.real[at + k] * _FACTOR[k] for k in range(size)), np.zeros(len(at), np.uint64))
                return at, mix(exact + np.uint64(size + 128))
        with np.errstate(over="ignore"):
            total = np.zeros(m, np.uint64)
            for k in range(size):
                total += words[k:k + m] * _FACTOR[k]
            total = mix(total + np.uint64(size if names else size + 64))
            if names:
                at = np.flatnonzero(inside & enough)
                return at, total[at]
            short = np.flatnonzero(inside & ~enough)
            exact = np.zeros(len(short), np.uint64)
            for k in range(size):
                exact += self.real[short + k] * _FACTOR[k]
            total[short] = mix(exact + np.uint64(size + 128))
        at = np.flatnonzero(inside)
        return at, total[at]

    def slots(self, at: int, size: int, names: bool) -> list[str]:
        return [self.low[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")
                for i in range(at, at + size) if self.kind[i] != LITERAL and (names or self.kind[i] != NAME)]


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        raw, off = utf8(pa.array(UNITS))
        _units.append(np.sort(hashes(raw, np.ones(len(raw), bool), off[:-1], off[1:])))
    return _units[0]


def _windows_of(rows: DataFrame, sizes: list[int] | None, wanted) -> DataFrame:
    """(id, source, size, pos, h, n_words, slots) of an (id, text) table; ``source`` tells its texts apart.  ``sizes`` None: benchmark items, each
    with the window size that fits it.  ``wanted``: broadcast (sorted hashes, their low bits) or (None, Bloom
    filter); None for all."""
    def work(batches):
        for batch in by_bytes(batches, "text"):
            t = Template(batch.column("text"))
            ids, source = batch.column("id"), batch.column("source")
            count = np.bincount(t.row, minlength=t.n_rows)
            first = np.cumsum(count) - count
            for size, names in itertools.product(sizes or range(1, WINDOW + 1), (True, False)):
                if names and size < MIN_WORDS:
                    continue
                at, h = t.windows(size, names)
                if sizes is None:
                    fits = count[t.row[at]] >= size if size == WINDOW else count[t.row[at]] == size  # a short item is one window
                    at, h = at[fits], h[fits]
                if wanted is not None and len(h):
                    there, bits = wanted.value
                    if there is None:
                        found = np.flatnonzero(bloom.maybe(bits, h.view(np.int64), 8 * len(bits)))
                    else:
                        maybe = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
                        near = np.minimum(np.searchsorted(there, h[maybe]), len(there) - 1)
                        found = maybe[there[near] == h[maybe]]
                    at, h = at[found], h[found]
                row = t.row[at]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), source.take(pa.array(row)), pa.array(np.full(len(at), size), pa.int32()),
                     pa.array(at - first[row], pa.int32()), pa.array(h.view(np.int64)),
                     pa.array(count[row], pa.int32()),
                     pa.array([t.slots(int(i), size, names) for i in at], pa.list_(pa.string()))],
                    names=["id", "source", "size", "pos", "h", "n_words", "slots"])

    return (rows.withColumn("source", F.xxhash64("text"))
            .transform(map_arrow, work, "id bigint, source bigint, size int, pos int, h bigint, n_words int, "
                                        "slots array<string>"))


def consistent(windows: list[dict]) -> tuple[list[int], int, int]:
    """(places, slots, changed slots) of the windows of one alignment, (pos, slots), that give each slot
    value of the item the document value that most of them give it (of equals the unchanged one)."""
    pairs = [{(x["i"], x["d"]) for x in w["slots"]} for w in windows]
    votes = Counter(p for found in pairs for p in found)
    chosen: dict[str, tuple] = {}
    for (i, d), n in votes.items():
        chosen[i] = max(chosen.get(i, (0, False, "")), (n, i == d, d))
    fits = [all(chosen[i][2] == d for i, d in found) for found in pairs]
    kept = {p for found, fine in zip(pairs, fits, strict=True) if fine for p in found}
    at = sorted({w["pos"] for w, fine in zip(windows, fits, strict=True) if fine})
    return at, len(kept), sum(i != d for i, d in kept)


def _consistent(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, n_slots, n_changed) of the alignments (keys, windows) that keep a window."""
    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [consistent(w) for w in part.column("windows").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array([x[0] for x in found], pa.list_(pa.int32())),
                     pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
                    names=[*keys, "at", "n_slots", "n_changed"])

    fields = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in keys)
    return (aligned.select(*keys, "windows")
            .transform(map_arrow, work, f"{fields}, at array<int>, n_slots int, n_changed int")
            .where(F.size("at") > 0))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
           max_hashes: int, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(doc_id, doc_text, item_id, counts) of the leaks, per text: ``doc_text`` is a hash that tells apart the texts of
    one id."""
    spark = docs.sparkSession
    items = write_table(_windows_of(benchmark.select(F.col(item_col).cast("bigint").alias("id"),
                                                     F.col(item_text_col).cast("string").alias("text")), None, None),
                        "benchmark-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    known = items.select("h").distinct()
    if known.limit(max_hashes + 1).count() <= max_hashes:
        there = np.sort(known.toArrow()["h"].to_numpy().view(np.uint64)) if sizes else np.zeros(0, np.uint64)
        bits = np.zeros(1 << max(10, (16 * len(there)).bit_length()), bool)
        bits[(there & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        wanted = spark.sparkContext.broadcast((there, bits))
    else:
        wanted = spark.sparkContext.broadcast((None, bloom.build(known, bloom_bits)))
    found = _windows_of(docs.select(F.col(id_col).cast("bigint").alias("id"),
                                    F.col(text_col).cast("string").alias("text")), sizes or [WINDOW], wanted)
    if not sizes:
        found = found.limit(0)
    d, b = found.alias("d"), items.alias("b")
    pairs = d.join(b, (F.col("d.h") == F.col("b.h")) & (F.col("d.size") == F.col("b.size"))).select(
        F.col("d.id").alias("doc_id"), F.col("d.source").alias("doc_text"), F.col("b.id").alias("item_id"),
        F.col("b.source").alias("item_text"), (F.col("d.pos") - F.col("b.pos")).alias("shift"),
        F.col("b.pos").alias("pos"), F.col("b.size").alias("size"), F.col("b.n_words").alias("n_words"),
        F.arrays_zip(F.col("b.slots").alias("i"), F.col("d.slots").alias("d")).alias("slots"))
    texts = ["doc_id", "doc_text", "item_id", "item_text", "n_words", "size"]
    # Sets within one alignment: at most the windows of the item.
    aligned = pairs.groupBy(*texts, "shift").agg(F.collect_set(F.struct("pos", "slots")).alias("windows"))
    per_item = _consistent(aligned, texts).groupBy(*texts).agg(
        F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"),
        F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"))
    words = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("size") - 1))))
    counted = per_item.select("doc_id", "doc_text", "item_id", F.size("at").alias("n_windows"), F.size(words).alias("n_covered"),
                              "n_words", "n_slots", "n_changed")
    need = F.least(F.lit(COVER_WORDS), F.ceil(F.col("n_words") * COVER_SHARE))
    return counted.where(F.col("n_covered") >= need)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", max_hashes: int = MAX_HASHES) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, n_words, n_slots, n_changed): the leaks, one row per
    document and item.  ``n_changed``: slots whose value differs from the item's."""
    columns = ["n_windows", "n_covered", "n_words", "n_slots", "n_changed"]
    best = F.max(F.struct("n_covered", "n_windows", "n_words", "n_slots", "n_changed"))
    return (_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, max_hashes).groupBy("doc_id", "item_id")
            .agg(best.alias("best")).select("doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in columns]))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", max_hashes: int = MAX_HASHES) -> DataFrame:
    """The rows whose text leaks no item, with their columns: of several texts under one id, or without id, only those
    that leak go."""
    bad = (_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, max_hashes)
           .select(F.col("doc_id").alias("leaked"), "doc_text").distinct())
    source = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(bad, (source == F.col("doc_text")) & docs[id_col].cast("bigint").eqNullSafe(F.col("leaked")), "left_anti")
