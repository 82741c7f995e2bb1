"""Operator 9: language spans of mixed-language text.

``learn`` counts, per language, hashed letter trigrams of words and the scripts of letters, in Spark,
over at most about ``per_lang`` labelled rows of each language (a bounded sample by a hash of the id).
``predict`` scores every word of every whole text: the script of a word narrows its candidate
languages, its trigrams give a log-likelihood for each, and a Viterbi pass over the words of a text,
with a penalty for each switch, labels them.  Runs of one label are the spans; the prediction is the
language with the most letters, the score its share of the letters (0 to 1).  A text of more than ``LONG``
characters is scored in pieces, and the words of a piece go forward in blocks, from every label before
the block at once; so time is linear with few steps, and memory is that of a piece and of one label per word.

The model has languages x ``BUCKETS`` values; more than ``MAX_LANGS`` languages are refused.

Cases: ``und`` with score 0 and no spans if the text is null or has no letter; ties go to the name
that sorts first; a word of more than twice ``LONG`` letters is cut; repeated rows get the same result; without any labelled row every text is ``und``;
an empty table gives an empty table.  ``predict`` carries the input columns in one struct ``row``, so
clashing names can't arise.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, mix

BUCKETS = 1 << 15
MAX_LANGS = 256
PER_LANG = 4000
SWITCH = 12.0
#: UTF-8 bytes handled at once: the arrays of a step take some fifty times as much.
SLICE = 1 << 20
#: Characters from which a text is labelled in pieces of that length.
LONG = 1 << 18
#: Words of a block of a long text, and values of the blocks that go forward together.
BLOCK = 256
CELLS = 1 << 20
SMOOTH = 0.5
UNKNOWN = "und"

# First code points of script ranges and the script from there on (fixed values); 0: any other.
SCRIPTS = (
    (0x0000, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"),
    (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""),
    (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""), (0x20000, "Han"), (0x30000, ""),
)
_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([start for start, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
#: Share of a language's letters from which a script is one of its own.
SCRIPT_SHARE = 0.01

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Words:
    """Words (runs of letters) of a list of texts: trigram buckets per letter and word bounds."""

    def __init__(self, texts: list[str | None]):
        # Lower case of one character per character, so that places are those of the text.
        low = [t if not t or len(s := t.lower()) != len(t) else s for t in texts]
        low = [t or "" for t in low]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
        chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(chars) + 1, bool)
        first[offsets] = True
        mask = letter_table()[chars] if len(chars) else np.zeros(0, bool)
        before = np.concatenate([[False], mask[:-1]]) & ~first[:-1]
        after = np.concatenate([mask[1:] & ~first[1:-1], [False]]) if len(chars) else mask
        self.starts = np.flatnonzero(mask & ~before)
        self.ends = np.flatnonzero(mask & ~after) + 1
        at = np.flatnonzero(mask)
        key = chars[at].astype(np.uint64) << np.uint64(21)
        inner = before[at]
        key[inner] |= chars[at[inner] - 1].astype(np.uint64) << np.uint64(42)
        inner = after[at]
        key[inner] |= chars[at[inner] + 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            self.bucket = (mix(key) % np.uint64(BUCKETS)).astype(np.int32)
        self.lengths = self.ends - self.starts
        self.letter_starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.script = _SCRIPT[np.searchsorted(_FROM, chars[self.starts], "right") - 1]
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.offsets = offsets
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray, own: np.ndarray):
        self.langs, self.log_p, self.own = langs, log_p, own

    def word_scores(self, w: Words) -> np.ndarray:
        """Log-likelihood of each word in each language; languages that don't write its script are out."""
        out = np.empty((len(w.starts), len(self.langs)), np.float32)
        for i, row in enumerate(self.log_p):
            out[:, i] = np.add.reduceat(row[w.bucket], w.letter_starts[:-1]) if len(w.starts) else 0
        allowed = self.own[w.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        out[~allowed] -= 1e4
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH, start: np.ndarray | None = None,
            end: np.ndarray | None = None) -> np.ndarray:
    """Best label of each word.  ``scores``: words of all texts in order, ``counts``: words per text.
    ``start``: values of the labels before each text, ``end``: the label of its last word, where known.
    All texts go forward together, the long ones first in order so that the active ones are a prefix."""
    n, k = scores.shape
    label = np.zeros(n, np.int16)
    if not n:
        return label
    order = np.argsort(-counts, kind="stable")
    sorted_counts = counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    longest = int(sorted_counts[0])
    active = np.searchsorted(-sorted_counts, -np.arange(longest), "left")
    value = np.zeros((len(counts), k)) if start is None else start[order].astype(float)
    stay, source = [], []
    for t in range(longest):
        m = active[t]
        now = value[:m]
        if t or start is not None:
            top = now.argmax(axis=1)
            jump = now[np.arange(m), top][:, None] - switch
            keep = now >= jump
            if t:
                stay.append(keep)
                source.append(top.astype(np.uint8))
            now = np.where(keep, now, jump)
        value[:m] = now + scores[begin[:m] + t]
    last = (value.argmax(axis=1) if end is None else end[order]).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        label[begin[:m] + t] = last[:m]
        if t:
            rows = np.arange(m)
            last[:m] = np.where(stay[t - 1][rows, last[:m]], last[:m], source[t - 1])
    return label


def transfer(scores: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """(best, counts): the words of one text in blocks, ``best[b, i, j]`` the best value of block b from label
    i before it to label j at its end.  All blocks go forward together."""
    n, k = scores.shape
    blocks = max(1, min(-(-n // BLOCK), CELLS // (k * k)))
    size = -(-n // blocks)
    blocks = -(-n // size)
    counts = np.full(blocks, size)
    counts[-1] = n - size * (blocks - 1)
    best = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -np.inf), (blocks, k, k)).copy()
    for t in range(size):
        m = blocks if t < counts[-1] else blocks - 1
        now = best[:m]
        best[:m] = np.maximum(now, now.max(axis=2, keepdims=True) - switch) + scores[t::size][:m, None, :]
    return best, counts


def _forward(best: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of the labels before each block, and at the end."""
    values = [value]
    for block in best:
        values.append((values[-1][:, None] + block).max(axis=0))
    return np.stack(values)


def _backward(scores: np.ndarray, best: np.ndarray, counts: np.ndarray, value: np.ndarray, end: int,
              switch: float) -> tuple[np.ndarray, int]:
    """Labels of the words, and the label before the first one."""
    values = _forward(best, value)
    ends = [end]
    for b in range(len(best) - 1, -1, -1):
        ends.append(int((values[b] + best[b][:, ends[-1]]).argmax()))
    ends = np.array(ends[::-1])
    start = np.where(np.arange(scores.shape[1]) == ends[:-1, None], 0.0, -np.inf)
    return viterbi(scores, counts, switch, start, ends[1:]), int(ends[0])


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """Cuts of a text after ``size`` characters each, where a word ends or, within a word, at twice that."""
    out, start = [], 0
    while len(text) - start > size:
        cut = next((i for i in range(start + size, min(len(text), start + 2 * size)) if not text[i].isalpha()),
                   min(len(text), start + 2 * size))
        out.append((start, cut))
        start = cut
    return [*out, (start, len(text))]


def label_long(text: str, model: Model, switch: float = SWITCH, size: int | None = None):
    """(start, end, label) arrays of the words of one long text.  Forward, only the values of the labels
    before each piece are kept; backward, each piece is scored once more and labelled."""
    cuts = pieces(text, size or LONG)

    def scored(cut):
        w = Words([text[slice(*cut)]])
        return w, model.word_scores(w)

    before, value = [], np.zeros(len(model.langs))
    for cut in cuts:
        before.append(value)
        w, scores = scored(cut)
        if len(w.starts):
            value = _forward(transfer(scores, switch)[0], value)[-1]
    end, found = int(value.argmax()), []
    for cut, value in zip(reversed(cuts), reversed(before), strict=True):
        w, scores = scored(cut)
        if len(w.starts):
            label, end = _backward(scores, *transfer(scores, switch), value, end, switch)
            found.append((w.starts + cut[0], w.ends + cut[0], label))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))
    return tuple(np.concatenate(c) for c in zip(*(found[::-1] or [none]), strict=True))


def learn(labelled: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the labelled rows; rows without text or language don't count."""
    known = (labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                             F.col(lang_col).cast("string").alias("lang"))
             .where(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["n"]))])
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < share[F.col("lang")]).select("lang", "text")
    number = {name: i for i, name in enumerate(langs)}
    width = BUCKETS + len(_NAMES)

    def count(batches):
        for batch in by_bytes(batches, "text", SLICE):
            w = Words(batch.column("text").to_pylist())
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            per_letter = np.repeat(lang[w.doc], w.lengths)
            script = np.repeat(w.script, w.lengths)
            got = np.bincount(np.concatenate([per_letter * width + w.bucket, per_letter * width + BUCKETS + script]))
            cells = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(got[cells], pa.int64())],
                                             names=["cell", "n"])

    total = np.zeros(len(langs) * width)
    cells = (sample.transform(map_arrow, count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
             .toArrow())  # at most languages x (BUCKETS + scripts) rows
    total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    total = total.reshape(len(langs), width)
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    log_p = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    own = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, log_p.astype(np.float32), own.T.copy())


def predict(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH,
            carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score, spans): the input row as a struct (its columns ``carry``, by default
    all), its language, the share of letters in it, and the labelled spans (start, end, lang) in
    code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def with_text(batch):
        """The text beside the row, from the row where it is carried: it is sent once."""
        text = batch.column("row").flatten()[carry.index(text_col)] if text_col in carry else batch.column("text")
        return pa.RecordBatch.from_arrays([batch.column("row"), text.cast(pa.string())], names=["row", "text"])

    def apart(batches):
        """(batch, long): long texts each alone."""
        for batch in by_bytes(map(with_text, batches), "text", SLICE):
            chars = pa.compute.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(chars > LONG)
            cuts = sorted({0, *at.tolist(), *(at + 1).tolist(), batch.num_rows})
            for a, b in itertools.pairwise(cuts):
                yield batch.slice(a, b - a), bool(chars[a] > LONG)

    def work(batches):
        m = shared.value
        names = np.array(m.langs, object)
        for batch, long in apart(batches):
            n = batch.num_rows
            texts = batch.column("text").to_pylist()
            if not m.langs:
                doc = start = end = label = np.zeros(0, np.int64)
            elif long:
                start, end, label = label_long(texts[0], m, switch)
                doc = np.zeros(len(start), np.int64)
            else:
                w = Words(texts)
                doc, label = w.doc, viterbi(m.word_scores(w), w.counts, switch)
                start, end = w.starts - w.offsets[doc], w.ends - w.offsets[doc]
            pred, score = [UNKNOWN] * n, np.zeros(n)
            if len(doc):
                letters = np.bincount(doc * len(names) + label, end - start, n * len(names)).reshape(n, -1)
                every = letters.sum(axis=1)
                best = letters.argmax(axis=1)
                score = np.where(every > 0, letters[np.arange(n), best] / np.maximum(every, 1), 0.0)
                pred = np.where(every > 0, names[best], UNKNOWN)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            stop = np.concatenate([at[1:], [len(doc)]]).astype(np.int64) - 1
            flat = pa.StructArray.from_arrays(
                [pa.array(start[at], pa.int32()), pa.array(end[stop[:len(at)]], pa.int32()),
                 pa.array(names[label[at]].tolist() if len(at) else [], pa.string())], fields=list(span_type))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(list(pred), pa.string()), pa.array(score, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)],
                names=["row", "lang_pred", "score", "spans"])

    carry = carry or docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"),
                       *([] if text_col in carry else [F.col(text_col).alias("text")]))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.transform(map_arrow, work, f"row {kind}, lang_pred string, score double, "
                                 "spans array<struct<start:int,end:int,lang:string>>")
