"""Operator 3: secret scans with a password guess-cost dynamic program.

Three base patterns (assignments, access keys, hexadecimal runs) run over every whole text.  The
method then looks at each value in a credential context -- a wider list of credential words than the
assignment pattern has, followed by a separator -- and computes its guess cost: the cheapest
segmentation into dictionary words, dates, repeats (of a character or a block), keyboard walks and
brute-force spans, in bits.  A brute-force span costs, per character, the alphabet that the span mixes (26, 36, 52, 62, 95, ...).
Values of at least ``min_bits`` add a span of kind ``guess``; base spans always stay.

The dictionary is the list of whole words of a public vocabulary file, whose order is by frequency:
the cost of a word is the logarithm of its rank.  It goes to every worker; its size is checked.

Cases: a null text counts as empty (no spans); null or repeated ids pass through with their row;
texts of any length are scanned whole; an empty table gives an empty table; other columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow

KINDS = ("assign", "access", "hex", "guess")
SEGMENT_BITS = 1.0
#: Bits of guess cost from which a credential value counts as a secret: one that a hundred million guesses don't reach.
#: Random values of six characters, the shortest that a context admits, have 32 bits or more, less where they
#: hold a short word or a date.
MIN_BITS = math.log2(1e8)
#: Characters of the longest block whose repeats are a segment.
MAX_BLOCK = 32
MAX_WORDS = 1 << 18

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Credential words (fixed values) and what separates them from the value.  A credential word that is followed by a
# separator of its own is no value, so "auth: login: x" has the value x.
_WORD = (r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization)?"""
         r"""|bearer|credentials?|login)["']?(?:\x20*(?:[:=]|=>|:=)\x20*|\x20+is\x20+)["']?""")
CONTEXTS = (
    re.compile(rf"""{_WORD}(?:{_WORD})*(?:(?:bearer|basic)\x20+)?([^\s"'<>,;]{{6,}})""", re.IGNORECASE | re.ASCII),
    re.compile(r"""\b(?:bearer|basic)\x20+([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII),  # an authorization line
    re.compile(r"""\b[a-z][a-z0-9+.-]{0,30}://[^\s/:@"'<>]{0,256}:([^\s/@"'<>]{6,256})@""", re.IGNORECASE | re.ASCII),  # user:value@host
)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "basic", "credential", "login", "://")
BASE_HINTS = ("passw", "secret", "token", "api")

# Keyboard rows and the two plain sequences (fixed values).
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
                  r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)"
                  r"|(?:19|20)\d\d")
LEET = str.maketrans("013457@$!", "oieastasi")


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_words(path: str) -> dict[str, int]:
    """Whole words of at least three letters and their rank, from a vocabulary with word ends."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 7)
    if len(words) > MAX_WORDS:
        raise ValueError(f"{path} has more than {MAX_WORDS} words")
    return {w: rank for rank, (_, w) in enumerate(words, 1)}


def alphabet(ch: str) -> int:
    if ch.isdigit():
        return 10
    if ch.isascii() and ch.isalpha():
        return 26
    return 33 if ch.isascii() else 100


def sort_of(ch: str) -> int:
    """0 to 4: lower case, upper case, digit, other ASCII, beyond ASCII."""
    if ch.isdigit():
        return 2
    if not ch.isascii():
        return 4
    return 0 if ch.islower() else 1 if ch.isupper() else 3


#: Bits per character of a brute-force span that mixes the sorts of a bit mask.
_MIX_BITS = [0.0] + [math.log2(sum(n for i, n in enumerate((26, 26, 10, 33, 100)) if m >> i & 1)) for m in range(1, 32)]


def run_lengths(value: str) -> tuple[list[int], list[int]]:
    """For each end, the characters of the repeat and of the keyboard walk that end there."""
    low = value.lower()
    place = {c: (r, i) for r, row in reversed(list(enumerate(WALKS))) for i, c in enumerate(row)}
    place_abc = {c: i for i, c in enumerate(WALKS[-1])}
    same, walk, steps = [1] * len(low), [1] * len(low), [0, 0]
    for i in range(1, len(low)):
        a, b = low[i - 1], low[i]
        if a == b:
            same[i] = same[i - 1] + 1
        step = 0
        if a in place and b in place and place[a][0] == place[b][0]:
            step = place[b][1] - place[a][1]
        abc = place_abc[b] - place_abc[a] if a in place_abc and b in place_abc else 0
        now = [step if abs(step) == 1 else 0, abc if abs(abc) == 1 else 0]
        if any(n and (n == s or walk[i - 1] == 1) for n, s in zip(now, steps, strict=True)):
            walk[i] = walk[i - 1] + 1
        elif any(now):
            walk[i] = 2
        steps = now
    return same, walk


def block_repeats(value: str) -> list[list[tuple[int, int]]]:
    """For each end, (block length, copies after the first) of the blocks of 2 to ``MAX_BLOCK`` characters that repeat up
    to there."""
    out: list[list[tuple[int, int]]] = [[] for _ in value]
    for p in range(2, min(MAX_BLOCK, len(value) // 2) + 1):
        same = 0
        for i in range(p, len(value)):
            same = same + 1 if value[i] == value[i - p] else 0
            if same >= p:
                out[i].append((p, same // p))
    return out


def guess_bits(value: str, words: dict[str, int], longest: int) -> float:
    """Least bits over all segmentations of the value; brute force costs, per character,
    the alphabet of all sorts of characters in its span."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET) if len(low.translate(LEET)) == len(low) else low
    if len(low) != n:
        low = plain = value
    same, walk = run_lengths(value) if len(value.lower()) == n else ([1] * n, [1] * n)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    blocks = block_repeats(value)
    best = [0.0] + [math.inf] * n
    sorts = [1 << sort_of(c) for c in value]
    present = 0
    for bit in set(sorts):
        present |= bit
    masks = [m for m in range(1, 32) if m & present == m]
    brute = dict.fromkeys(masks, math.inf)  # least bits of what ends here in a brute-force span over the mask
    other = 0.0  # least bits of what ends here in anything else: brute-force spans don't follow each other
    for j in range(1, n + 1):
        i = j - 1
        start = other + SEGMENT_BITS
        for m in masks:
            brute[m] = min(brute[m], start) + _MIX_BITS[m] if m & sorts[i] else math.inf
        cost = math.inf
        for k in range(max(0, j - longest), j - 2):
            part = low[k:j]
            rank = words.get(part)
            extra = 0.0
            if rank is None and (rank := words.get(plain[k:j])) is not None:
                extra = 1.0 + sum(a != b for a, b in zip(part, plain[k:j], strict=True))
            if rank is not None:
                if value[k:j] != part:
                    extra += 1.0
                c = best[k] + math.log2(rank + 1) + extra + SEGMENT_BITS
                cost = min(cost, c)
        for length, base in ((same[i], math.log2(alphabet(value[i]))), (walk[i], math.log2(94))):
            if length >= 3:
                c = best[j - length] + base + math.log2(length) + SEGMENT_BITS
                cost = min(cost, c)
        for p, copies in blocks[i]:
            cost = min(cost, best[j - p * copies] + math.log2(p) + math.log2(copies) + SEGMENT_BITS)
        for k in dates.get(j, ()):
            year = j - k == 4 and value[k:k + 2] in ("19", "20")
            c = best[k] + math.log2(200 if year else 200 * 366) + SEGMENT_BITS
            cost = min(cost, c)
        other = cost
        best[j] = min(cost, *brute.values())
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in BASE_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def scan_text(text: str, words: dict[str, int], longest: int,
              min_bits: float) -> tuple[list[tuple[int, int, int]], float | None]:
    """All spans, sorted, and the largest guess cost of a credential value (None without one)."""
    spans = base_spans(text)
    most = None
    low = text.lower()
    if any(h in low for h in HINTS):
        # reach: the furthest end of the base spans that begin by the value; taken: the end of the last value.
        base, at, reach, taken = sorted(spans), 0, -1, 0
        for m in sorted((m for c in CONTEXTS for m in c.finditer(text)), key=lambda m: m.span(1)):
            if m.start(1) < taken:
                continue
            taken = m.end(1)
            while at < len(base) and base[at][0] <= m.start(1):
                reach = max(reach, base[at][2])
                at += 1
            bits = guess_bits(m[1], words, longest)
            most = bits if most is None else max(most, bits)
            if bits >= min_bits and reach < m.end(1):
                spans.append((m.start(1), 3, m.end(1)))
    return sorted(spans), most


def render(spans, base_only: bool = False) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if not base_only or k < 3)


def _scanner(spark, words_path, min_bits):
    words = load_words(words_path or default_words())
    longest = max(map(len, words), default=0)
    shared = spark.sparkContext.broadcast(words)
    return lambda text: scan_text(text, shared.value, longest, min_bits)


def scan(docs: DataFrame, words_path: str | None = None, min_bits: float = MIN_BITS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_spans, spans, max_bits), one row per input row."""
    look = _scanner(docs.sparkSession, words_path, min_bits)

    def work(batches):
        for batch in by_bytes(batches, "text"):
            got = [look(t or "") for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s, _ in got], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *counts, pa.array([render(s, True) for s, _ in got], pa.string()),
                 pa.array([render(s) for s, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())],
                names=["id", "n_assign", "n_access", "n_hex", "n_guess", "base_spans", "spans", "max_bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .transform(map_arrow, work, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, "
                              "base_spans string, spans string, max_bits double")
            .withColumnRenamed("id", id_col))


def redact(docs: DataFrame, words_path: str | None = None, min_bits: float = MIN_BITS,
           text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span, overlapping ones joined, replaced by [SECRET];
    ``chars_col``, if the table has it, follows the new length of a changed text."""
    look = _scanner(docs.sparkSession, words_path, min_bits)
    where = docs.columns.index(text_col)

    def clean(text):
        if text is None:
            return None
        spans, out, end = look(text)[0], [], 0
        for s, _, e in spans:
            if s >= end:
                out += [text[end:s], "[SECRET]"]
            end = max(end, e)
        return "".join([*out, text[end:]]) if spans else text

    def work(batches):
        for batch in by_bytes(batches, text_col):
            columns = list(batch.columns)
            old = columns[where].to_pylist()
            new = [clean(t) for t in old]
            columns[where] = pa.array(new, pa.string())
            if chars_col in batch.schema.names:
                i = batch.schema.names.index(chars_col)
                kept = columns[i].to_pylist()
                columns[i] = pa.array([len(b) if a != b else k for a, b, k in zip(old, new, kept, strict=True)],
                                      columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.transform(map_arrow, work, docs.schema)
