"""Operator 2: unigram token counts by dynamic programming over a trie of pre-tokens.

The tokens of a pre-token (a run without white space, with a word mark before it) are those of its
best segmentation under a unigram model.  The distinct pre-tokens of a batch go through a trie in
sorted order: the forward scores of a prefix are computed once and shared by all pre-tokens below
it, and the terminal node stores the token count.  Terminals stay in the worker's table for later
batches, until the table has ``MAX_KEPT`` entries and starts anew; that changes the speed alone.
Per document the counts are summed over all pre-tokens of the whole text.  No shuffle is needed.

Scores: the pieces of a public vocabulary file in rank order, log-probability -log(rank + 1)
(Zipf's rule).  A character that no piece covers costs one token per UTF-8 byte, each scored below
the last piece.  Ties go to the fewest tokens.

Cases: a null or blank text has 0 pre-tokens and 0 tokens; null or repeated ids pass through with
their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow

MAX_PIECES = 1 << 20
MAX_KEPT = 1 << 19
MARK = "▁"
WORD = re.compile(r"\S+")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, float]:
    """Pieces and their log-probabilities; control, byte and blank-run pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    real = [model.id_to_piece(i) for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    real = [p for p in real if p.strip(MARK) or p == MARK]
    return {p: -math.log(rank + 1) for rank, p in enumerate(real, 1)}


class PrefixTrie:
    """Forward scores along the current path of the trie, walked in sorted order."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = -math.log(len(scores) + 2)
        self.counts: dict[str, int] = {}

    def add(self, tokens: list[str]) -> None:
        """Store the counts of the pre-tokens that aren't known yet."""
        if len(self.counts) > MAX_KEPT:
            self.counts.clear()
        path, best = "", [(0.0, 0)]
        scores, longest = self.scores, self.longest
        for token in sorted(t for t in tokens if t not in self.counts):
            word = MARK + token
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                n_bytes = len(word[j - 1].encode("utf-8", "surrogatepass"))
                s, c = best[j - 1]
                top = (s + n_bytes * self.byte, c - n_bytes)
                for i in range(max(0, j - longest), j):
                    score = scores.get(word[i:j])
                    if score is not None:
                        s, c = best[i]
                        if (s + score, c - 1) > top:
                            top = (s + score, c - 1)
                best.append(top)
            path = word
            self.counts[token] = -best[-1][1]


def count_tokens(docs: DataFrame, pieces_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens, n_bytes), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_scores(pieces_path or default_pieces()))

    def work(batches):
        trie = PrefixTrie(shared.value)
        for batch in by_bytes(batches, "text"):
            words = [WORD.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            trie.add(set().union(*words))
            get = trie.counts.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([sum(map(get, w)) for w in words], pa.int64()),
                 pa.compute.binary_length(pa.compute.cast(batch.column("text"), pa.binary())).fill_null(0).cast(pa.int64())],
                names=["id", "n_pretokens", "n_tokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .transform(map_arrow, work, f"id {kind}, n_pretokens bigint, n_tokens bigint, n_bytes bigint")
            .withColumnRenamed("id", id_col))
