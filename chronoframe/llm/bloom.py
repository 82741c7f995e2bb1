"""A Bloom filter of a table's column, of a fixed size: it keeps rows that can't match out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, series

#: Bits of a filter: 4 MB for the broadcast at every input size.  About ten bits a key keep 99 % of the
#: others out; with more keys the filter lets more rows through, which a join behind it drops.
BITS = 1 << 25
_PAGE = 1 << 16
_SEEDS = series(51, 4)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """(seeds, keys): the bit of each key under each seed."""
    with np.errstate(over="ignore"):
        return mix(keys.view(np.uint64)[None, :] + _SEEDS[:, None]) % np.uint64(bits)


def build(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter of a bigint column, as bytes: pages of it are made in tasks, the driver joins them."""
    def spread(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).drop_null().to_numpy(), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _PAGE), pa.array(at % _PAGE)], names=["page", "bit"])

    def pages(batches):
        page, held = None, None
        for batch in batches:
            number, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(number).tolist():
                if p != page:
                    if page is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([np.packbits(held).tobytes()])], names=["page", "bytes"])
                    page, held = p, np.zeros(_PAGE, bool)
                held[bit[number == p]] = True
        if page is not None:
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([np.packbits(held).tobytes()])], names=["page", "bytes"])

    out = np.zeros(max(bits, _PAGE) // 8, np.uint8)
    made = (keys.transform(map_arrow, spread, "page bigint, bit bigint").repartition("page").sortWithinPartitions("page")
            .transform(map_arrow, pages, "page bigint, bytes binary"))
    for r in made.collect():
        out[r["page"] * _PAGE // 8:(r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["bytes"], np.uint8)
    return out


def maybe(filter_: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each key may be in the filter; false means that it isn't."""
    at = _places(keys, bits)
    return ((filter_[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def kept(rows: DataFrame, column: str, filter_, bits: int = BITS) -> DataFrame:
    """The rows whose bigint ``column`` may be in the filter, a broadcast; null isn't."""
    def work(batches):
        for batch in batches:
            keys = batch.column(column)
            ok = maybe(filter_.value, keys.fill_null(0).to_numpy(), bits) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(ok))

    return rows.transform(map_arrow, work, rows.schema)


def broadcast(keys: DataFrame, bits: int = BITS):
    """The broadcast filter of the table's one bigint column."""
    return keys.sparkSession.sparkContext.broadcast(build(keys.select(F.col(keys.columns[0]).cast("bigint")), bits))
