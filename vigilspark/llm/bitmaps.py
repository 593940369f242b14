"""Fixed-size bitmaps of hashed keys, gathered by Spark and broadcast.

A bitmap only ever saves work: a key that is in it by chance is handled like any other, and an exact join
decides afterwards. Its size is a parameter and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB.
BITS = 26
_SLICE = 16


def slot(key: Column, bits: int = BITS) -> Column:
    """Slot of a 64-bit hash: its upper bits."""
    return F.shiftrightunsigned(key, 64 - bits)


def slots(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(table: pa.Table) -> pa.Table:
    at = table.column("s").to_numpy() & ((1 << _SLICE) - 1)
    bits = np.zeros(1 << _SLICE, dtype=bool)
    bits[at] = True
    return pa.table({"slice": [table.column("slice")[0].as_py()], "bits": [np.packbits(bits).tobytes()]})


def gather(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bitmap of the 64-bit hashes in ``column``: one bool for each slot.

    Slots are made distinct first, so a slice of 65,536 slots is one small group; the driver receives
    ``2 ** bits / 8`` bytes at most.
    """
    marked = keys.select(slot(F.col(column), bits).alias("s")).distinct()
    marked = marked.select(F.shiftright("s", _SLICE).alias("slice"), "s")
    out = np.zeros(1 << bits, dtype=bool)
    for row in marked.groupBy("slice").applyInArrow(_pack, "slice long, bits binary").collect():
        at = row["slice"] << _SLICE
        out[at : at + (1 << _SLICE)] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8)).astype(bool)
    return out


def pack(bitmap: np.ndarray) -> np.ndarray:
    """Eight slots a byte, for the broadcast."""
    return np.packbits(bitmap)


def test(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def arrow(batch: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches from dicts of NumPy arrays or lists."""
    for columns in batch:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
