"""Bitmaps of fixed size over 64-bit hashes: a first sieve whose size doesn't depend on the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def build(hashes: DataFrame):
    """Broadcast bitmap of 2**BITS bits of a one-column DataFrame: at most one row for each 64 bits comes to the driver."""
    (name,) = hashes.columns
    h = F.col(name)
    words = hashes.groupBy(F.shiftright(h.bitwiseAND((1 << BITS) - 1), 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")).alias("bits"))
    bitmap, got = np.zeros(1 << (BITS - 6), np.int64), words.toArrow()
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def opened(bitmap) -> np.ndarray:
    return np.frombuffer(bitmap.value, np.uint64)


def maybe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve(rows: DataFrame, column: str, bitmap, inside: bool = True) -> DataFrame:
    """Rows whose hash in `column` may be in the bitmap: all that are, and some others; with inside=False the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(bitmap)
        for batch in batches:
            yield batch.filter(pa.array(maybe(words, batch.column(column).to_numpy(zero_copy_only=False)) == inside))

    return rows.mapInArrow(run, rows.schema)
