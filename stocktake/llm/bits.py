"""Bit tables of fixed size over 64-bit hashes: a filter that never misses, whatever it is asked to hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mask:
    """Hashes by their first ``bits`` bits; a hash that was never put in may be found too."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def mask(df: DataFrame, hashes: Column, bits: int):
    """Broadcast mask of a column of hashes (long); 2**bits bits at any number of rows.

    The bits are combined on the executors; the driver gets one word for each 64 of them at most.
    """
    at = df.select(F.shiftrightunsigned(hashes, 64 - bits).alias("b"))
    rows = at.groupBy(F.shiftright("b", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b & 63 AS int)))").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["slot"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(Mask(words, bits))
