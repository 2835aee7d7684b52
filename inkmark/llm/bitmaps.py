"""Bit maps of fixed size over residues of keys: they say where a later pass need not look, and never hide a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark's bit map functions work in words of this many bits.
_WORD = 32_768


def bitmap(df: DataFrame, residue: str, bits: int) -> np.ndarray:
    """Bytes of a map of ``bits`` bits (a power of two) in which the rows' residues are set; lowest bit first in a byte.

    The map has the same size whatever the number of rows, so it may be sent to every task.
    """
    place = F.col(residue) + 1
    words = df.groupBy(F.bitmap_bucket_number(place).alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set"))
    out = np.zeros(max(bits, _WORD) // 8, dtype=np.uint8)
    for row in words.collect():  # bits / 32768 rows of 4 KB at most
        first = (row["word"] - 1) * (_WORD // 8)
        out[first : first + len(row["set"])] = np.frombuffer(row["set"], dtype=np.uint8)
    return out


def is_set(bits: np.ndarray, residues: np.ndarray) -> np.ndarray:
    """Whether the residues of unsigned keys (by the map's number of bits) are set."""
    residues = residues & np.uint64(len(bits) * 8 - 1)
    return (bits[residues >> np.uint64(3)] >> (residues & np.uint64(7)).astype(np.uint8)) & 1 == 1
