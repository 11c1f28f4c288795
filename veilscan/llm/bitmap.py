"""A bitmap of hash values, of fixed size: rows whose bit is not set surely have no partner.

Whole texts then need not be shuffled to a join that few of them meet. At most
2**BITS bits (8 MB) are broadcast, whatever the number of rows; a full bitmap
lets every row through to the join, so only time depends on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

BITS = 26
_PIECE = 15  # bits of the place inside one piece, as in bitmap_construct_agg


class Bitmap:
    def __init__(self, store: Store, values: DataFrame, column: str):
        """Of the low ``BITS`` bits of a long column."""
        at = values.select(F.col(column).bitwiseAND((1 << BITS) - 1).alias("at"))
        self.pieces = store.save(at.groupBy(F.shiftright("at", _PIECE).alias("piece")).agg(
            F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << _PIECE) - 1)).alias("bits")), "bitmap")

    def mark(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the bit of ``value`` is set; null is not."""
        at = value.bitwiseAND((1 << BITS) - 1)
        pieces = self.pieces.select(F.col("piece").alias(f"{name}_piece"), F.col("bits").alias(f"{name}_bits"))
        out = df.withColumn(f"{name}_at", at).join(F.broadcast(pieces), F.shiftright(f"{name}_at", _PIECE) == F.col(f"{name}_piece"), "left")
        byte = f"conv(hex(substring({name}_bits, cast(shiftright({name}_at & {(1 << _PIECE) - 1}, 3) AS int) + 1, 1)), 16, 10)"
        bit = F.expr(f"coalesce(shiftright(cast({byte} AS int), cast({name}_at & 7 AS int)) & 1, 0) = 1")
        return out.withColumn(name, bit).drop(f"{name}_at", f"{name}_piece", f"{name}_bits")

    def as_array(self) -> np.ndarray:
        """All bits, eight to a byte, for tests inside tasks."""
        out = np.zeros(1 << (BITS - 3), np.uint8)
        size = 1 << (_PIECE - 3)
        for r in self.pieces.collect():
            bits = np.frombuffer(r["bits"], np.uint8)
            out[r["piece"] * size:r["piece"] * size + len(bits)] = bits
        return out


def is_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
