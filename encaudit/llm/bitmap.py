"""A bitmap of fixed size over a column of hashes, to drop most rows before a shuffle.

It only ever lets too much through, so an exact join follows. Its size does not
grow with the data: beyond its capacity it drops less, and stays right.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bitmap(rows: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a long column; the driver receives at most ``bits / 64`` rows."""
    slot = F.pmod(F.col(column), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = (
        rows.select(slot.alias("slot"))
        .select(F.floor(F.col("slot") / 64).alias("word"), one.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("held"))
    )
    table = words.toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[table.column("word").to_numpy()] = table.column("held").to_numpy().view(np.uint64)
    return held


def may_hold(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value (as a signed long) whether the bitmap may hold it."""
    slot = np.mod(values, len(held) * 64).astype(np.uint64)
    return (held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
