"""Sets of 64-bit keys as bitmaps that every task can hold.

A key sets one bit, so a bitmap may say yes to keys that are not in the set, never no to one that
is. Its size follows the number of keys up to ``MOST_BITS``; beyond that it only says yes more often.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 29
# Bits a key: one in so many other keys gets a yes.
ROOM = 16
_BUCKET = 8 * 4096


def slots(keys: np.ndarray, bits: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """The bit of each key. Keys that carry a salt from 0 to 7 share the bitmap."""
    salt = np.asarray(salt, np.uint64) << np.uint64(bits - 3)
    return (keys ^ salt) & np.uint64((1 << bits) - 1)


def _slot(key: Column, bits: int, salt: Column | None) -> Column:
    salted = key if salt is None else key.bitwiseXOR(F.shiftleft(salt.cast("bigint"), bits - 3))
    return salted.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap_of(keys: DataFrame, key: str = "key", salt: str | None = None) -> Broadcast:
    """The bitmap of a column of whole numbers, sent to all tasks. ``keys`` is read twice."""
    n = keys.count()
    bits = min(max(LEAST_BITS, (ROOM * n).bit_length()), MOST_BITS)
    slot = _slot(F.col(key), bits, F.col(salt) if salt else None) + 1
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    )
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row.bucket - 1) * (_BUCKET // 8)
        bitmap[at : at + _BUCKET // 8] = np.frombuffer(row.bitmap, np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, bitmap))


def contains(bitmap: tuple[int, np.ndarray], keys: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Whether each key may be in the set."""
    bits, held = bitmap
    at = slots(keys, bits, salt)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
