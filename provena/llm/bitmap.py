"""Bitmaps over hashed keys: which rows of a wide table may have a key of a set, decided before anything is shuffled.

The set becomes a bitmap of ``BITS_A_KEY`` bits a key (a power of two, at most ``MOST_BITS``: 32 MB), held as one row for each 32768 bits,
which is broadcast. A row whose bit is not set surely has no key of the set; the others are checked exactly by the caller. Beyond
``MOST_BITS`` the bitmap fills up and lets more rows through, so plans get dearer but results stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.text import free_names
from provena.runtime import materialize

BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


class Bitmap:
    """A bitmap of the values of ``column`` in ``keys`` (null is a value)."""

    def __init__(self, keys: DataFrame, column: str):
        wanted = BITS_A_KEY * max(1, keys.count())
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
        place = self._place(F.col(column))
        rows = keys.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
        self.rows = materialize(rows, "bitmap")

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(15), key), F.lit(self.bits)).cast("long")

    def mark(self, rows: DataFrame, key: Column, flag: str) -> DataFrame:
        """``rows`` with the boolean column ``flag``: whether the set may hold the row's key."""
        part, bits, place = free_names([*rows.columns, flag], "part", "bits", "place")
        other = F.broadcast(self.rows.select(F.col("part").alias(part), F.col("bits").alias(bits)))
        placed = rows.withColumn(place, self._place(key))
        at = F.col(place)
        byte = F.substring(F.col(bits), (F.shiftright(at.bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), at.bitwiseAND(F.lit(7)).cast("int"))
        joined = placed.join(other, F.shiftright(at, 15) == F.col(part), "left")
        return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(part, bits, place)
