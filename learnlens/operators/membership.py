"""A bitmap of keys as a scalar of the plan, so that rows without a partner go where they are read, before any shuffle.

Where few rows of a large table have a partner and the partners' side is too large to broadcast, a join shuffles the whole table to find that out. Here
each key of the smaller side sets one of `BITS` bits, by hash. The bitmap (512 kB, whatever the number of keys) is a scalar subquery, and a
filter above the scan tests each row's bit. Rows whose bit is set by another key pass as well, about n / BITS of them for n keys: the
join that follows is exact. `MANY` bits (4 MB) are for rows too wide to be shuffled in vain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22
MANY = 1 << 25


def _bit(columns: Sequence[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def key_bitmap(rows: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The bits of the keys of `rows` as a scalar, an array of 64-bit words."""
    bit = _bit([F.col(c) for c in columns], bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    found = rows.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), one.alias("bits"))
    every = rows.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = found.unionAll(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("of")).select("of.bits").scalar()


def may_hold(bitmap: Column, columns: Sequence[str], bits: int = BITS) -> Column:
    """False for rows whose key is surely not in the bitmap; null keys are."""
    bit = _bit([F.col(c) for c in columns], bits)
    word = F.element_at(bitmap, F.shiftright(bit, 6).cast("int") + 1)
    return F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1
