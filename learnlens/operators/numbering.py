"""Consecutive row numbers without a global window.

A plain `row_number()` over an unpartitioned window pulls every row into one task. Here splitters cut the order of the keys into intervals: the
`SPLITTERS` keys with the smallest hashes are a uniform sample of all keys, whatever their spread, found in one pass in which every task keeps
only so many. An interval is a block; block sizes are summed up in a window of at most that many rows, and rows are numbered inside their
block. Splitters are whole keys, so a course that owns a third of all rows is cut by its students. About one row in `SPLITTERS` falls
between two neighbours: blocks are even, up to the logarithm of their number.

Splitters and block offsets are scalar subqueries of the plan. So nothing runs while the plan is built, and numbering costs one shuffle of the
rows and three small exchanges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Orders of roster rows, unique per (student, course).
BY_COURSE_STUDENT = ("course_id", "student_id")
BY_STUDENT_COURSE = ("student_id", "course_id")
BY_STUDENT = ("student_id",)

SPLITTERS = 4096
_CUTS, _KEY, _BLOCK = "__cuts", "__key", "__block"


def splitters(rows: DataFrame, keys: Sequence[str], most: int = SPLITTERS, kept: str | None = None) -> Column:
    """Up to `most` - 1 keys of `rows`, in order, as a scalar array of structs.

    The smallest key of the sample is left out, so that no block is empty. `kept` names a column that the pass reads as well.
    """
    also = [kept] if kept else []
    sample = rows.select(F.struct(*keys).alias("key"), *also).orderBy(F.xxhash64(*keys), "key", *also).limit(most)
    return sample.agg(F.slice(F.array_sort(F.collect_list("key")), 2, most)).scalar()


def with_block(rows: DataFrame, keys: Sequence[str], cuts: Column, most: int = SPLITTERS) -> DataFrame:
    """Add `__block`: how many of the `cuts` are at or below the key, by binary search.

    Each step is a projection of its own. They all run in one generated loop, in which the array is a reference and never part of a row.
    """
    found = rows.withColumns({_CUTS: cuts, _KEY: F.struct(*keys), _BLOCK: F.lit(0)})
    for bit in reversed(range((most - 1).bit_length())):
        at = F.get(_CUTS, F.col(_BLOCK) + (2**bit - 1))  # null beyond the end
        found = found.withColumn(_BLOCK, F.col(_BLOCK) + F.when(at <= F.col(_KEY), 2**bit).otherwise(0))
    return found.select(*rows.columns, _BLOCK)


def number_rows(rows: DataFrame, keys: Sequence[str], name: str, *, counted: str | None = None, most: int = SPLITTERS) -> DataFrame:
    """Add `name`: 1, 2, ... in the order of `keys`, which are together unique.

    The rows are read three times: for the splitters, the block sizes and the numbers. So number a narrow frame and join values to it
    afterwards; or, if the rows come from a costly aggregate, name that aggregate in `counted` (it must never be null): all uses then share
    its shuffles. `most` bounds the number of blocks.
    """
    tagged = with_block(rows, keys, splitters(rows, keys, most, counted), most)
    sizes = tagged.groupBy(_BLOCK).agg(F.count(counted or F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(_BLOCK, before.alias("before")).agg(F.array_sort(F.collect_list(F.struct(_BLOCK, "before"))).alias("of")).select("of.before").scalar()
    inside = F.row_number().over(W.partitionBy(_BLOCK).orderBy(*keys))
    number = F.element_at(offsets, F.col(_BLOCK) + 1) + inside
    return tagged.withColumn(name, number.cast("long")).select(*rows.columns, name)


def number_within(rows: DataFrame, within: Sequence[str], key: str, name: str, *, total: str | None = None) -> DataFrame:
    """Add `name`: 1, 2, ... by `key`, again for each value of the `within` columns; `total` names an extra column with the group's row count.

    Rows are numbered in blocks of 65,536 neighbouring keys, and the sizes of a group's blocks are summed up, so that a hot group is spread.
    """
    block = _BLOCK
    tagged = rows.withColumn(block, F.shiftright(F.col(key).cast("long"), 16))
    group = W.partitionBy(*within)
    sizes = tagged.groupBy(*within, block).agg(F.count(F.lit(1)).alias("__size")).select(
        *within, block,
        F.coalesce(F.sum("__size").over(group.orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__size").over(group).alias("__total"),
    )
    numbered = tagged.withColumn("__inside", F.row_number().over(W.partitionBy(*within, block).orderBy(key))).join(sizes, [*within, block])
    added = {name: (F.col("__before") + F.col("__inside")).cast("long")}
    if total is not None:
        added[total] = F.col("__total")
    return numbered.withColumns(added).select(*rows.columns, *added)
