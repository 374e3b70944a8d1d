"""Numbers that lie in ranges, met by equality.

A range is cut into aligned blocks of 16 ** k numbers, the largest that fit: at most 30 of each
size, so a range of any width gives a few hundred rows at most and most give a handful. A
number lies in one block of each size, so both sides meet by size and block alone: each pair that
belongs together meets exactly once, and no pair that doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of blocks: 16 ** 0 to 16 ** 12; numbers are below 2 ** 56.
BITS, SIZES = 4, 13


def blocks(low: Column, high: Column) -> Column:
    """Array of (size, block) that together hold low to high, both included; empty if high < low or one is null."""
    begin, end = low.cast("long"), high.cast("long") + 1
    up = lambda x, k: F.shiftright(x + ((1 << BITS * k) - 1), BITS * k)
    down = lambda x, k: F.shiftright(x, BITS * k)
    made = []
    for k in range(SIZES):
        a, b = up(begin, k), down(end, k)
        inner_a, inner_b = up(begin, k + 1) * (1 << BITS), down(end, k + 1) * (1 << BITS)
        whole = inner_a < inner_b if k + 1 < SIZES else F.lit(False)
        span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>"))
        own = F.when(whole, F.concat(span(a, inner_a), span(inner_b, b))).otherwise(span(a, b))
        made.append(F.transform(F.coalesce(own, F.array().cast("array<long>")), lambda x: F.struct(F.lit(k).alias("size"), x.alias("block"))))
    return F.flatten(F.array(*made))


def in_ranges(points: DataFrame, ranges: DataFrame, by: str, at: str, low: str, high: str) -> DataFrame:
    """Rows of points joined to the rows of ranges with the same `by` whose low to high holds `at`."""
    cut = ranges.select("*", F.inline(blocks(F.col(low), F.col(high))))
    sizes = sorted(r[0] for r in cut.select("size").distinct().collect())  # as many as there are sizes
    spread = points.select("*", F.explode(F.array(*(F.lit(k) for k in sizes)).cast("array<int>")).alias("size")).withColumn("block", F.expr(f"shiftright(CAST({at} AS BIGINT), {BITS} * size)"))
    return spread.join(cut, [by, "size", "block"]).drop("size", "block")
