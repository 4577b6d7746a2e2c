"""The Hilbert curve over a square grid of ``2**order`` cells a side, as column expressions.

``hilbert_index`` and ``hilbert_cell`` are inverse to each other; neighbouring indexes are neighbouring cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orientation (four of them) and quadrant (2 * x bit + y bit) give the curve's digit and the next orientation.
_DIGIT = (0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0)
_TURN = (1, 0, 3, 0, 0, 2, 1, 1, 2, 1, 2, 3, 3, 3, 0, 2)
WORLD = (-180.0, -90.0, 180.0, 90.0)


def grid_position(value: Column, low: float, high: float, order: int) -> Column:
    """Cell number along one axis; values beyond the ends go to the edge cells."""
    side = 1 << order
    return F.least(F.greatest(F.floor((value.cast("double") - F.lit(low)) / F.lit(high - low) * side), F.lit(0)), F.lit(side - 1)).cast("long")


def hilbert_index(cx: Column, cy: Column, order: int) -> Column:
    """Place of a cell along the curve.

    A fold over the bits from the top; each step carries one state out of four (the curve's orientation) and looks the next
    quadrant up, so the expression grows neither with data nor with nesting.
    """
    digit, turn = F.array(*map(F.lit, _DIGIT)), F.array(*map(F.lit, _TURN))
    start = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).alias("s"))

    def step(acc: Column, bit: Column) -> Column:
        q = acc["s"] * 4 + F.getbit(cx, bit).cast("int") * 2 + F.getbit(cy, bit).cast("int")
        return F.struct((acc["d"] * 4 + F.get(digit, q)).alias("d"), F.get(turn, q).alias("s"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(order - 1, -1, -1))), start, step, lambda acc: acc["d"])


def hilbert_cell(index: Column, order: int) -> Column:
    """``struct<cx:bigint,cy:bigint>`` of a place along the curve."""
    back = [_DIGIT.index(d, 4 * s, 4 * s + 4) for s in range(4) for d in range(4)]
    quadrant, turn = F.array(*(F.lit(q % 4) for q in back)), F.array(*(F.lit(_TURN[q]) for q in back))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("cx"), zero.alias("cy"), F.lit(0).alias("s"))

    def step(acc: Column, level: Column) -> Column:
        q = acc["s"] * 4 + F.getbit(index, level * 2 + 1).cast("int") * 2 + F.getbit(index, level * 2).cast("int")
        quad = F.get(quadrant, q)
        return F.struct((acc["cx"] * 2 + F.floor(quad / 2)).alias("cx"), (acc["cy"] * 2 + quad % 2).alias("cy"), F.get(turn, q).alias("s"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(order - 1, -1, -1))), start, step, lambda acc: F.struct(acc["cx"].alias("cx"), acc["cy"].alias("cy")))


def hilbert_of_place(x: Column, y: Column, order: int, extent: tuple[float, float, float, float] = WORLD) -> Column:
    return hilbert_index(grid_position(x, extent[0], extent[2], order), grid_position(y, extent[1], extent[3], order), order)


def hilbert_ranges(cx1: int, cy1: int, cx2: int, cy2: int, order: int) -> list[tuple[int, int]]:
    """Ascending, disjoint index ranges (inclusive) that hold exactly the cells of a cell rectangle. Runs on the driver."""
    found: list[tuple[int, int]] = []

    def visit(x: int, y: int, level: int, state: int, base: int) -> None:
        side = 1 << level
        if x > cx2 or y > cy2 or x + side - 1 < cx1 or y + side - 1 < cy1:
            return
        if cx1 <= x and cy1 <= y and x + side - 1 <= cx2 and y + side - 1 <= cy2:
            found.append((base, base + (1 << (2 * level)) - 1))
            return
        half = side >> 1
        for q in range(4):
            at = state * 4 + q
            visit(x + half * (q >> 1), y + half * (q & 1), level - 1, _TURN[at], base + (_DIGIT[at] << (2 * (level - 1))))

    if cx1 <= cx2 and cy1 <= cy2:
        visit(0, 0, order, 0, 0)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and merged[-1][1] + 1 == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged
