"""Grid cells by repeated halving of longitude and latitude, written in base 32.

Both axes are halved in turn, longitude first, and a value on a boundary belongs to the lower half.
Halving -180..180 (or -90..90) k times gives boundaries that are exact doubles for every k used here,
so the cell number has a closed form and needs no loop: guess it by division, then correct the guess by
one cell against the exact boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols by code, and the default code length.  The list has 33 symbols; a 5-bit code
# never reaches the last one.
SYMBOLS = "0123456789BCDEFGHJKLMNPQRSTUVWXYZ"
PRECISION = 15


def axis_bits(precision: int) -> tuple[int, int]:
    """Number of longitude and latitude halvings in a code of ``precision`` symbols."""
    total = 5 * precision
    return (total + 1) // 2, total // 2


def cell_number(x: Column, half_span: float, bits: int) -> Column:
    """Cell of x on an axis -half_span..half_span halved ``bits`` times."""
    span, cells = 2.0 * half_span, 1 << bits

    def boundary(k: Column) -> Column:
        return k.cast("double") * F.lit(span) / F.lit(float(cells)) - F.lit(half_span)

    guess = F.floor((x + F.lit(half_span)) * F.lit(float(cells)) / F.lit(span)).cast("bigint")
    down = guess - F.when(x <= boundary(guess), 1).otherwise(0)
    up = down + F.when(x > boundary(down + 1), 1).otherwise(0)
    return F.least(F.greatest(up, F.lit(0)), F.lit(cells - 1)).cast("bigint")


def cell_code(lng_cell: Column, lat_cell: Column, precision: int = PRECISION) -> Column:
    """Base-32 text of a cell."""
    n_lng, n_lat = axis_bits(precision)

    def bit(p: int) -> Column:
        cell, bits = (lng_cell, n_lng) if p % 2 == 0 else (lat_cell, n_lat)
        return F.shiftright(cell, bits - 1 - p // 2).bitwiseAND(F.lit(1))

    symbols = []
    for c in range(precision):
        code = sum((bit(5 * c + j) * (16 >> j) for j in range(5)), F.lit(0))
        symbols.append(F.substring(F.lit(SYMBOLS), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*symbols)


def cell_centre(cell: Column, half_span: float, bits: int) -> Column:
    """Middle of a cell, cut toward zero to the digits that the cell's size supports."""
    import math

    step = 2.0 * half_span / (1 << bits)
    digits = max(1, math.floor(-math.log10(half_span / (1 << bits)) + 0.5)) - 1
    base = F.lit(float(10.0 ** -digits))
    mid = (cell.cast("double") + F.lit(0.5)) * F.lit(step) - F.lit(half_span)
    return mid - mid % base
