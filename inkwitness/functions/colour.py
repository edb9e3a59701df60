"""Column functions over colours and font flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def decode_color(packed: Column) -> Column:
    """0xRRGGBB -> (r, g, b)."""
    return _rgb(*[F.shiftright(packed, shift).bitwiseAND(F.lit(255)) for shift in (16, 8, 0)])


def normalise_color(parts: Column) -> Column:
    """Array of 0..1 components -> (r, g, b); one value is grey, null or two values are black."""
    level = lambda i: F.get(parts, F.lit(i)) * 255
    size = F.size(parts)
    return (
        F.when(size >= 3, _rgb(level(0), level(1), level(2)))
        .when(size == 1, _rgb(level(0), level(0), level(0)))
        .otherwise(_rgb(F.lit(0), F.lit(0), F.lit(0)))
    )


def is_bold(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(16)) != 0


def is_italic(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(2)) != 0


def rgb_distance(color: Column, background: tuple[int, int, int]) -> Column:
    """Euclidean distance in the 0..255 cube."""
    squares = [(color[c] - F.lit(v)) * (color[c] - F.lit(v)) for c, v in zip("rgb", background)]
    return F.sqrt((squares[0] + squares[1] + squares[2]).cast("double"))
