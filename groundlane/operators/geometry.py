"""Image geometry: resizing, tile grids, crops, patch counts, pixel normalisation. Sizes only; pixels are another program's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even

#: Channel means and deviations.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def target(w: Column, h: Column, base: int = 1024) -> Column:
    """The longest side aimed at: doubled for pages three or more times as long as wide, or the reverse."""
    return F.when(F.greatest(w / h, h / w) >= 3.0, F.lit(2 * base)).otherwise(F.lit(base))


def _resized(w: Column, h: Column, size: Column, first, grow, shrink, lo: int, hi: int) -> tuple[Column, Column]:
    ratio = size / F.greatest(w, h)
    a, b = (first(x * ratio) for x in (w, h))
    pixels = a * b
    down = F.when(pixels > hi, F.sqrt(F.lit(float(hi)) / pixels))
    a2, b2 = (F.when(down.isNotNull(), shrink(x * down)).otherwise(x) for x in (a, b))
    up = F.when(pixels < lo, F.sqrt(F.try_divide(F.lit(float(lo)), pixels)))  # a side of 0 gives null, not an error
    return tuple(F.when(pixels < lo, grow(x * up)).otherwise(x) for x in (a2, b2))


def resized_28(w: Column, h: Column, size: Column, lo: int = 3136, hi: int = 12_845_056) -> tuple[Column, Column]:
    """Sides that are multiples of 28: truncated, floored to 28, floored again under the upper pixel limit, raised to the lower one.
    Both limits look at the pixels of the first step. A side that floors to 0 gives null."""
    floor = lambda x: F.floor(x / 28) * 28
    out = _resized(w, h, size, lambda x: (F.floor(F.floor(x) / 28) * 28).cast("double"), lambda x: F.ceil(x / 28) * 28.0, lambda x: floor(x).cast("double"), lo, hi)
    return tuple(x.cast("bigint") for x in out)


def resized_free(w: Column, h: Column, size: Column, lo: int = 3136, hi: int = 12_845_056) -> tuple[Column, Column]:
    """Sides of any length, rounded half to even at the end."""
    same = lambda x: x
    return tuple(half_even(x) for x in _resized(w, h, size, lambda x: F.floor(x).cast("double"), same, same, lo, hi))


def grids(most: int = 12, least: int = 1) -> list[tuple[int, int]]:
    """Columns and rows of every grid with least to most tiles."""
    return [(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most]


def tile_grid(w: Column, h: Column, side: int = 448, most: int = 12) -> Column:
    """struct<cols, rows>: the grid whose shape is nearest to w / h; of equally near ones the larger if the image has more than half
    of its area, else the smaller. The grids are one constant array, so nothing is exploded or joined."""
    options = F.array(*[F.struct(F.lit(i).alias("cols"), F.lit(j).alias("rows")) for i, j in grids(most)])

    def key(g: Column) -> Column:
        tiles = g["cols"] * g["rows"]
        large = (w * h).cast("double") > 0.5 * side * side * tiles
        return F.struct(F.abs(w / h - g["cols"] / g["rows"]).alias("d"), F.when(large, -tiles).otherwise(tiles).alias("t"), g["cols"].alias("cols"), g["rows"].alias("rows"))

    best = F.array_min(F.transform(options, key))
    return F.struct(best["cols"].alias("cols"), best["rows"].alias("rows"))


def patch_count(tiles: Column) -> Column:
    """Tiles and, if there are several, a thumbnail."""
    return tiles + F.when(tiles != 1, 1).otherwise(0)


def crops(rows: DataFrame, grid: str = "grid", side: int = 448) -> DataFrame:
    """One row per tile: tile, x0, y0, x1, y1; a thumbnail of several tiles is the last one and has no place."""
    tiles = F.col(f"{grid}.cols") * F.col(f"{grid}.rows")
    out = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), patch_count(tiles) - 1)))
    inside = F.col("tile") < tiles
    x, y = (F.col("tile") % F.col(f"{grid}.cols")) * side, F.floor(F.col("tile") / F.col(f"{grid}.cols")).cast("int") * side
    return out.withColumns({n: F.when(inside, v) for n, v in (("x0", x), ("y0", y), ("x1", x + side), ("y1", y + side))})


def normalised(values: Column) -> Column:
    """(x / 255 - mean) / deviation of pixels whose channels alternate."""
    mean, std = F.array(*map(F.lit, MEAN)), F.array(*map(F.lit, STD))
    return F.transform(values, lambda x, i: (x.cast("double") / 255 - F.get(mean, i % 3)) / F.get(std, i % 3))
