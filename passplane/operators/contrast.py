"""Pictures made comparable: local contrast by tile histograms, and another size by the overlap of pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from passplane.operators.regions import matrix, sides

# Tiles in each direction, and how many times the mean a grey value's count may be.
TILES, CLIP = 8, 2.0


def tile_side(height: int, width: int, tiles: int = TILES) -> tuple[int, int]:
    """The height and width of a tile. A picture that tiles do not divide in both directions is taken as padded in both, by one tile's count at most, with what lies before
    its end, mirrored."""
    if height % tiles == 0 and width % tiles == 0:
        return height // tiles, width // tiles
    return (height + tiles - height % tiles) // tiles, (width + tiles - width % tiles) // tiles


def tile_tables(values: np.ndarray, tiles: int = TILES, clip: float = CLIP) -> np.ndarray:
    """(tile row, tile column, grey value): the new value of every grey value in each tile of a picture.

    Counts over the limit are cut; what is cut is dealt to all 256 values alike, and the rest to evenly spaced ones. The new value is the running sum's
    share of 255."""
    sides = tile_side(*values.shape, tiles)

    # a mirrored place counts with each tile that it is padded to
    def dealt(n: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n)
        other = 2 * (n - 1) - at
        again = (other >= n) & (other < side * tiles)
        return np.append(at, at[again]), np.append(at, other[again]) // side

    (rows, ty), (columns, tx) = (dealt(n, side) for n, side in zip(values.shape, sides, strict=True))
    cells = (ty[:, None] * tiles + tx) * 256 + values[np.ix_(rows, columns)]
    counts = np.bincount(cells.ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256)
    size = sides[0] * sides[1]
    limit = max(int(size * clip / 256), 1)
    over = np.maximum(counts - limit, 0).sum(axis=2, keepdims=True)
    rest, v = over % 256, np.arange(256)
    step = 256 // np.maximum(rest, 1)
    held = np.minimum(counts, limit) + over // 256 + ((rest > 0) & (v % step == 0) & (v // step < rest))
    return np.minimum(np.floor(np.cumsum(held, axis=2) * (255.0 / size) + 0.5), 255).astype(np.int64)


def equalised(pixels: DataFrame, tiles: int = TILES, clip: float = CLIP) -> DataFrame:
    """(image_id, y, x, g): grey pictures with the contrast of each part made alike: a pixel's new value lies between those of the four nearest tiles, by its
    distance from their middles. Pictures are spread by their id, each is one matrix in its task."""

    def near(n: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / side - 0.5
        first = np.floor(at).astype(np.int64)
        return np.clip(first, 0, tiles - 1), np.clip(first + 1, 0, tiles - 1), at - first

    def run(table: pa.Table) -> pa.Table:
        g, top, left = matrix(table, "g")
        tables = tile_tables(g, tiles, clip)
        (y0, y1, fy), (x0, x1, fx) = (near(n, side) for n, side in zip(g.shape, tile_side(*g.shape, tiles), strict=True))
        value, fy = (lambda y, x: tables[y[:, None], x, g]), fy[:, None]
        mixed = (value(y0, x0) * (1 - fx) + value(y0, x1) * fx) * (1 - fy) + (value(y1, x0) * (1 - fx) + value(y1, x1) * fx) * fy
        y, x = np.indices(g.shape).reshape(2, -1)
        columns = {"y": y + top, "x": x + left, "g": np.floor(mixed + 0.5).astype(np.int64).ravel()}
        return pa.table({"image_id": pa.repeat(table["image_id"][0], g.size), **{n: pa.array(c, pa.int32()) for n, c in columns.items()}})

    out = StructType([pixels.schema["image_id"], *[StructField(n, IntegerType()) for n in ("y", "x", "g")]])
    return pixels.select("image_id", "y", "x", "g").groupBy("image_id").applyInArrow(run, out)


def resized(pixels: DataFrame, width: int, height: int, channels: list[str]) -> DataFrame:
    """(image_id, y, x, channels): pictures of another size. A new pixel is the mean of the old ones that it covers, by how much of each.

    In places of 1 / (old times new) a pixel covers whole numbers: old ones `new` places each, new ones `old`. So overlaps and sums are
    whole numbers, first along rows, then along columns; each old pixel meets only the new ones that it overlaps."""
    rows = pixels.join(sides(pixels), "image_id")

    def spread(rows: DataFrame, at: str, old: str, new: int, keys: list[str]) -> DataFrame:
        first, last = F.floor(F.col(at) * new / F.col(old)).cast("int"), (F.ceil((F.col(at) + 1) * new / F.col(old)) - 1).cast("int")
        rows = rows.withColumn("to", F.explode(F.sequence(first, last)))
        part = F.least((F.col(at) + 1) * new, (F.col("to") + 1) * F.col(old)) - F.greatest(F.col(at) * new, F.col("to") * F.col(old))
        return rows.groupBy(*keys, "height", "width", F.col("to").alias("_new")).agg(*[F.sum(F.col(c) * part).alias(c) for c in channels]).drop(at).withColumnRenamed("_new", at)

    across = spread(rows, "x", "width", width, ["image_id", "y"])
    whole = spread(across, "y", "height", height, ["image_id", "x"])
    area = F.col("height").cast("long") * F.col("width")
    return whole.select("image_id", "y", "x", *[F.floor((F.col(c) * 2 + area) / (area * 2)).cast("int").alias(c) for c in channels])
