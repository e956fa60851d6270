"""Regions of pictures as runs of pixels: labelling, closing of gaps, and the document's place in a frame.

A run is (image_id, y, a, b): neighbouring pixels of a row, from column a to b. Most work on regions needs runs only, of which a picture has far fewer
than pixels. Regions are found inside a picture, whose size bounds a task; pictures are spread by their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from passplane.operators.measures import lines

# The side of the closing; a document's least and greatest share of the frame, and how much of its rectangle it fills.
CLOSING, LEAST, MOST, FILLED = 25, 0.20, 0.95, 0.75


def sides(pixels: DataFrame) -> DataFrame:
    """(image_id, height, width), by one pre-aggregated count a picture."""
    if {"height", "width"} <= set(pixels.columns):
        return pixels.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def runs(pixels: DataFrame, *keep: Column) -> DataFrame:
    """(image_id, y, a, b, keep) of the given pixels (image_id, y, x): aggregates over each run are kept."""
    along = Window.partitionBy("image_id", "y").orderBy("x")
    island = F.col("x") - F.row_number().over(along)
    return pixels.withColumn("_island", island).groupBy("image_id", "y", "_island").agg(F.min("x").alias("a"), F.max("x").alias("b"), *keep).drop("_island")


def joined(found: DataFrame) -> DataFrame:
    """(image_id, y, a, b): runs that touch or overlap in a row made one."""
    along = Window.partitionBy("image_id", "y").orderBy("a", "b")
    before = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("_new", F.when(F.col("a") <= before + 1, 0).otherwise(1))
    return new.withColumn("_island", F.sum("_new").over(along)).groupBy("image_id", "y", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def touching(y: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that touch, as their numbers; see `labels_of`."""
    wide = int(b.max()) + 3 if len(b) else 1
    low = np.searchsorted(y * wide + b, (y + 1) * wide + a - reach)
    high = np.maximum(low, np.searchsorted(y * wide + a, (y + 1) * wide + b + reach, side="right"))
    count = high - low
    return np.repeat(np.arange(len(y)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def labels_of(y: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """The first run of each run's region. Runs are in order of (y, a) and apart within a row; they touch those of the next row that begin
    at most reach places after them and end at most as many before."""
    upper, lower = touching(y, a, b, reach)
    label = np.arange(len(y))
    while True:
        before = label.copy()
        least = np.minimum(label[upper], label[lower])
        # roots of touching regions take the least of both, and every run takes its root's
        np.minimum.at(label, before[upper], least)
        np.minimum.at(label, before[lower], least)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def labelled(found: DataFrame, reach: int = 1) -> DataFrame:
    """Adds label, the number of the first run of the region, to runs. reach: 1 if corners touch, 0 if only sides do."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("a", "ascending")])
        own = [np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("y", "a", "b")]
        return table.append_column("label", pa.array(labels_of(*own, reach), pa.int64()))

    return found.groupBy("image_id").applyInArrow(run, StructType([*found.schema.fields, StructField("label", LongType())]))


def otsu(pixels: DataFrame, value: str) -> DataFrame:
    """(image_id, threshold): the value that parts a picture's histogram best, the first of equals."""
    upto, every = Window.partitionBy("image_id").orderBy(value), Window.partitionBy("image_id")
    c = F.col
    rows = pixels.groupBy("image_id", value).agg(F.count("*").alias("n"))
    rows = rows.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(c("n") * c(value)).over(upto), "all": F.sum("n").over(every), "sum": F.sum(c("n") * c(value)).over(every)})
    # whole numbers up to the last division
    apart = (c("sum") * c("n0") - c("s0") * c("all")).cast("double") / c("all")
    between = F.when(c("n0") < c("all"), apart * apart / (c("n0").cast("double") * (c("all") - c("n0")))).otherwise(0.0)
    return rows.groupBy("image_id").agg(F.min(F.struct((-between).alias("by"), c(value).alias("threshold"))).alias("x")).select("image_id", "x.threshold")


def slid(flags: DataFrame, size: int, along: str, least: bool) -> DataFrame:
    """The least (or greatest) flag `v` (0 or 1) of size places around each, along "x" or "y", cut at the picture's sides.

    The number of ones around a place is the difference of two running sums, so a place costs the same for any size."""
    row, column = lines(["image_id"])
    line, half, at = (row if along == "x" else column), size // 2, F.col(along)
    whole = Window.partitionBy("image_id", "y" if along == "x" else "x")
    n = F.col("width" if along == "x" else "height")
    summed = flags.withColumns({"_sum": F.sum("v").over(line.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("v").over(whole)})
    ones = F.coalesce(F.lead("_sum", half).over(line), F.col("_all")) - F.coalesce(F.lag("_sum", half + 1).over(line), F.lit(0))
    places = F.least(at + half, n - 1) - F.greatest(at - half, F.lit(0)) + 1
    value = F.when(ones == places, 1).otherwise(0) if least else F.when(ones > 0, 1).otherwise(0)
    return summed.withColumn("v", value).drop("_sum", "_all")


def closed(flags: DataFrame, size: int = CLOSING) -> DataFrame:
    """Flags (image_id, y, x, v, height, width) with gaps narrower than size closed: the greatest around each place, then the least."""
    for along, least in (("x", False), ("y", False), ("y", True), ("x", True)):
        flags = slid(flags, size, along, least)
    return flags


def filled(flags: DataFrame) -> DataFrame:
    """(image_id, y, a, b): the runs of ones and of holes, which are zeros that do not reach the picture's sides (corners let nothing through)."""
    at_side = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == 0) | (F.col("x") == F.col("width") - 1)
    empty = labelled(runs(flags.where("v = 0").withColumn("side", at_side), F.max("side").alias("side")), reach=0)
    open_ = F.max("side").over(Window.partitionBy("image_id", "label"))
    holes = empty.withColumn("open", open_).where("not open").select("image_id", "y", "a", "b")
    return joined(runs(flags.where("v = 1")).unionByName(holes))


def shapes(found: DataFrame) -> DataFrame:
    """(image_id, label, x, y, w, h, area) of each region of filled runs: its rectangle, and the area inside the line through its outer
    pixels' centres: between neighbouring rows, the common stretch of two runs and half a place at each end that differs."""
    rows = labelled(found)
    next_row = rows.select("image_id", "label", (F.col("y") - 1).alias("y"), F.col("a").alias("c"), F.col("b").alias("d"))
    common = F.least("b", "d") - F.greatest("a", "c")
    between = rows.join(next_row, ["image_id", "label", "y"]).where(common >= 0)
    halves = common * 2 + (F.col("a") != F.col("c")).cast("int") + (F.col("b") != F.col("d")).cast("int")
    areas = between.groupBy("image_id", "label").agg((F.sum(halves) / 2).alias("area"))
    boxes = rows.groupBy("image_id", "label").agg(F.min("a").alias("x"), F.min("y").alias("y"), (F.max("b") - F.min("a") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return boxes.join(areas, ["image_id", "label"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def matrix(table: pa.Table, value: str) -> tuple[np.ndarray, int, int]:
    """A whole picture's values by row and column, and the first row's and column's number."""
    y, x, v = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("y", "x", value))
    top, left = int(y.min()), int(x.min())
    picture = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), np.int64)
    picture[y - top, x - left] = v
    return picture, top, left


def softened(values: np.ndarray, taps: tuple[int, ...] = (1, 2, 1)) -> np.ndarray:
    """`measures.blurred` of a picture held whole: sides are mirrored without the last place."""
    (high, wide), v = values.shape, np.pad(values, len(taps) // 2, mode="reflect")
    across = sum(t * v[:, k : k + wide] for k, t in enumerate(taps))
    down, n = sum(t * across[k : k + high] for k, t in enumerate(taps)), sum(taps) ** 2
    return (2 * down + n) // (2 * n)


def best_part(values: np.ndarray) -> int:
    """`otsu` of a picture held whole."""
    n = np.bincount(values.ravel())
    t = np.flatnonzero(n)
    n = n[t]
    n0, s0, all_, total = np.cumsum(n), np.cumsum(n * t), n.sum(), (n * t).sum()
    apart = (total * n0 - s0 * all_) / all_
    return int(t[np.argmax(np.where(n0 < all_, apart * apart / (n0 * np.maximum(all_ - n0, 1)), 0.0))])


def closed_whole(flags: np.ndarray, size: int = CLOSING) -> np.ndarray:
    """`closed` of a picture held whole."""
    half = size // 2
    for axis, least in ((1, False), (0, False), (0, True), (1, True)):
        flags = np.moveaxis(flags, axis, 0)
        at = np.arange(len(flags))
        first, last = np.maximum(at - half, 0), np.minimum(at + half, len(flags) - 1) + 1
        sums = np.concatenate([np.zeros((1, flags.shape[1]), np.int64), np.cumsum(flags, axis=0)])
        ones = sums[last] - sums[first]
        flags = np.moveaxis(ones == (last - first)[:, None] if least else ones > 0, 0, axis)
    return flags


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of ones of a picture held whole, in order."""
    step = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(step == 1)
    return y, a, np.nonzero(step == -1)[1] - 1


def without_holes(flags: np.ndarray) -> np.ndarray:
    """Flags with the zeros that do not reach the picture's sides made ones (corners let nothing through)."""
    (high, wide), (y, a, b) = flags.shape, spans(~flags)
    label, open_ = labels_of(y, a, b, 0), np.zeros(len(y), bool)
    np.logical_or.at(open_, label, (y == 0) | (y == high - 1) | (a == 0) | (b == wide - 1))
    out = flags.copy()
    for k in np.flatnonzero(~open_[label]).tolist():
        out[y[k], a[k] : b[k] + 1] = True
    return out


def light_runs(pixels: DataFrame) -> DataFrame:
    """(image_id, label, y, a, b, halves, height, width) of whole grey pictures: the runs of their light regions, blurred, parted, closed and without holes; halves: twice the area between
    a run and those below it, as in `shapes`. A picture without one has a row of nulls. A picture is one matrix in its task, so a pixel is sorted once, by picture."""

    def run(table: pa.Table) -> pa.Table:
        picture, top, left = matrix(table, "g")
        soft = softened(picture, (1, 4, 6, 4, 1))
        y, a, b = spans(without_holes(closed_whole(soft > best_part(soft))))
        upper, lower = touching(y, a, b, 0)
        common = np.minimum(b[upper], b[lower]) - np.maximum(a[upper], a[lower])
        halves = np.bincount(upper, common * 2 + (a[upper] != a[lower]) + (b[upper] != b[lower]), len(y)).astype(np.int64)
        columns = {"label": labels_of(y, a, b, 1), "y": y + top, "a": a + left, "b": b + left, "halves": halves} if len(y) else dict.fromkeys(("label", "y", "a", "b", "halves"), [None])
        n = max(len(y), 1)
        columns |= {"height": np.full(n, top + picture.shape[0]), "width": np.full(n, left + picture.shape[1])}
        return pa.table({"image_id": pa.repeat(table["image_id"][0], n), **{n: pa.array(c, pa.int64()) for n, c in columns.items()}})

    out = StructType([pixels.schema["image_id"], *[StructField(n, LongType()) for n in ("label", "y", "a", "b", "halves", "height", "width")]])
    return pixels.select("image_id", "y", "x", "g").groupBy("image_id").applyInArrow(run, out)


def document(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, w, h) of grey pictures (image_id, y, x, g): the largest light region, if it is a credible document, else nulls.

    Blurred, parted at its best threshold, gaps closed; of equal regions the first from above. A region nearer to a side of the picture than
    half the closing is closed up to it. A picture without a region has nulls."""
    size = [F.max(c).alias(c) for c in ("height", "width")]
    boxes = light_runs(pixels).groupBy("image_id", "label").agg(F.min("a").alias("x"), F.min("y").alias("y"), (F.max("b") - F.min("a") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), (F.sum("halves") / 2).alias("area"), *size)
    best = boxes.groupBy("image_id").agg(F.min(F.struct((-F.col("area")).alias("by"), "label", "x", "y", "w", "h")).alias("s"), *size)
    rect = (F.col("s.w") * F.col("s.h")).cast("double")
    share = rect / (F.col("height") * F.col("width"))
    sure = (F.col("s.by") < 0) & share.between(LEAST, MOST) & (-F.col("s.by") / rect >= FILLED)
    return best.select("image_id", *[F.when(sure, F.col(f"s.{c}")).cast("int").alias(c) for c in "xywh"])
