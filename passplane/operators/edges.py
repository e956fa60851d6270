"""Edges and lines of pictures: thinned gradients, hysteresis over runs, edge densities, and lines by votes.

An edge is a pixel whose gradient (3 by 3 differences, the sum of both directions' sizes, the picture's border repeated) is over the low
threshold and the greatest across its direction, in a region of such pixels that touch each other and of which one is over the high
threshold. The direction is one of four, parted at 22.5 and 67.5 degrees. Gradients, regions and votes are found inside a picture, whose size bounds a task; pictures are
spread by their id, and what follows from runs and lines is aggregates and joins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from passplane.operators import signals
from passplane.operators.contrast import resized
from passplane.operators.measures import grey, margin, portrait_features, whole
from passplane.operators.regions import labels_of, matrix, sides, softened

# Thresholds of edges around a face and along lines, and in the margins; the margins' share; the band around a face; least votes, length
# and greatest gap of a line.
AROUND, MARGINS, MARGIN, BAND = (60, 160), (50, 150), 0.08, 0.22
VOTES, LENGTH, GAP = 100, 180, 15
# Fixed value: the tangent of 22.5 degrees as a whole number of 2^-15.
TANGENT = 13573
#: Cosines and sines of whole degrees as both engines read them.
COSINE, SINE = ([round(f(math.radians(k)), 9) for k in range(180)] for f in (math.cos, math.sin))


def thinned(values: np.ndarray, low: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a picture's grey values the gradients' sizes, and which are over low and the greatest across their direction. seen: which rows are there; gradients go
    from one to the next, and are 0 in others."""
    v = np.pad(values[seen], 1, mode="edge")
    d, s = v[:, 2:] - v[:, :-2], v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
    gx, gy = np.zeros_like(values), np.zeros_like(values)
    gx[seen], gy[seen] = d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]
    ax, ay = np.abs(gx), np.abs(gy)
    m = ax + ay
    around = np.pad(m, 1)
    # outside the picture sizes are 0
    at = lambda dy, dx: around[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    flat, steep, falling = (ay << 15) < ax * TANGENT, (ay << 15) > ax * (TANGENT + (1 << 16)), (gx < 0) != (gy < 0)
    greatest = np.where(
        flat, (m > at(0, -1)) & (m >= at(0, 1)),
        np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(falling, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))),
    )
    return m, (m > low) & greatest


def edge_runs(values: np.ndarray, low: int, high: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of a picture's edges, in order."""
    m, found = thinned(values, low, seen)
    y, x = np.nonzero(found)
    first = np.ones(len(y), bool)
    first[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    at = np.flatnonzero(first)
    if not len(at):
        return y, x, x
    last = np.append(at[1:], len(y)) - 1
    strong = np.maximum.reduceat(m[y, x] > high, at)
    label = labels_of(y[at], x[at], x[last], 1)
    kept = np.zeros(len(at), bool)
    np.logical_or.at(kept, label, strong)
    keep = kept[label]
    return y[at][keep], x[at][keep], x[last][keep]


def edges(pixels: DataFrame, low: int, high: int, value: str = "g", soft: bool = False) -> DataFrame:
    """(image_id, y, a, b): the runs of edges of whole pictures, or of pictures that lack rows; soft: after a blur of 3 places.

    Pictures are spread by their id and each is one matrix in its task, so a pixel is sorted once, by picture, and not along rows and columns."""
    types = pixels.schema

    def run(table: pa.Table) -> pa.Table:
        picture, top, left = matrix(table, value)
        seen = np.isin(np.arange(len(picture)) + top, table["y"])
        if soft:
            picture[seen] = softened(picture[seen])
        rows, first, last = edge_runs(picture, low, high, seen)
        found = {"y": rows + top, "a": first + left, "b": last + left}
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(rows)), **{n: pa.array(c, table["y" if n == "y" else "x"].type) for n, c in found.items()}})

    out = StructType([types["image_id"], *[StructField(n, types[c].dataType) for n, c in (("y", "y"), ("a", "x"), ("b", "x"))]])
    return pixels.select("image_id", "y", "x", value).groupBy("image_id").applyInArrow(run, out)


def inside(x: Column, y: Column, w: Column, h: Column) -> Column:
    """How many pixels of a run lie in a rectangle."""
    own = F.least(F.col("b"), x + w - 1) - F.greatest(F.col("a"), x) + 1
    return F.when((F.col("y") >= y) & (F.col("y") < y + h), F.greatest(own, F.lit(0))).otherwise(0)


def face_ring(pixels: DataFrame, face: Column) -> DataFrame:
    """(image_id, density, score): edges left of, right of and above a face, which an original has few of.

    face: a struct (x, y, w, h) from image_id. Parts under 4 pixels wide or high are left out; with fewer than 100 pixels in all, or without a face, the
    density is null and the score 1."""
    found = edges(pixels, *AROUND, soft=True)
    size = sides(pixels).withColumn("face", face)
    f = F.col("face")
    band = F.greatest(F.lit(8), whole(f["w"] * BAND))
    top, high = f["y"] - whole(f["h"] * 0.15), whole(f["h"] * 0.9)
    parts = [(f["x"] - band, top, band, high), (f["x"] + f["w"], top, band, high), (f["x"] - whole(band / 2), f["y"] - whole(f["h"] * 0.45) - whole(band / 2), f["w"] + band, band)]
    cut = []
    for x, y, w, h in parts:
        x, y = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
        w, h = F.least(w, F.col("width") - x), F.least(h, F.col("height") - y)
        seen = f.isNotNull() & (w >= 4) & (h >= 4)
        cut.append(F.struct(x.alias("x"), y.alias("y"), F.when(seen, w).otherwise(0).alias("w"), F.when(seen, h).otherwise(0).alias("h")))
    size = size.select("image_id", F.array(*cut).alias("parts"))
    total = lambda c: sum((c(F.col("parts")[k]) for k in range(3)), F.lit(0))
    counted = found.join(size, "image_id").groupBy("image_id").agg(F.sum(total(lambda p: inside(p["x"], p["y"], p["w"], p["h"]))).alias("edge"))
    rows = size.select("image_id", total(lambda p: p["w"] * p["h"]).alias("all")).join(counted, "image_id", "left")
    density = F.when(F.col("all") >= 100, F.coalesce("edge", F.lit(0)) / F.col("all"))
    return rows.select("image_id", density.alias("density")).withColumn("score", F.coalesce(signals.face_ring(F.col("density")), F.lit(1.0)))


def background(pixels: DataFrame, share: float = MARGIN) -> DataFrame:
    """(image_id, edges, std, score): the share of edges and the deviation in a picture's margins. Pixels may have the height and width of the frame that
    they are in; the share is of those that are there."""
    mw, mh = whole(F.col("width") * share), whole(F.col("height") * share)
    outside = (F.col("x") < mw) | (F.col("x") >= F.col("width") - mw) | (F.col("y") < mh) | (F.col("y") >= F.col("height") - mh)
    own = margin(pixels, share, F.count_if(outside).alias("all"), *[F.max(c).alias(c) for c in ("height", "width")])
    edge = (F.col("b") - F.col("a") + 1) - inside(mw, mh, F.col("width") - 2 * mw, F.col("height") - 2 * mh)
    rows = own.join(edges(pixels, *MARGINS), "image_id", "left").groupBy("image_id", "all", "std").agg(F.coalesce(F.sum(edge), F.lit(0)).alias("edge"))
    part = F.when(F.col("all") > 0, F.col("edge") / F.col("all")).otherwise(0.0).alias("edges")
    return rows.select("image_id", part, "std").withColumn("score", signals.background(F.col("edges"), F.col("std")))


def densities(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, i, value) of grey pictures of one size: the share of edges in the whole and in three thirds of the upper half, as
    features 75 to 78."""
    half, third = height // 2, width // 3
    parts = [(0, 0, width, height), (0, 0, third, half), (third, 0, third, half), (2 * third, 0, width - 2 * third, half)]
    found = edges(pixels, *AROUND, soft=True)
    each = [F.struct(F.lit(75 + k).alias("i"), (F.sum(inside(*(F.lit(v) for v in p))) / (p[2] * p[3])).alias("value")) for k, p in enumerate(parts)]
    return found.groupBy("image_id").agg(F.array(*each).alias("all")).select("image_id", F.inline("all")).where("value <> 0")


def lines_of(y: np.ndarray, x: np.ndarray, least: int, length: int, gap: int) -> list[tuple[int, int, int, int]]:
    """(angle, distance, first, last) of the stretches of edge pixels on a picture's lines. Every pixel votes for the line through it of each whole degree of the normal, by
    its distance from the corner; places on a line are those along the axis that it is nearer to."""
    distances = lambda k: np.floor(x * COSINE[k] + y * SINE[k] + 0.5).astype(np.int64)
    # one place more at each end, which no line has
    base = int(np.abs(x).max() + np.abs(y).max()) + 2
    cells = np.zeros((len(COSINE) + 2, 2 * base + 1), np.int64)
    for k in range(len(COSINE)):
        cells[k + 1] = np.bincount(distances(k) + base, minlength=2 * base + 1)
    cells[cells < least] = 0
    n = cells[1:-1, 1:-1]
    peaks = (n > 0) & (n > cells[1:-1, :-2]) & (n >= cells[1:-1, 2:]) & (n > cells[:-2, 1:-1]) & (n >= cells[2:, 1:-1])
    out = []
    for k in np.flatnonzero(peaks.any(axis=1)).tolist():
        own, along = distances(k), x if 45 <= k <= 135 else y
        for d in (np.flatnonzero(peaks[k]) + 1 - base).tolist():
            places = np.unique(along[own == d])
            cut = np.flatnonzero(np.diff(places) > gap + 1)
            first, last = places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]
            out += [(k, d, int(a), int(b)) for a, b in zip(first, last, strict=True) if b - a >= length]
    return out


def line_segments(found: DataFrame, least: int = VOTES, length: int = LENGTH, gap: int = GAP) -> DataFrame:
    """(image_id, angle, distance, first, last): stretches of edges on a line, with at most gap places missing in a row and at least so long.

    Lines are cells of (angle, distance) with at least so many votes, more than the neighbours before and no fewer than those after, in
    angle and in distance. Votes are counted inside a picture: only runs are shuffled."""

    def run(table: pa.Table) -> pa.Table:
        y, a, b = (np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("y", "a", "b"))
        count = b - a + 1
        x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        lines = lines_of(np.repeat(y, count), x, least, length, gap)
        columns = zip(*lines, strict=True) if lines else [[]] * 4
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(lines)), **{n: pa.array(c, pa.int32()) for n, c in zip(("angle", "distance", "first", "last"), columns, strict=True)}})

    out = StructType([found.schema["image_id"], *[StructField(n, IntegerType()) for n in ("angle", "distance", "first", "last")]])
    return found.groupBy("image_id").applyInArrow(run, out)


def perspective(pixels: DataFrame, least: int = VOTES, length: int = LENGTH, gap: int = GAP) -> DataFrame:
    """(image_id, level, upright, diagonal, score): lines within 10 degrees of the axes, and others."""
    found = line_segments(edges(pixels, *AROUND), least, length, gap)
    level, upright = F.abs(F.col("angle") - 90) < 10, (F.col("angle") < 10) | (F.col("angle") > 170)
    counts = found.groupBy("image_id").agg(F.count_if(level).alias("level"), F.count_if(upright).alias("upright"), F.count_if(~level & ~upright).alias("diagonal"))
    rows = sides(pixels).select("image_id").join(counts, "image_id", "left").na.fill(0)
    return rows.withColumn("score", signals.perspective(F.col("level"), F.col("upright"), F.col("diagonal")))


def portrait_vector(pixels: DataFrame, zone: Column, width: int = 128, height: int = 160) -> DataFrame:
    """(image_id, i, value): the features of the portrait (a struct x, y, w, h from image_id) of colour pictures (image_id, y, x, b, g, r), brought to one size: those
    of `measures.portrait_features` and the edge densities 75 to 78. Features of 0 have no row."""
    rows = pixels.withColumn("zone", zone).where((F.col("x") >= F.col("zone.x")) & (F.col("x") < F.col("zone.x") + F.col("zone.w")) & (F.col("y") >= F.col("zone.y")) & (F.col("y") < F.col("zone.y") + F.col("zone.h")))
    cut = rows.select("image_id", (F.col("y") - F.col("zone.y")).alias("y"), (F.col("x") - F.col("zone.x")).alias("x"), "b", "g", "r")
    small = resized(cut, width, height, ["b", "g", "r"])
    grey_only = small.select("image_id", "y", "x", grey(F.col("b"), F.col("g"), F.col("r")).alias("g"))
    return portrait_features(small).unionByName(densities(grey_only, width, height))
