"""Picture statistics as aggregations and windows over pixels (image_id, y, x, g), and array kernels where these do not do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def block_stats(pixels: DataFrame, size: int) -> DataFrame:
    """(image_id, by, bx, mean, std) of square blocks; population deviation."""
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    return pixels.groupBy("image_id", block("y").alias("by"), block("x").alias("bx")).agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"))


def histogram(pixels: DataFrame, shift: int = 0) -> DataFrame:
    """(image_id, bin, n): grey values shifted right by some bits (5: eight bins)."""
    return pixels.groupBy("image_id", F.shiftright("g", shift).alias("bin")).agg(F.count("*").alias("n"))


def share(condition: Column) -> Column:
    """The share of pixels, as an aggregate."""
    return F.count_if(condition) / F.count("*")


def dynamic_range(pixels: DataFrame) -> DataFrame:
    """(image_id, extreme, middle, score): little but dark and light is a photocopy's profile."""
    g = F.col("g")
    found = pixels.groupBy("image_id").agg(share((g < 50) | (g >= 206)).alias("extreme"), share(g.between(80, 175)).alias("middle"))
    low = (F.col("extreme") > 0.75) & (F.col("middle") < 0.10)
    return found.withColumn("score", F.when(low, F.greatest(F.lit(0.10), 1 - F.col("extreme"))).otherwise(1.0))


def glare(pixels: DataFrame) -> DataFrame:
    """(image_id, bright, score): over 8 % of burnt-out pixels."""
    found = pixels.groupBy("image_id").agg(share(F.col("g") > 250).alias("bright"))
    return found.withColumn("score", F.when(F.col("bright") > 0.08, F.greatest(F.lit(0.3), 1 - 4 * F.col("bright"))).otherwise(1.0))


def saturation(b: Column, g: Column, r: Column) -> Column:
    """Saturation 0 to 255 of a colour."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    return F.when(high > 0, F.floor((high - low) * 255.0 / high + 0.5)).otherwise(0).cast("int")


def hue(b: Column, g: Column, r: Column) -> Column:
    """Hue of a colour in half degrees, 0 to 180; 0 for grey."""
    high, span = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    sixth = F.when(high == r, (g - b) * 60.0 / span).when(high == g, (b - r) * 60.0 / span + 120).otherwise((r - g) * 60.0 / span + 240)
    return F.when(span == 0, 0.0).otherwise(F.when(sixth < 0, sixth + 360).otherwise(sixth) / 2)


def inverted(g: Column) -> Column:
    """The negative of a grey value."""
    return 255 - g


def colour_profile(pixels: DataFrame, document_type: Column) -> DataFrame:
    """(image_id, hue, sat, val, score) of colour pixels: too dark; a yellow card that is not; a pale card that is colourful.

    document_type: a column of the pixels that is the same for a whole picture. Passports have no profile.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    rows = pixels.select("image_id", hue(b, g, r).alias("h"), saturation(b, g, r).alias("s"), F.greatest(b, g, r).alias("v"), document_type.alias("t"))
    found = rows.groupBy("image_id").agg(F.avg("h").alias("hue"), F.avg("s").alias("sat"), F.avg("v").alias("val"), F.max("t").alias("t"))
    yellow = F.col("hue").between(12, 50) & (F.col("sat") > 30)
    loss = F.when(F.col("t") == "COL_CC_OLD", F.when(~yellow, 0.3).otherwise(0.0)).when((F.col("t") != "COL_PA") & (F.col("sat") > 70), 0.15).otherwise(0.0)
    return found.select("image_id", "hue", "sat", "val", F.when(F.col("val") < 80, 0.4).otherwise(F.greatest(F.lit(0.2), 1 - loss)).alias("score"))


def photo_zone(width: Column, height: Column, left: float, top: float, wide: float, high: float) -> Column:
    """A struct (x, y, w, h) of the portrait's place given as shares of a picture, kept inside it."""
    x = F.greatest(F.lit(0), F.least((width * left).cast("int"), width - 2))
    y = F.greatest(F.lit(0), F.least((height * top).cast("int"), height - 2))
    return F.struct(x.alias("x"), y.alias("y"), F.least((width * wide).cast("int"), width - x).alias("w"), F.least((height * high).cast("int"), height - y).alias("h"))


def inside(zone: Column) -> Column:
    """Whether a pixel lies in a zone."""
    return (F.col("x") >= zone["x"]) & (F.col("x") < zone["x"] + zone["w"]) & (F.col("y") >= zone["y"]) & (F.col("y") < zone["y"] + zone["h"])


def obscured(pixels: DataFrame, zone: Column) -> DataFrame:
    """(image_id, val, sat, dark, score) of the colour pixels of a portrait: crossed out, covered, or nearly so."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    rows = pixels.where(inside(zone)).select("image_id", saturation(b, g, r).alias("s"), F.greatest(b, g, r).alias("v"))
    found = rows.groupBy("image_id").agg(F.avg("v").alias("val"), F.avg("s").alias("sat"), share(F.col("v") < 40).alias("dark"))
    covered, nearly = (F.col("val") < 35) | (F.col("dark") > 0.70), (F.col("val") < 60) & (F.col("sat") < 30) & (F.col("dark") > 0.40)
    return found.withColumn("score", F.when(covered, 0.0).when(nearly, 0.25).otherwise(1.0))


def zone_colour(pixels: DataFrame, zone: Column, width: Column, gap: int = 10) -> DataFrame:
    """(image_id, sat, val, score): a portrait's colours against the wider side of the document beside it, without glare.

    sat: how much more saturated the portrait is; val: how much its brightness differs. Null if either part has no pixel.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    left, right = zone["x"] - gap, width - F.least(width, zone["x"] + zone["w"] + gap)
    beside = F.when(F.greatest(left, F.lit(0)) >= F.greatest(right, F.lit(0)), F.col("x") < F.greatest(left, F.lit(1))).otherwise(F.col("x") >= width - F.greatest(right, F.lit(1)))
    rows = pixels.select("image_id", saturation(b, g, r).alias("s"), F.greatest(b, g, r).alias("v"), inside(zone).alias("photo"), beside.alias("beside"), (F.greatest(left, right) >= width * 0.15).alias("wide"))
    # without glare inside the sums: as a filter it would find every colour again
    seen = F.col("v") <= 230
    mean = lambda c, part: F.avg(F.when(seen & F.col(part), F.col(c)))
    found = rows.groupBy("image_id").agg(F.count_if(seen).alias("n"), (mean("s", "photo") - mean("s", "beside")).alias("sat"), F.abs(mean("v", "photo") - mean("v", "beside")).alias("val"), F.max("wide").alias("wide")).where("n > 0")
    odd = F.col("wide") & ((F.col("sat") > 30) | (F.col("val") > 60))
    return found.select("image_id", "sat", "val", F.when(odd, F.greatest(F.lit(0.10), 1 - (F.greatest("sat", "val") - 8) / 40)).otherwise(1.0).alias("score"))


def saturation_score(pixels: DataFrame) -> DataFrame:
    """(image_id, mean, std, coloured, score) of colour pixels (b, g, r): grey or pale pictures. Not capped at 1 from above."""
    s = saturation(F.col("b"), F.col("g"), F.col("r"))
    found = pixels.withColumn("s", s).groupBy("image_id").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), share(F.col("s") > 20).alias("coloured"))
    grey, pale = (F.col("mean") < 8) | (F.col("coloured") < 0.05), (F.col("mean") < 20) & (F.col("std") < 12)
    return found.withColumn("score", F.when(grey, F.greatest(F.lit(0.0), F.col("mean") / 8)).when(pale, F.greatest(F.lit(0.20), F.col("mean") / 30)).otherwise(1.0))


def colour_temperature(pixels: DataFrame, least: int = 500) -> DataFrame:
    """(image_id, difference, score): bluish light areas of colour pixels; null difference with too few of them."""
    light = (F.col("b") * 0.114 + F.col("g") * 0.587 + F.col("r") * 0.299) > 180
    mean = lambda c: F.avg(F.when(light, F.col(c)))
    found = pixels.groupBy("image_id").agg(F.count_if(light).alias("n"), (mean("b") - mean("r")).alias("d"))
    d = F.when(F.col("n") >= least, F.col("d"))
    return found.select("image_id", d.alias("difference"), F.when(d > 8, F.greatest(F.lit(0.1), 1 - (d - 8) / 30)).otherwise(1.0).alias("score"))


def ordered_deviation(values: Column) -> Column:
    """The population deviation of an array of doubles by a running mean in its order. That of an aggregate depends, in its last digits, on how rows are dealt, which
    decides for a block whose deviation is just the limit."""

    def step(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["sum"] + (v - mean) * (v - s["mean"])).alias("sum"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sum"))
    return F.aggregate(values, zero, step, lambda s: F.sqrt(s["sum"] / s["n"]))


def toner(pixels: DataFrame, size: int = 32, least: int = 5) -> DataFrame:
    """(image_id, blocks, bimodal, score): text blocks of almost only black and white."""
    g = F.col("g")
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    held = F.array_sort(F.collect_list(F.struct("y", "x", F.col("g").cast("double").alias("g")))).alias("all")
    stats = pixels.groupBy("image_id", block("y").alias("by"), block("x").alias("bx")).agg(F.avg("g").alias("mean"), held, share((g <= 30) | (g > 225)).alias("extreme"))
    stats = stats.select("image_id", "mean", ordered_deviation(F.transform("all", lambda s: s["g"])).alias("std"), "extreme")
    text = (F.col("mean") > 40) & (F.col("mean") < 220) & (F.col("std") > 50)
    found = stats.groupBy("image_id").agg(F.count_if(text).alias("blocks"), F.count_if(text & (F.col("extreme") > 0.70)).alias("bimodal"))
    ratio = F.col("bimodal") / F.col("blocks")
    return found.withColumn("score", F.when((F.col("blocks") >= least) & (ratio > 0.50), F.greatest(F.lit(0.10), 1 - ratio)).otherwise(1.0))


def contrast(pixels: DataFrame) -> DataFrame:
    """(image_id, std, score): flat pictures."""
    return pixels.groupBy("image_id").agg(F.stddev_pop("g").alias("std")).withColumn("score", F.when(F.col("std") < 20, F.greatest(F.lit(0.1), F.col("std") / 20)).otherwise(1.0))


def largest(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, area) of rectangles (keys, i, w, h): the largest of each key, the first of equals."""
    row = F.struct((-(F.col("w") * F.col("h"))).alias("by"), "i")
    return rectangles.groupBy(*keys).agg(F.min(row).alias("best")).select(*keys, "best.i", (-F.col("best.by")).alias("area"))


def aspect_score(width: Column, height: Column) -> Column:
    """How far a picture's sides are from a card's, either way up; up to a tenth is fine."""
    ratio = F.greatest(width, height) / F.least(width, height)
    off = F.abs(ratio - 85.60 / 53.98) / (85.60 / 53.98)
    return F.when(off <= 0.10, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 3 * off))


def boundaries(noise: DataFrame) -> DataFrame:
    """(image_id, pairs, jumps, score) of a noise map (image_id, y, x, v): neighbours to the right and below that differ.

    All neighbours are pairs; those without noise (0.5 at most) never differ. Windows are by a row or a column of one picture's map, so bounded by its side.
    """
    right = F.lead("v").over(Window.partitionBy("image_id", "y").orderBy("x"))
    below = F.lead("v").over(Window.partitionBy("image_id", "x").orderBy("y"))
    sides = noise.select("image_id", "v", right.alias("right"), below.alias("below"))
    counted, jump = [], []
    for other in (F.col("right"), F.col("below")):
        high = F.greatest(F.col("v"), other)
        counted.append(other.isNotNull().cast("int"))
        jump.append(((high > 0.5) & (F.abs(F.col("v") - other) / high > 0.70)).cast("int"))
    found = sides.groupBy("image_id").agg(F.sum(counted[0] + counted[1]).alias("pairs"), F.sum(F.coalesce(jump[0], F.lit(0)) + F.coalesce(jump[1], F.lit(0))).alias("jumps"))
    ratio = F.col("jumps") / F.greatest("pairs", F.lit(1))
    return found.withColumn("score", F.when(ratio > 0.18, F.greatest(F.lit(0.1), 1 - 3 * ratio)).otherwise(1.0))


def uniform_bins() -> list[int]:
    """The bin of each pattern of eight neighbours: those with two changes around the circle at most in order, others last."""
    bins, used = [], 0
    for code in range(256):
        changes = sum((code >> k & 1) != (code >> (k + 1) % 8 & 1) for k in range(8))
        bins.append(used if changes <= 2 else 58)
        used += changes <= 2
    return bins


def lbp_histogram(pixels: DataFrame, apart: bool = False) -> DataFrame:
    """(image_id, bin, share): uniform local binary patterns of inner pixels. apart: the pixels are already dealt by picture."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    # one shuffle, by picture, serves both windows and the counts
    own = pixels if apart else pixels.repartition("image_id")
    three = own.select("image_id", "y", "x", F.lag("g").over(row).alias("l"), F.col("g").alias("c"), F.lead("g").over(row).alias("r"))
    around = [f"{'up' if f is F.lag else 'down'}_{n}" for f in (F.lag, F.lead) for n in "lcr"]
    all_nine = three.select("image_id", "l", "c", "r", *[f(n).over(column).alias(f"{'up' if f is F.lag else 'down'}_{n}") for f in (F.lag, F.lead) for n in "lcr"])
    inner = all_nine.where(" and ".join(f"{n} is not null" for n in (*around, "l", "r")))
    order = ["up_l", "up_c", "up_r", "r", "down_r", "down_c", "down_l", "l"]
    bits = [F.when(F.col(n) >= F.col("c"), 1 << (7 - k)).otherwise(0) for k, n in enumerate(order)]
    # counts of the 256 patterns first: a pixel then is one addition
    codes = inner.select("image_id", sum(bits[1:], bits[0]).alias("code")).groupBy("image_id", "code").agg(F.count("*").alias("n"))
    binned = codes.select("image_id", F.element_at(F.array(*[F.lit(b) for b in uniform_bins()]), F.col("code") + 1).alias("bin"), "n")
    every = binned.groupBy("image_id", "bin").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("image_id")))
    return every.select("image_id", "bin", (F.col("n") / F.col("total")).alias("share"))


def _hashed(blocks: DataFrame) -> DataFrame:
    """(image_id, all): a picture's blocks (i, g, m) as one array; its size bounds them."""
    mean = F.aggregate("g", F.lit(0.0), lambda s, v: s + v) / F.size("g")
    return blocks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "g", mean.alias("m")))).alias("all"))


def similar_blocks(blocks: DataFrame, most: int = 5) -> DataFrame:
    """(image_id, a, b, distance) of blocks (image_id, i, g: 64 values) at least two places apart whose hashes are near.

    A hash has a bit for each value above the mean of the pair's first block. Pairs meet only inside a picture, whose
    number of blocks is bounded by its size; far ones are dropped where they are made.
    """

    def near(a: Column) -> Column:
        apart = lambda b: F.aggregate(F.zip_with(a["g"], b["g"], lambda x, v: ((x > a["m"]) != (v > a["m"])).cast("int")), F.lit(0), lambda s, v: s + v)
        later = F.filter("all", lambda b: b["i"] >= a["i"] + 2)
        pairs = F.transform(later, lambda b: F.struct(a["i"].alias("a"), b["i"].alias("b"), apart(b).alias("distance")))
        return F.filter(pairs, lambda p: p["distance"] <= most)

    return _hashed(blocks).select("image_id", F.inline(F.flatten(F.transform("all", near))))


def clone_score(blocks: DataFrame, most: int = 5) -> DataFrame:
    """(image_id, near, pairs, score): the share of near pairs among all pairs of different blocks."""
    near = similar_blocks(blocks, most).groupBy("image_id").agg(F.count("*").alias("near"))
    found = blocks.groupBy("image_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("pairs")).join(near, "image_id", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    ratio = F.col("near") / F.greatest("pairs", F.lit(1))
    return found.select("image_id", "near", "pairs", F.when(ratio > 0.05, F.greatest(F.lit(0.3), 1 - 5 * ratio)).otherwise(1.0).alias("score"))


# Kernels on whole pictures, for what is not relational: transforms and wide filters.


def per_image(pictures: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], fields: str) -> DataFrame:
    """(image_id, fields): a numpy function of each picture (image_id, width, grey: array of its rows end to end), row by row."""
    schema = StructType.fromDDL(f"image_id long, {fields}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image_id, width, values in zip(batch.column("image_id").to_pylist(), batch.column("width").to_pylist(), batch.column("grey"), strict=True):
                picture = np.asarray(values.values, float).reshape(-1, width)
                out.append({"image_id": image_id, **kernel(picture)})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(f.name, pa.int64() if f.name == "image_id" else pa.float64()) for f in schema.fields]))

    return pictures.select(F.col("image_id").cast("long"), "width", "grey").mapInArrow(run, schema)


def transform_size(n: int) -> int:
    """The least size from n on that has no prime factor over 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def spectrum(picture: np.ndarray) -> np.ndarray:
    """The centred log spectrum scaled to 0 to 1, of the picture with zeros up to a size that transforms well."""
    size = tuple(transform_size(n) for n in picture.shape)
    log = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(picture, size))))
    return (log - log.min()) / max(np.ptp(log), 1e-12)


def _radius(shape: tuple[int, int]) -> np.ndarray:
    y, x = np.indices(shape)
    return np.hypot(y - shape[0] // 2, x - shape[1] // 2)


def _reach(picture: np.ndarray) -> int:
    """The radius of the spectrum's inner circle."""
    return min(picture.shape[0] // 2, picture.shape[1] // 2)


def halftone(picture: np.ndarray) -> dict[str, float]:
    """Energy and peaks of the spectrum from 15 to 40 % of its radius: a print raster."""
    s = spectrum(picture)
    r, reach = _radius(s.shape), _reach(s)
    ring = (r >= int(reach * 0.15)) & (r <= int(reach * 0.40))
    norm, band = float(((s > 0.78) & ring).sum()) / (s.size + 1), float(s[ring].sum() / max(s.sum(), 1e-12))
    return {"peaks": norm, "band": band, "score": max(0.0, 0.35 - 50 * norm) if norm > 0.0018 or band > 0.28 else 1.0}


def moire(picture: np.ndarray) -> dict[str, float]:
    """Peaks of the spectrum outside a fifth of its radius: the grid of a screen."""
    s = spectrum(picture)
    peak = (s > 0.75) & (_radius(s.shape) > _reach(s) // 5)
    norm, ratio = float(peak.sum()) / (s.size + 1), float(s[peak].sum() / max(s.sum(), 1e-12))
    return {"peaks": norm, "ratio": ratio, "score": max(0.0, 0.4 - 2 * ratio) if norm > 0.0015 or ratio > 0.08 else 1.0}


def soft_weights(size: int) -> np.ndarray:
    """Whole weights of a normal curve over so many places that add to 256; its deviation follows from the size."""
    deviation = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * deviation**2))
    w = np.round(256 * w / w.sum()).astype(np.int64)
    w[size // 2] += 256 - w.sum()
    return w


def _across(picture: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Correlation along the rows with mirrored ends."""
    k = len(weights) // 2
    padded = np.pad(picture, ((0, 0), (k, k)), mode="reflect")
    return sum(w * padded[:, j : j + picture.shape[1]] for j, w in enumerate(weights.tolist()))


def illumination(picture: np.ndarray) -> dict[str, float]:
    """Jumps of the light's direction: the variation of the gradient of a heavy blur, 15 % of the shorter side wide or 51."""
    weights = soft_weights(max(51, int(min(picture.shape) * 0.15) | 1))
    soft = np.floor(_across(_across(picture.astype(np.int64), weights).T, weights).T / 65536 + 0.5)
    smooth, slope = np.array([1, 2, 1]), np.array([-1, 0, 1])
    gx, gy = _across(_across(soft, slope).T, smooth).T, _across(_across(soft, smooth).T, slope).T
    gradient = np.hypot(gx, gy)
    mean = float(gradient.mean())
    cv = float(gradient.std() / mean) if mean > 0 else 0.0
    return {"cv": cv, "score": max(0.3, 1 - (cv - 2.5) / 5) if cv > 2.5 else 1.0}


KERNELS = {"halftone": (halftone, "peaks double, band double, score double"), "moire": (moire, "peaks double, ratio double, score double"), "illumination": (illumination, "cv double, score double")}
