"""Measures of pictures as windows and aggregates over pixels: filters, blocks, strips and grids.

Pixels are (image_id, y, x, g) or (image_id, y, x, b, g, r) of whole pictures, y and x from 0. A measure shuffles pixels once,
by picture; windows along rows and columns and sums over blocks then need no other shuffle, and a picture's size bounds a
task. Filters mirror a picture at its sides without repeating the last place, and give whole grey values, rounded half up.
Pictures too small for a measure have the score that says nothing could be seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from passplane.operators import signals
from passplane.operators.raster import inside, lbp_histogram, saturation

# The portrait's place on each kind of document as shares (left, top, width, height), and how far the portrait
# reaches around a face (left and up of it, then width and height, as shares of the face's).
PORTRAIT = {"CARD": (0.62, 0.08, 0.32, 0.75), "COL_CC_OLD": (0.48, 0.12, 0.32, 0.80), "COL_PA": (0.06, 0.12, 0.32, 0.65)}
AROUND_FACE = (0.40, 0.55, 1.80, 2.60)
#: Fixed value: how much compression errors are amplified.
AMPLIFY = 15.0


def whole(c: Column) -> Column:
    """A quotient as a whole number, toward zero."""
    return c.cast("int")


def sized(pixels: DataFrame) -> DataFrame:
    """Adds height and width; the one shuffle of a measure, and none where the pixels are already apart by picture. Pixels that have them stay as they are."""
    if {"height", "width"} <= set(pixels.columns):
        return pixels
    every = Window.partitionBy("image_id")
    return pixels.withColumns({"height": F.max("y").over(every) + 1, "width": F.max("x").over(every) + 1})


def lines(keys: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """Windows along the rows and along the columns of each part of a picture."""
    return Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")


def mirrored(name: str, along: WindowSpec) -> list[Column]:
    """A column two and one places before, here, and one and two places after."""
    c = F.col(name)
    b1, b2, a1, a2 = F.lag(name, 1).over(along), F.lag(name, 2).over(along), F.lead(name, 1).over(along), F.lead(name, 2).over(along)
    far = lambda own, near, other: F.coalesce(own, F.when(near.isNull(), other).otherwise(c), c)
    return [far(b2, b1, a2), F.coalesce(b1, a1, c), c, F.coalesce(a1, b1, c), far(a2, a1, b2)]


def blurred(pixels: DataFrame, keys: list[str], size: int = 5, value: str = "g") -> DataFrame:
    """Adds soft: the value after a binomial blur of 5 or 3 places each way, inside each part by keys."""
    taps = (1, 4, 6, 4, 1) if size == 5 else (0, 1, 2, 1, 0)
    row, column = lines(keys)
    weighted = lambda name, along: sum((c * w for c, w in zip(mirrored(name, along), taps, strict=True) if w), F.lit(0))
    rows = pixels.withColumn("_across", weighted(value, row))
    return rows.withColumn("soft", F.floor(weighted("_across", column) / sum(taps) ** 2 + 0.5).cast("int")).drop("_across")


def with_gradient(pixels: DataFrame, keys: list[str], value: str = "g") -> DataFrame:
    """Adds gradient: the length of the gradient by 3 by 3 differences, inside each part by keys."""
    row, column = lines(keys)
    _, left, here, right, _ = mirrored(value, row)
    rows = pixels.withColumns({"_d": right - left, "_s": left + 2 * here + right})
    up, down = (lambda n: mirrored(n, column)[1]), (lambda n: mirrored(n, column)[3])
    gx, gy = up("_d") + 2 * F.col("_d") + down("_d"), down("_s") - up("_s")
    return rows.withColumn("gradient", F.sqrt((gx * gx + gy * gy).cast("double"))).drop("_d", "_s")


def blocks(pixels: DataFrame, size: int) -> DataFrame:
    """Adds by, bx and whether the block counts: it ends before the picture's last row and column."""
    by, bx = whole(F.col("y") / size), whole(F.col("x") / size)
    return pixels.withColumns({"by": by, "bx": bx}).withColumn("counts", ((F.col("by") + 1) * size < F.col("height")) & ((F.col("bx") + 1) * size < F.col("width")))


def _spread(found: DataFrame, value: str) -> DataFrame:
    """(image_id, mean, ratio): of the blocks that count the mean and the range over it."""
    own = F.when(F.col("counts"), F.col(value))
    rows = found.groupBy("image_id").agg(F.avg(own).alias("mean"), (F.max(own) - F.min(own)).alias("range"))
    return rows.select("image_id", "mean", F.when(F.col("mean") > 0, F.col("range") / F.col("mean")).otherwise(0.0).alias("ratio"))


def sharpness(pixels: DataFrame, size: int = 32) -> DataFrame:
    """(image_id, mean, ratio, score): blocks, each filtered on its own, whose gradients are too much alike; 0.85 without one."""
    keys = ["image_id", "by", "bx"]
    rows = with_gradient(blocks(sized(pixels), size), keys).groupBy(*keys).agg(F.first("counts").alias("counts"), F.avg("gradient").alias("m"))
    even = (F.col("ratio") < 1.5) & (F.col("mean") < 25)
    return _spread(rows, "m").withColumn("score", F.when(F.col("mean").isNull(), 0.85).when(even, F.greatest(F.lit(0.3), F.col("ratio") / 1.5)).otherwise(1.0))


def noise_consistency(pixels: DataFrame, size: int = 64) -> DataFrame:
    """(image_id, mean, ratio, score): blocks whose noise (what a blur takes away, never below 0) differs; 0.85 without one."""
    rows = blocks(blurred(sized(pixels), ["image_id"]), size).withColumn("noise", F.greatest(F.col("g") - F.col("soft"), F.lit(0)))
    rows = rows.groupBy("image_id", "by", "bx").agg(F.first("counts").alias("counts"), F.stddev_pop("noise").alias("m"))
    return _spread(rows, "m").withColumn("score", F.when(F.col("mean").isNull(), 0.85).when(F.col("ratio") > 4, F.greatest(F.lit(0.2), 1 - (F.col("ratio") - 4) / 8)).otherwise(1.0))


def flat_texture(pixels: DataFrame, size: int = 24, least: int = 6) -> DataFrame:
    """(image_id, blocks, grain, score): the deviation inside bright even blocks after a blur; a screen has nearly none."""
    rows = blocks(blurred(sized(pixels), ["image_id"]), size).groupBy("image_id", "by", "bx").agg(F.first("counts").alias("counts"), F.avg("soft").alias("m"), F.stddev_pop("soft").alias("s"))
    own = F.col("counts") & (F.col("m") > 155) & (F.col("s") < 30)
    found = rows.groupBy("image_id").agg(F.count_if(own).alias("blocks"), F.avg(F.when(own, F.col("s"))).alias("grain"))
    seen = (F.col("blocks") >= least) & (F.col("grain") < 2.5)
    return found.withColumn("score", F.when(seen, F.greatest(F.lit(0.05), F.col("grain") / 2.5)).otherwise(1.0))


def backlight(pixels: DataFrame, grid: int = 4) -> DataFrame:
    """(image_id, cv, centre_cv, score): the variation of the means of a grid; a lit screen is too even.

    The grid of the central 70 % is looked at first, for a screen's dark frame makes the whole uneven. Cells under 4 pixels
    see nothing; up to a mean of 10 the variation counts as 1.
    """
    rows = sized(pixels)

    def means(left: Column, top: Column, width: Column, height: Column, large: Column, kind: str) -> DataFrame:
        wide, high = F.greatest(whole(width / grid), F.lit(1)), F.greatest(whole(height / grid), F.lit(1))
        gx, gy = F.floor((F.col("x") - left) / wide), F.floor((F.col("y") - top) / high)
        cell = large & (wide >= 4) & (high >= 4) & gx.between(0, grid - 1) & gy.between(0, grid - 1)
        return rows.groupBy("image_id", F.when(cell, gy * grid + gx).alias("cell")).agg(F.avg("g").alias("m")).withColumn("kind", F.lit(kind))

    w, h = F.col("width"), F.col("height")
    cx, cy = whole(w * 0.15), whole(h * 0.15)
    every = means(F.lit(0), F.lit(0), w, h, F.lit(True), "all").unionByName(means(cx, cy, w - 2 * cx, h - 2 * cy, (w - 2 * cx > 10) & (h - 2 * cy > 10), "centre"))
    own = lambda kind: F.when((F.col("kind") == kind) & F.col("cell").isNotNull(), F.col("m"))
    found = every.groupBy("image_id").agg(*[f(own(k)).alias(f"{n}_{k}") for k in ("all", "centre") for n, f in (("mean", F.avg), ("spread", F.stddev_pop))])
    cv = lambda k: F.when(F.col(f"mean_{k}") > 10, F.col(f"spread_{k}") / F.col(f"mean_{k}")).when(F.col(f"mean_{k}").isNotNull(), 1.0)
    found = found.withColumns({"cv": cv("all"), "centre_cv": cv("centre")})
    score = (
        F.when(F.col("cv").isNull(), 1.0)
        .when((F.col("centre_cv") < 0.08) & (F.col("mean_centre") > 60), F.greatest(F.lit(0.15), F.col("centre_cv") / 0.08))
        .when((F.col("cv") < 0.07) & (F.col("mean_all") > 50), F.greatest(F.lit(0.20), F.col("cv") / 0.07))
        .otherwise(1.0)
    )
    return found.select("image_id", "cv", "centre_cv", score.alias("score"))


def grey(b: Column, g: Column, r: Column) -> Column:
    """The grey value of a colour."""
    return F.floor((b * 114 + g * 587 + r * 299 + 500) / 1000).cast("int")


def row_means(pixels: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """(image_id, y, x, value, keep, level): the mean over nearly the whole row around each place, rounded.

    A row is held as one array with its running sums, so each mean is a difference of a few of them.
    """
    row, _ = lines(["image_id"])
    summed = pixels.withColumn("_sum", F.sum(value).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    held = summed.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", value, "_sum", *keep))).alias("_row"))
    n = F.size("_row")
    rows = held.select("image_id", "y", "_row", n.alias("_n"), whole((n - F.when(n % 2 == 0, 1).otherwise(0) - 1) / 2).alias("_reach"))
    n, reach = F.col("_n"), F.col("_reach")
    upto = lambda i: F.when(i < 0, 0).otherwise(F.try_element_at("_row", F.greatest(i, F.lit(0)).cast("int") + 1)["_sum"])

    def placed(p: Column, x: Column) -> Column:
        total = (
            upto(F.least(x + reach, n - 1)) - upto(x - reach - 1)
            + F.when(x < reach, upto(reach - x) - upto(F.lit(0))).otherwise(0)
            + F.when(x + reach > n - 1, upto(n - 2) - upto(2 * (n - 1) - (x + reach) - 1)).otherwise(0)
        )
        return F.struct(*[p[c].alias(c) for c in ("x", value, *keep)], F.floor(total / (2 * reach + 1) + 0.5).cast("int").alias("level"))

    # inside the row: the array is not copied to each of its places (outer, as no row is empty: so no filter evaluates it again)
    return rows.select("image_id", "y", F.inline_outer(F.transform("_row", placed)))


def screen(pixels: DataFrame) -> DataFrame:
    """(image_id, glare, blue_green, green_red, laplacian, banding, score) of colour pixels: what a photographed screen shows.

    Deviations of the differences of channels, of the Laplacian, and of what is left of the rows' means, outside glare (grey
    over 235); with glare over 40 % the score is 0.85.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    rows = sized(pixels).select("image_id", "y", "x", grey(b, g, r).alias("v"), F.abs(b - g).alias("bg"), F.abs(g - r).alias("gr"))
    row, column = lines(["image_id"])
    (_, left, here, right, _), (_, up, _, down, _) = mirrored("v", row), mirrored("v", column)
    rows = rows.withColumn("lap", left + right + up + down - 4 * here)
    rows = row_means(rows, "v", ["bg", "gr", "lap"]).withColumns({"band": F.abs(F.col("v") - F.col("level")), "seen": F.col("v") <= 235})
    deviation = lambda n: F.coalesce(F.stddev_pop(F.when(F.col("seen"), F.col(n))), F.lit(0.0))
    found = rows.groupBy("image_id").agg((F.count_if(~F.col("seen")) / F.count("*")).alias("glare"), deviation("bg").alias("blue_green"), deviation("gr").alias("green_red"), deviation("lap").alias("laplacian"), deviation("band").alias("banding"))
    score = signals.screen(F.col("blue_green"), F.col("green_red"), F.col("laplacian"), F.col("banding"))
    return found.withColumn("score", F.when(F.col("glare") > 0.40, 0.85).otherwise(score))


def margin(pixels: DataFrame, share: float = 0.08, *keep: Column) -> DataFrame:
    """(image_id, std, keep) of the strip along a picture's sides; keep: other aggregates over its pixels, which have height and width."""
    mw, mh = whole(F.col("width") * share), whole(F.col("height") * share)
    strip = (F.col("x") < mw) | (F.col("x") > F.col("width") - mw) | (F.col("y") < mh) | (F.col("y") > F.col("height") - mh)
    return sized(pixels).groupBy("image_id").agg(F.coalesce(F.stddev_pop(F.when(strip, F.col("g"))), F.lit(0.0)).alias("std"), *keep)


#: Errors are added as whole numbers of this part, so that sums and comparisons do not depend on the order of pixels.
ERROR_PART = 1_000_000


def regions(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, region, s, n) of an error picture (keys, y, x, e) with height and width: sums over a grid of 8 by 8 regions of n
    pixels each, in millionths."""
    wide, high = F.greatest(whole(F.col("width") / 8), F.lit(1)), F.greatest(whole(F.col("height") / 8), F.lit(1))
    ry, rx = whole(F.col("y") / high), whole(F.col("x") / wide)
    inside_grid = errors.where((ry < 8) & (rx < 8)).groupBy(*keys, (ry * 8 + rx).alias("region"))
    return inside_grid.agg(F.sum(F.round(F.col("e") * ERROR_PART).cast("long")).alias("s"), F.first(wide * high).cast("long").alias("n"))


def error_level(errors: DataFrame) -> DataFrame:
    """(image_id, mean, highest, std, score) of the compression errors (image_id, y, x, e) of a picture: uneven over its regions.

    e: the distance of a pixel's colour from the recompressed one's, before amplification. Regions without pixels have 0.
    """
    s, n, total = F.col("s").cast("decimal(19,0)"), F.col("n"), F.col("total")
    found = regions(sized(errors), ["image_id"]).groupBy("image_id").agg(F.sum("s").alias("total"), F.max("s").alias("top"), F.sum(s * s).alias("square"), F.first("n").alias("n"))
    spread = (F.col("square") * 64 - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    part = AMPLIFY / ERROR_PART
    found = found.withColumns({"mean": total * part / (n * 64), "highest": F.col("top") * part / n, "std": F.sqrt(spread) * part / (n * 64)})
    score = signals.error_level(F.col("std"), F.col("top") * 64, total)
    return found.select("image_id", "mean", "highest", "std", score.alias("score"))


def consistent_outliers(errors: DataFrame, qualities: int = 3) -> DataFrame:
    """(image_id, outliers, score) of errors (image_id, quality, y, x, e): regions over three times the mean at every quality.

    A quality with a mean below 0.5 tells nothing.
    """
    rows = regions(sized(errors), ["image_id", "quality"]).withColumn("total", F.sum("s").over(Window.partitionBy("image_id", "quality")))
    hit = (F.col("total") >= F.col("n") * (32 * ERROR_PART)) & (F.col("s") * 64 > F.col("total") * 3)
    hits = rows.groupBy("image_id", "region").agg(F.count_if(hit).alias("hits"))
    found = hits.groupBy("image_id").agg(F.count_if(F.col("hits") >= qualities).alias("outliers"))
    return found.withColumn("score", signals.consistent_outliers(F.col("outliers")))


def zone_error(errors: DataFrame, zone: Column, least: int = 10) -> DataFrame:
    """(image_id, photo, rest, score) of the compression errors (image_id, y, x, e) of a picture: the mean inside a portrait against all of the rest.

    zone: a struct (x, y, w, h) from image_id, height and width. A portrait under `least` places wide or high, cut at the picture's sides, tells nothing: 0.80. Sums are whole
    millionths, by one pre-aggregated pass over the pixels after one over their places for the picture's sides."""
    size = errors.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")).withColumn("z", zone)
    size = size.select("image_id", "height", "width", "z", F.least(F.col("z.w"), F.col("width") - F.col("z.x")).alias("zw"), F.least(F.col("z.h"), F.col("height") - F.col("z.y")).alias("zh"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    within = (x >= z["x"]) & (x < z["x"] + F.col("zw")) & (y >= z["y"]) & (y < z["y"] + F.col("zh"))
    rows = errors.join(size, "image_id").select("image_id", F.round(F.col("e") * ERROR_PART).cast("long").alias("s"), within.alias("within"), ((F.col("zw") >= least) & (F.col("zh") >= least)).alias("seen"))
    mean = lambda c: F.coalesce(F.sum(F.when(c, F.col("s"))) / (F.count_if(c) * ERROR_PART), F.lit(0.0))
    found = rows.groupBy("image_id").agg(mean(F.col("within")).alias("photo"), mean(~F.col("within")).alias("rest"), F.first("seen").alias("seen"))
    return found.select("image_id", "photo", "rest", F.when(F.col("seen"), signals.zone_error_level(F.col("photo"), F.col("rest"))).otherwise(0.80).alias("score"))


def portrait(width: Column, height: Column, document_type: Column, face: Column | None = None) -> Column:
    """The struct (x, y, w, h) of the portrait: around a face (struct x, y, w, h) where one is given, else by the type's place."""
    kind = F.when(document_type.isin("COL_CC_OLD", "COL_PA"), document_type).otherwise("CARD")
    at = [F.coalesce(*[F.when(kind == k, F.lit(v[i])) for k, v in PORTRAIT.items()]) for i in range(4)]
    place = [whole(at[0] * width), whole(at[1] * height), whole(at[2] * width), whole(at[3] * height)]
    if face is not None:
        around = [face["x"] - whole(face["w"] * AROUND_FACE[0]), face["y"] - whole(face["h"] * AROUND_FACE[1]), whole(face["w"] * AROUND_FACE[2]), whole(face["h"] * AROUND_FACE[3])]
        place = [F.when(face.isNotNull(), a).otherwise(p) for a, p in zip(around, place, strict=True)]
    x, y = F.greatest(F.lit(0), F.least(place[0], width - 2)), F.greatest(F.lit(0), F.least(place[1], height - 2))
    w, h = F.greatest(F.lit(2), F.least(place[2], width - x)), F.greatest(F.lit(2), F.least(place[3], height - y))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def border_noise(pixels: DataFrame, zone: Column) -> DataFrame:
    """(image_id, inner, outer, score): noise inside a portrait against the strips left and right of it, each blurred apart.

    zone: from columns of the pixels, height and width; the same for a whole picture. 0.85 without a strip.
    """
    rows = sized(pixels).withColumn("zone", zone)
    z, x, y = F.col("zone"), F.col("x"), F.col("y")
    m = F.greatest(F.lit(4), whole(F.least(z["w"], z["h"]) / 10))
    level = (y >= z["y"]) & (y < z["y"] + z["h"])
    inner = inside(F.struct((z["x"] + m).alias("x"), (z["y"] + m).alias("y"), (z["w"] - 2 * m).alias("w"), (z["h"] - 2 * m).alias("h")))
    left = (z["x"] - m >= 0) & (x >= z["x"] - m) & (x < z["x"]) & level
    right = (z["x"] + z["w"] + m < F.col("width")) & (x >= z["x"] + z["w"]) & (x < z["x"] + z["w"] + m) & level
    part = F.when(inner, "inner").when(left, "left").when(right, "right").otherwise("rest")
    rows = blurred(rows.withColumn("part", part), ["image_id", "part"]).withColumn("noise", F.greatest(F.col("g") - F.col("soft"), F.lit(0)))
    own = lambda p: F.stddev_pop(F.when(F.col("part") == p, F.col("noise")))
    found = rows.groupBy("image_id").agg(F.coalesce(own("inner"), F.lit(0.0)).alias("inner"), own("left").alias("l"), own("right").alias("r"))
    outer = F.when(F.col("l").isNull() | F.col("r").isNull(), F.coalesce("l", "r")).otherwise((F.col("l") + F.col("r")) / 2)
    found = found.select("image_id", "inner", outer.alias("outer"))
    return found.withColumn("score", F.when(F.col("outer").isNull(), 0.85).otherwise(signals.border_noise(F.col("inner"), F.col("outer"))))


def clone_blocks(pixels: DataFrame, size: int = 32, step: int = 64) -> DataFrame:
    """(image_id, i, g: 64 values): blocks at every step, shrunk to 8 by 8 by the mean of the four pixels in the middle of
    each of their cells. Pictures too small for a block have none."""
    cell = size // 8
    rows = sized(pixels).withColumns({"by": whole(F.col("y") / step), "bx": whole(F.col("x") / step), "ly": F.col("y") % step, "lx": F.col("x") % step})
    middle = lambda c: (F.col(c) < size) & (F.col(c) % cell).isin(cell // 2 - 1, cell // 2)
    rows = rows.where((F.col("by") * step + size < F.col("height")) & (F.col("bx") * step + size < F.col("width")) & middle("ly") & middle("lx"))
    across = whole((F.col("width") - size - 1) / step) + 1
    small = rows.groupBy("image_id", (F.col("by") * across + F.col("bx")).alias("i"), (whole(F.col("ly") / cell) * 8 + whole(F.col("lx") / cell)).alias("at")).agg(F.floor(F.sum("g") / 4 + 0.5).alias("v"))
    held = small.groupBy("image_id", "i").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))
    return held.select("image_id", "i", F.transform("all", lambda s: s["v"].cast("double")).alias("g"))


def noise_map(pixels: DataFrame, size: int = 16) -> DataFrame:
    """(image_id, y, x, v): the deviation of what a blur changes in each block, blurred apart; pictures under 4 blocks have none."""
    rows = sized(pixels).withColumns({"by": whole(F.col("y") / size), "bx": whole(F.col("x") / size)})
    across, down = whole(F.col("width") / size), whole(F.col("height") / size)
    rows = rows.where((across >= 4) & (down >= 4) & (F.col("bx") < across) & (F.col("by") < down))
    rows = blurred(rows, ["image_id", "by", "bx"], 3).withColumn("noise", F.abs(F.col("g") - F.col("soft")))
    return rows.groupBy("image_id", F.col("by").alias("y"), F.col("bx").alias("x")).agg(F.stddev_pop("noise").alias("v"))


def portrait_features(pixels: DataFrame, apart: bool = False) -> DataFrame:
    """(image_id, i, value) of a portrait's colour pixels: 0 to 58 local binary patterns, 59 to 66 saturation and 67 to 74
    brightness in eight bins, 79 to 82 their means and deviations over 255. 75 to 78, edge densities, come from elsewhere.
    Features of 0 have no row. apart: the pixels are already dealt by picture."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    own = pixels if apart else pixels.repartition("image_id")
    rows = own.select("image_id", "y", "x", grey(b, g, r).alias("g"), saturation(b, g, r).alias("s"), F.greatest(b, g, r).alias("v"))
    patterns = lbp_histogram(rows.select("image_id", "y", "x", "g"), True).select("image_id", F.col("bin").alias("i"), F.col("share").alias("value"))
    # counts of pairs of bins first: a pixel is one addition
    bins = rows.groupBy("image_id", F.shiftright("s", 5).alias("s"), F.shiftright("v", 5).alias("v")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("image_id")))
    bins = bins.select("image_id", "n", "total", F.explode(F.array(F.col("s") + 59, F.col("v") + 67)).alias("i")).groupBy("image_id", "i").agg((F.sum("n") / F.first("total")).alias("value"))
    moments = [F.struct(F.lit(79 + k).alias("i"), (f(c) / 255).alias("value")) for k, (c, f) in enumerate((c, f) for c in ("s", "v") for f in (F.avg, F.stddev_pop))]
    others = rows.groupBy("image_id").agg(F.array(*moments).alias("all")).select("image_id", F.inline("all"))
    return patterns.unionByName(bins).unionByName(others).where("value <> 0")


def zone_threshold(pixels: DataFrame, top: float = 0.65) -> DataFrame:
    """(image_id, threshold, light) of the strip in which a zone is looked for: the grey value that parts its histogram best
    (the first of equals), and the share above it."""
    strip = sized(pixels).where(F.col("y") >= whole(F.col("height") * top)).groupBy("image_id", "g").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy("image_id").orderBy("g"), Window.partitionBy("image_id")
    c = F.col
    rows = strip.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(c("n") * c("g")).over(upto), "all": F.sum("n").over(every), "sum": F.sum(c("n") * c("g")).over(every)})
    apart = (c("sum").cast("double") * c("n0") - c("s0").cast("double") * c("all")) / c("all")
    between = F.when(c("n0") < c("all"), apart * apart / (c("n0").cast("double") * (c("all") - c("n0")))).otherwise(0.0)
    best = rows.groupBy("image_id").agg(F.min(F.struct((-between).alias("by"), "g", "n0", "all")).alias("x"))
    return best.select("image_id", c("x.g").alias("threshold"), ((c("x.all") - c("x.n0")) / c("x.all")).alias("light"))


def place_of(values: Column, share: float) -> Column:
    """The value at a share of the way through a sorted array, by its index: half for the median. Null if it is empty."""
    return F.try_element_at(F.array_sort(values), whole(F.size(values) * share) + 1)
