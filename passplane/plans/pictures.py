"""Queries on large pictures: measures of pixels, from blocks and filters to scores.

A picture has 130 rows of 200 places and comes from ten vectors of the table, each of which gives 13 rows: a level by picture
and place, and the vector's components as grain whose strength differs by picture and half. Some pictures are dots on a grid,
scattered dots, one bright corner with grain elsewhere, or grain in every other block.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.operators import measures, raster
from passplane.plans.derived import CODES, type_of
from passplane.sources.tables import table

WIDE, ROWS = 200, 13
HIGH = 10 * ROWS

#: Both engines read these; {e} is the element of the vector, i the picture, {x} and {y} the place, c the channel.
_E = "8 * CAST({e} AS DOUBLE)"
_LEVEL = "90 + 25 * (i % 7) + 10 * ((CAST(floor({x} / 34.0) AS INT) + CAST(floor({y} / 25.0) AS INT)) % 2) * (i % 2)"
_GRAIN = "(0.02 + 9 * (i % 4) * (1 + (CAST(floor({x} / 64.0) AS INT) % 2) * (i % 5)))"
_KINDS = (
    f"CASE WHEN i % 8 = 3 THEN CASE WHEN {{x}} % 20 = 0 AND {{y}} % 20 = 0 THEN 200 + 20 * {_E} ELSE 0 END WHEN i % 8 = 7 THEN CASE WHEN {_E} > 2.2 THEN 255 ELSE 0 END "
    f"WHEN i % 6 = 5 THEN 60 + CASE WHEN {{x}} < 16 AND {{y}} < 16 THEN 140 ELSE 0 END + CASE WHEN {{x}} BETWEEN 128 AND 183 AND {{y}} < 64 THEN 20 ELSE 0 END * {_E} "
    f"WHEN i % 8 = 6 THEN 120 + 25 * ((CAST(floor({{x}} / 16.0) AS INT) + CAST(floor({{y}} / 16.0) AS INT)) % 2) * {_E} ELSE {_LEVEL} + {_GRAIN} * {_E} END"
)
_GREY = f"CAST(least(255, greatest(0, floor({_KINDS} + 0.5))) AS INT)"
_PLACE = "({x} * 3 + {y} * 5 + {c} * (i % 3)) % 64"


#: At most so many vectors, a tenth as many pictures, are one task's, so that sorts of pixels stay in memory at any size of the table.
VECTORS_A_TASK = 320


def _at(element: str, channel: int, x: str = "x", y: str = "y") -> str:
    return _GREY.format(e=element.format(p=_PLACE.format(c=channel, x=x, y=y)), x=x, y=y)


def plain(expression: str) -> str:
    """The same for Spark without decimals: these are slow, and make methods so long that the JVM does not compile them."""
    whole = re.sub(r"floor\((\{?\w\}?) / (\d+)\.0\)", r"\1 div \2", expression)
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", whole)


def _points(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """(i, v, y, x, height, width, keep): every place of a picture with its vector; keep: from image_id, height and width, found once a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.expr("CAST(vec_id div 10 AS LONG)").alias("i"), F.col("embedding").alias("v"), (F.col("vec_id") % 10).cast("int").alias("k"))
    # vectors meet by picture before they become pixels, so no pixel is shuffled; a number keeps the few vectors from being put together
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    apart = vectors.repartition(max(least, -(-vectors.count() // VECTORS_A_TASK)), "i")
    own = apart.withColumns({"height": (F.max("k").over(Window.partitionBy("i")) + 1) * ROWS, "width": F.lit(WIDE), "image_id": F.col("i")}).select("i", "v", "k", "height", "width", *keep)
    names = [c for c in own.columns if c != "k"]
    rows = own.select(*names, "k", F.explode(F.sequence(F.lit(0), F.lit(WIDE * ROWS - 1))).alias("p"))
    return rows.select(*names, (F.col("k") * ROWS + F.expr(f"p div {WIDE}").cast("int")).alias("y"), (F.col("p") % WIDE).alias("x"))


#: What Spark finds once a vector: which kind its picture is, and the numbers that its level, grain and shift follow from.
_OF_PICTURE = {
    "_kind": "CASE WHEN i % 8 IN (3, 7) THEN i % 8 WHEN i % 6 = 5 THEN 5 WHEN i % 8 = 6 THEN 6 ELSE 0 END",
    "_level": "90 + 25 * (i % 7)", "_odd": "10 * (i % 2)", "_grain": "9 * (i % 4)", "_more": "i % 5", "_shift": "i % 3",
}
#: The value of _KINDS as a level and how much of the element is added; scattered dots (kind 7) are apart.
_BASE = (
    "CASE _kind WHEN 3 THEN CASE WHEN x % 20 = 0 AND y % 20 = 0 THEN 200 ELSE 0 END WHEN 5 THEN 60 + CASE WHEN x < 16 AND y < 16 THEN 140 ELSE 0 END WHEN 6 THEN 120 "
    "ELSE _level + _odd * ((x div 34 + y div 25) % 2) END"
)
_SHARE = (
    "CASE _kind WHEN 3 THEN CASE WHEN x % 20 = 0 AND y % 20 = 0 THEN 20D ELSE 0D END WHEN 5 THEN CASE WHEN x BETWEEN 128 AND 183 AND y < 64 THEN 20D ELSE 0D END "
    "WHEN 6 THEN CAST(25 * ((x div 16 + y div 16) % 2) AS DOUBLE) ELSE 0.02D + _grain * (1 + (x div 64 % 2) * _more) END"
)
_VALUE = "CAST(least(255, greatest(0, floor(CASE WHEN _kind = 7 THEN CASE WHEN {e} > 2.2D THEN 255D ELSE 0D END ELSE _base + _share * {e} END + 0.5D))) AS INT)"


def _channels(spark: SparkSession, sf_dir: str, names: str, keep: tuple[Column, ...]) -> DataFrame:
    """Grey values by name, those of _KINDS: the first from the vector's own places, the next from shifted ones. What channels share is found once a pixel, so that
    the JVM compiles the method of a pixel."""
    points = _points(spark, sf_dir, *[F.expr(f"CAST({e} AS INT)").alias(n) for n, e in _OF_PICTURE.items()], *keep)
    kept = [F.col("i").alias("image_id"), "y", "x", *[c for c in points.columns if c not in ("i", "v", "y", "x", *_OF_PICTURE)]]
    place = "8 * CAST(v[CAST((x * 3 + y * 5 + {c} * _shift) % 64 AS INT)] AS DOUBLE)"
    read = points.select("*", F.expr(_BASE).alias("_base"), F.expr(_SHARE).alias("_share"), *[F.expr(place.format(c=c)).alias(f"_{n}") for c, n in enumerate(names)])
    return read.select(*kept, *[F.expr(_VALUE.format(e=f"_{n}")).alias(n) for n in names])


def pixels(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """(image_id, y, x, height, width, keep, g) of the large pictures."""
    return _channels(spark, sf_dir, "g", keep)


def colours(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """(image_id, y, x, height, width, keep, b, g, r): every third picture is grey, the others have shifted grain in each channel."""
    return _channels(spark, sf_dir, "bgr", keep)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, grey): each picture as one array. Its ten vectors meet; no pixel is shuffled."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("CAST(vec_id div 10 AS LONG)").alias("i"), F.col("embedding").alias("v"), (F.col("vec_id") % 10).cast("int").alias("k"))
    x, y = f"(p % {WIDE})", f"(k * {ROWS} + CAST(p div {WIDE} AS INT))"
    grey = plain(_GREY).format(e=f"v[{_PLACE.format(x=x, y=y, c=0)}]", x=x, y=y)
    part = F.expr(f"transform(sequence(0, {WIDE * ROWS - 1}), p -> {grey})")
    held = rows.select("i", F.struct("k", part.alias("part")).alias("s")).groupBy("i").agg(F.array_sort(F.collect_list("s")).alias("parts"))
    return held.select(F.col("i").alias("image_id"), F.lit(WIDE).alias("width"), F.flatten(F.transform("parts", lambda s: s["part"])).alias("grey"))


def _rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n, t in rows.dtypes if t == "double"})


def _measure(of: Callable[[DataFrame], DataFrame], source: Callable[[SparkSession, str], DataFrame] = pixels) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(of(source(spark, sf_dir)))


def _kernel(name: str) -> Callable[[SparkSession, str], DataFrame]:
    kernel, fields = raster.KERNELS[name]
    return lambda spark, sf_dir: _rounded(raster.per_image(pictures(spark, sf_dir), kernel, fields))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, quality, y, x, e): what a coarser grey scale changes, more in one corner of every fifth picture."""
    more = F.when((F.col("image_id") % 5 == 0) & (F.col("y") < 24) & (F.col("x") < 34), 40).otherwise(0)
    steps = F.explode(F.array(*[F.lit(q) for q in (4, 6, 8)])).alias("quality")
    return pixels(spark, sf_dir).select("image_id", "y", "x", "height", "width", "g", steps).select("image_id", "quality", "y", "x", "height", "width", (F.sqrt(F.lit(3.0)) * (F.col("g") % F.col("quality") + more)).alias("e"))


def _zone() -> Column:
    """The portrait: around a face in every other picture, else by the type."""
    face = F.struct(F.lit(50).alias("x"), (F.col("image_id") % 30 + 20).cast("int").alias("y"), F.lit(30).alias("w"), F.lit(20).alias("h"))
    return measures.portrait(F.col("width"), F.col("height"), type_of("image_id"), F.when(F.col("image_id") % 2 == 0, face))


def q_portrait_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the portrait is, around a face or by the type."""
    sides = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"))
    return sides.select("image_id", _zone().alias("z")).select("image_id", *[F.col(f"z.{c}").alias(c) for c in "xywh"])


def q_noise_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps between neighbouring blocks of the local noise."""
    return _rounded(raster.boundaries(measures.noise_map(pixels(spark, sf_dir))))


def q_clone_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a picture that are nearly the same."""
    return _rounded(raster.clone_score(measures.clone_blocks(pixels(spark, sf_dir))))


def q_grain_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 80 % place, by index, of each picture's first row."""
    rows = pixels(spark, sf_dir).where("y = 0").groupBy("image_id").agg(F.collect_list("g").alias("all"))
    return rows.select("image_id", measures.place_of(F.col("all"), 0.5).alias("median"), measures.place_of(F.col("all"), 0.8).alias("p80"))


def q_recapture_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of measured pictures joined by picture: flat texture, light and screen, and the least of them."""
    grey, colour = pixels(spark, sf_dir), colours(spark, sf_dir)
    parts = {"flat": measures.flat_texture(grey), "backlight": measures.backlight(grey), "screen": measures.screen(colour)}
    joined = None
    for name, found in parts.items():
        own = found.select("image_id", F.col("score").alias(name))
        joined = own if joined is None else joined.join(own, "image_id")
    return _rounded(joined.withColumn("lowest", F.least(*parts)))


QUERIES = {f.__name__: f for f in (q_portrait_zone, q_noise_boundary, q_clone_picture, q_grain_places, q_recapture_picture)}
QUERIES |= {
    "q_kernel_sharpness": _measure(measures.sharpness), "q_kernel_noise": _measure(measures.noise_consistency), "q_kernel_flat": _measure(measures.flat_texture), "q_backlight_cv": _measure(measures.backlight),
    "q_kernel_otsu": _measure(measures.zone_threshold), "q_margin": _measure(measures.margin), "q_screen": _measure(measures.screen, colours), "q_portrait_features": _measure(lambda c: measures.portrait_features(c, apart=True), colours),
    "q_error_level": _measure(lambda e: measures.error_level(e.where("quality = 8").drop("quality")), _errors), "q_error_outliers": _measure(measures.consistent_outliers, _errors),
    "q_border_noise": _measure(lambda p: measures.border_noise(p, F.col("zone")), lambda spark, sf_dir: pixels(spark, sf_dir, _zone().alias("zone"))),
}
QUERIES |= {f"q_kernel_{n}": _kernel(n) for n in raster.KERNELS}

# The same in DuckDB's SQL: filters are windows too; tests of the operators compare with plain loops.

_POINTS = f"pt AS (SELECT vec_id // 10 AS i, (vec_id % 10)::INT AS k, p, ((vec_id % 10) * {ROWS} + p // {WIDE})::INT AS y, (p % {WIDE})::INT AS x, embedding AS v FROM embeddings, unnest(generate_series(0, {WIDE * ROWS - 1})) AS t(p))"
_PX = f"WITH {_POINTS}, px AS (SELECT i AS image_id, y, x, {_at('v[{p} + 1]', 0)} AS g, max(y) OVER (PARTITION BY i) + 1 AS h, {WIDE} AS w FROM pt)"
_CX = f"WITH {_POINTS}, cx AS (SELECT i AS image_id, y, x, " + ", ".join(f"{_at('v[{p} + 1]', c)} AS {n}" for c, n in enumerate("bgr")) + f", max(y) OVER (PARTITION BY i) + 1 AS h, {WIDE} AS w FROM pt)"


def _mirror(place: str, low: str, n: str) -> str:
    """A place mirrored into [low, low + n)."""
    return f"({low} + ({n} - 1) - abs(({n} - 1) - abs({place} - ({low}))))"


def _filter(source: str, out: str, value: str, taps: dict[int, int], axis: str, low: str, n: str, keep: str = "") -> str:
    """A CTE of weighted sums along an axis, mirrored where [low, low + n) ends; low may use p, the pixel."""
    other = "y" if axis == "x" else "x"
    kept = "".join(f", p.{c}" for c in keep.split())
    v = f"p.{value}"
    far = lambda own, near, back: f"coalesce({own}({v}, 2) OVER l, CASE WHEN {near}({v}, 1) OVER l IS NULL THEN {back}({v}, 2) OVER l END, {v})"
    places = {-2: far("lag", "lag", "lead"), -1: f"coalesce(lag({v}, 1) OVER l, lead({v}, 1) OVER l, {v})", 0: v, 1: f"coalesce(lead({v}, 1) OVER l, lag({v}, 1) OVER l, {v})", 2: far("lead", "lead", "lag")}
    total = " + ".join(f"{w} * {places[o]}" for o, w in taps.items())
    del n
    return f"{out} AS (SELECT p.image_id, p.y, p.x{kept}, {total} AS v FROM {source} p WINDOW l AS (PARTITION BY p.image_id, p.{other}, {low} ORDER BY p.{axis}))"


def _wide(source: str, out: str, value: str, weights: str, size: int, axis: str) -> str:
    """CTEs of a wide filter: each row or column as a mirrored list, each place as the product of a part of it."""
    r, other = size // 2, "y" if axis == "x" else "x"
    return (
        f"{out}_l AS (SELECT image_id, {other}, list({value}::DOUBLE ORDER BY {axis}) AS l FROM {source} GROUP BY 1, 2), {out}_m AS (SELECT image_id, {other}, len(l) AS n, list_concat(list_concat(list_reverse(l[2:{r + 1}]), l), list_reverse(l[len(l) - {r}:len(l) - 1])) AS m FROM {out}_l), "
        f"{out} AS (SELECT image_id, {other}, t.a::INT AS {axis}, list_dot_product(m[t.a + 1:t.a + {size}], {weights}::DOUBLE[]) AS v FROM {out}_m, unnest(generate_series(0, n - 1)) AS t(a))"
    )


_FIVE, _THREE = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}, {-1: 1, 0: 2, 1: 1}
_KEEP = "g h w"


def _soft(source: str, taps: dict[int, int], lx: str = "0", nx: str = "p.w", ly: str = "0", ny: str = "p.h") -> str:
    total = sum(taps.values()) ** 2
    first = _filter(source, "f1", "g", taps, "x", lx, nx, _KEEP)
    second = _filter("f1", "f2", "v", taps, "y", ly, ny, _KEEP)
    return f"{first}, {second}, soft AS (SELECT image_id, y, x, g, h, w, floor(v / {total}.0::DOUBLE + 0.5)::INT AS soft FROM f2)"


def _inner(size: int) -> str:
    return f"(y // {size} + 1) * {size} < h AND (x // {size} + 1) * {size} < w"


def _r(name: str, alias: str | None = None) -> str:
    return f"round({name}, 6)::DOUBLE AS {alias or name}"


def _spread(source: str, score: str) -> str:
    """(image_id, mean, ratio, score) of the blocks (image_id, ok, m)."""
    return f"r AS (SELECT image_id, avg(m) FILTER (ok) AS mean, max(m) FILTER (ok) - min(m) FILTER (ok) AS span FROM {source} GROUP BY 1), s AS (SELECT image_id, mean, CASE WHEN mean > 0 THEN span / mean ELSE 0.0::DOUBLE END AS ratio FROM r) SELECT image_id, {_r('mean')}, {_r('ratio')}, {_r(score, 'score')} FROM s"


_LOCAL = ("(p.x // {n}) * {n}", "least({n}, p.w - (p.x // {n}) * {n})", "(p.y // {n}) * {n}", "least({n}, p.h - (p.y // {n}) * {n})")


def _local(size: int) -> tuple[str, ...]:
    return tuple(t.format(n=size) for t in _LOCAL)


_LX, _NX, _LY, _NY = _local(32)
_SHARP = (
    f"{_PX}, pv AS (SELECT * FROM px WHERE {_inner(32)}), {_filter('pv', 'dx', 'g', {-1: -1, 1: 1}, 'x', _LX, '32', _KEEP)}, {_filter('dx', 'gx', 'v', _THREE, 'y', _LY, '32')}, {_filter('pv', 'sx', 'g', _THREE, 'x', _LX, '32', _KEEP)}, {_filter('sx', 'gy', 'v', {-1: -1, 1: 1}, 'y', _LY, '32')}, "
    "b AS (SELECT gx.image_id, gx.y // 32 AS by, gx.x // 32 AS bx, true AS ok, avg(sqrt((gx.v * gx.v + gy.v * gy.v)::DOUBLE)) AS m FROM gx JOIN gy USING (image_id, y, x) GROUP BY 1, 2, 3), "
)
_BLOCKS_OF = "b AS (SELECT image_id, y // {n} AS by, x // {n} AS bx, bool_and((y // {n} + 1) * {n} < h AND (x // {n} + 1) * {n} < w) AS ok, {m} FROM soft GROUP BY 1, 2, 3), "
_CELL = "CASE WHEN x // {bw} < 4 AND y // {bh} < 4 THEN (y // {bh}) * 4 + x // {bw} END"
_ZONE_SQL = "CASE WHEN {i} % 2 = 0 THEN {f} ELSE {t} END"
_KIND = f"CASE WHEN image_id % 14 = {CODES.index('COL_CC_OLD')} THEN 1 WHEN image_id % 14 = {CODES.index('COL_PA')} THEN 2 ELSE 0 END"


def _zone_of(source: str) -> str:
    """CTEs that add zx, zy, zw, zh to rows with image_id, h and w."""
    share = lambda k: f"CASE {_KIND} WHEN 1 THEN {measures.PORTRAIT['COL_CC_OLD'][k]} WHEN 2 THEN {measures.PORTRAIT['COL_PA'][k]} ELSE {measures.PORTRAIT['CARD'][k]} END::DOUBLE"
    even = "image_id % 2 = 0"
    return (
        f"z1 AS (SELECT *, CASE WHEN {even} THEN 50 - 12 ELSE trunc({share(0)} * w)::INT END AS ax, CASE WHEN {even} THEN (image_id % 30 + 20) - 11 ELSE trunc({share(1)} * h)::INT END AS ay, CASE WHEN {even} THEN 54 ELSE trunc({share(2)} * w)::INT END AS aw, CASE WHEN {even} THEN 52 ELSE trunc({share(3)} * h)::INT END AS ah FROM {source}), "
        "z2 AS (SELECT * EXCLUDE (ax, ay), greatest(0, least(ax, w - 2)) AS zx, greatest(0, least(ay, h - 2)) AS zy FROM z1), z AS (SELECT * EXCLUDE (aw, ah), greatest(2, least(aw, w - zx)) AS zw, greatest(2, least(ah, h - zy)) AS zh FROM z2)"
    )


_GREY_SQL = "((b * 114 + g * 587 + r * 299 + 500) // 1000)::INT"
_PARTS = "CASE WHEN x >= zx + m AND x < zx + zw - m AND y >= zy + m AND y < zy + zh - m THEN 'inner' WHEN zx - m >= 0 AND x >= zx - m AND x < zx AND y >= zy AND y < zy + zh THEN 'left' WHEN zx + zw + m < w AND x >= zx + zw AND x < zx + zw + m AND y >= zy AND y < zy + zh THEN 'right' END"
_ER = f"{_PX}, er AS (SELECT image_id, q AS quality, y, x, h, w, sqrt(3.0::DOUBLE) * (g % q + CASE WHEN image_id % 5 = 0 AND y < 24 AND x < 34 THEN 40 ELSE 0 END) AS e FROM px, (VALUES (4), (6), (8)) AS t(q)), re AS (SELECT image_id, quality, (y // (h // 8)) * 8 + x // (w // 8) AS region, sum(round(e * 1000000)::HUGEINT)::HUGEINT AS s, any_value((h // 8) * (w // 8))::HUGEINT AS n FROM er WHERE y // (h // 8) < 8 AND x // (w // 8) < 8 GROUP BY 1, 2, 3)"
_MAP = f"{_PX}, pv AS (SELECT * FROM px WHERE x // 16 < w // 16 AND y // 16 < h // 16 AND w // 16 >= 4 AND h // 16 >= 4), {_soft('pv', _THREE, _local(16)[0], '16', _local(16)[2], '16')}, m AS (SELECT image_id, y // 16 AS y, x // 16 AS x, stddev_pop(abs(g - soft)) AS v FROM soft GROUP BY 1, 2, 3)"
_SIGNS = "(blue_green < 4 AND green_red < 3)::INT AS s1, (laplacian < 8)::INT AS s2, (banding < 5)::INT AS s3"
_SCREEN = (
    f"{_CX}, c AS (SELECT image_id, y, x, h, w, {_GREY_SQL} AS g, abs(b - g) AS bg, abs(g - r) AS gr FROM cx), "
    + _filter("c", "lx", "g", {-1: 1, 0: -4, 1: 1}, "x", "0", "p.w") + ", " + _filter("c", "ly", "g", {-1: 1, 1: 1}, "y", "0", "p.h") + ", "
    + _wide("c", "box", "g", "[" + ", ".join(["1"] * (WIDE - 1)) + "]", WIDE - 1, "x")
    + f", a AS (SELECT c.image_id, c.g <= 235 AS seen, bg, gr, lx.v + ly.v AS lap, abs(c.g - floor(box.v / {WIDE - 1}.0::DOUBLE + 0.5)::INT) AS band FROM c JOIN lx USING (image_id, y, x) JOIN ly USING (image_id, y, x) JOIN box USING (image_id, y, x)), d AS (SELECT image_id, count(*) FILTER (NOT seen) / count(*) AS glare, "
    + ", ".join(f"coalesce(stddev_pop({c}) FILTER (seen), 0) AS {n}" for c, n in (("bg", "blue_green"), ("gr", "green_red"), ("lap", "laplacian"), ("band", "banding")))
    + f" FROM a GROUP BY 1), e AS (SELECT *, {_SIGNS} FROM d) SELECT image_id, {_r('glare')}, {_r('blue_green')}, {_r('green_red')}, {_r('laplacian')}, {_r('banding')}, round(CASE WHEN glare > 0.40 THEN 0.85 ELSE greatest(0, 1 - s1 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.30 ELSE 0.08 END - s2 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.35 ELSE 0.10 END - s3 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.20 ELSE 0.08 END) END, 6)::DOUBLE AS score FROM e"
)
_FEATURES = (
    f"{_CX}, c AS (SELECT image_id, y, x, {_GREY_SQL} AS v, greatest(b, g, r) AS hi, CASE WHEN greatest(b, g, r) > 0 THEN floor((greatest(b, g, r) - least(b, g, r)) * 255.0::DOUBLE / greatest(b, g, r) + 0.5)::INT ELSE 0 END AS s FROM cx), "
    "t AS (SELECT image_id, y, x, v, lag(v) OVER o AS a, lead(v) OVER o AS z FROM c WINDOW o AS (PARTITION BY image_id, y ORDER BY x)), n AS (SELECT image_id, v, a, z, lag(a) OVER d AS ua, lag(v) OVER d AS uv, lag(z) OVER d AS uz, lead(a) OVER d AS da, lead(v) OVER d AS dv, lead(z) OVER d AS dz FROM t WINDOW d AS (PARTITION BY image_id, x ORDER BY y)), l AS (SELECT image_id, "
    + " + ".join(f"CASE WHEN {n} >= v THEN {1 << (7 - k)} ELSE 0 END" for k, n in enumerate(["ua", "uv", "uz", "z", "dz", "dv", "da", "a"]))
    + " AS code FROM n WHERE ua IS NOT NULL AND uz IS NOT NULL AND da IS NOT NULL AND dz IS NOT NULL), u AS (SELECT image_id, ["
    + ", ".join(map(str, raster.uniform_bins())) + "][code + 1] AS i FROM l), f AS (SELECT image_id, i, count(*) / sum(count(*)) OVER (PARTITION BY image_id) AS value FROM u GROUP BY 1, 2 UNION ALL SELECT image_id, 59 + s // 32, count(*) / sum(count(*)) OVER (PARTITION BY image_id) FROM c GROUP BY 1, 2 UNION ALL SELECT image_id, 67 + hi // 32, count(*) / sum(count(*)) OVER (PARTITION BY image_id) FROM c GROUP BY 1, 2"
    + "".join(f" UNION ALL SELECT image_id, {i}, {f}({c}) / 255 FROM c GROUP BY 1" for i, (f, c) in enumerate([("avg", "s"), ("stddev_pop", "s"), ("avg", "hi"), ("stddev_pop", "hi")], 79))
    + f") SELECT image_id, i::INT AS i, {_r('value')} FROM f WHERE value <> 0"
)
_WEIGHTS = str(raster.soft_weights(51).tolist())

SQL = {
    "q_kernel_sharpness": _SHARP + _spread("b", "CASE WHEN mean IS NULL THEN 0.85 WHEN ratio < 1.5 AND mean < 25 THEN greatest(0.3::DOUBLE, ratio / 1.5) ELSE 1.0 END"),
    "q_kernel_noise": f"{_PX}, {_soft('px', _FIVE)}, " + _BLOCKS_OF.format(n=64, m="stddev_pop(greatest(g - soft, 0)) AS m") + _spread("b", "CASE WHEN mean IS NULL THEN 0.85 WHEN ratio > 4 THEN greatest(0.2::DOUBLE, 1 - (ratio - 4) / 8) ELSE 1.0 END"),
    "q_kernel_flat": f"{_PX}, {_soft('px', _FIVE)}, " + _BLOCKS_OF.format(n=24, m="avg(soft) AS m, stddev_pop(soft) AS s") + f"f AS (SELECT image_id, count(*) FILTER (ok AND m > 155 AND s < 30) AS blocks, avg(s) FILTER (ok AND m > 155 AND s < 30) AS grain FROM b GROUP BY 1) SELECT image_id, blocks, {_r('grain')}, {_r('CASE WHEN blocks >= 6 AND grain < 2.5 THEN greatest(0.05::DOUBLE, grain / 2.5) ELSE 1.0 END', 'score')} FROM f",
    "q_backlight_cv": f"{_PX}, a AS (SELECT image_id, avg(g) AS m, y // (h // 4) AS gy, x // (w // 4) AS gx FROM px WHERE y // (h // 4) < 4 AND x // (w // 4) < 4 GROUP BY 1, 3, 4), k AS (SELECT image_id, y - trunc(h * 0.15::DOUBLE)::INT AS y, x - trunc(w * 0.15::DOUBLE)::INT AS x, h - 2 * trunc(h * 0.15::DOUBLE)::INT AS ch, w - 2 * trunc(w * 0.15::DOUBLE)::INT AS cw, g FROM px), b AS (SELECT image_id, avg(g) AS m, y // (ch // 4) AS gy, x // (cw // 4) AS gx FROM k WHERE y BETWEEN 0 AND (ch // 4) * 4 - 1 AND x BETWEEN 0 AND (cw // 4) * 4 - 1 GROUP BY 1, 3, 4), c AS (SELECT image_id, avg(m) AS mean_all, CASE WHEN avg(m) > 10 THEN stddev_pop(m) / avg(m) ELSE 1.0::DOUBLE END AS cv FROM a GROUP BY 1), d AS (SELECT image_id, avg(m) AS mean_centre, CASE WHEN avg(m) > 10 THEN stddev_pop(m) / avg(m) ELSE 1.0::DOUBLE END AS centre_cv FROM b GROUP BY 1) SELECT image_id, {_r('cv')}, {_r('centre_cv')}, {_r('CASE WHEN centre_cv < 0.08 AND mean_centre > 60 THEN greatest(0.15::DOUBLE, centre_cv / 0.08) WHEN cv < 0.07 AND mean_all > 50 THEN greatest(0.2::DOUBLE, cv / 0.07) ELSE 1.0 END', 'score')} FROM c JOIN d USING (image_id)",
    "q_kernel_otsu": f"{_PX}, n AS (SELECT image_id, g, count(*) AS n FROM px WHERE y >= trunc(h * 0.65::DOUBLE) GROUP BY 1, 2), t AS (SELECT l.image_id, l.g, sum(n.n) FILTER (n.g <= l.g)::DOUBLE AS n0, sum(n.n * n.g) FILTER (n.g <= l.g)::DOUBLE AS s0, sum(n.n)::DOUBLE AS a, sum(n.n * n.g)::DOUBLE AS s FROM n l JOIN n ON n.image_id = l.image_id GROUP BY 1, 2), b AS (SELECT *, CASE WHEN n0 < a THEN ((s * n0 - s0 * a) / a) * ((s * n0 - s0 * a) / a) / (n0 * (a - n0)) ELSE 0 END AS apart FROM t) SELECT image_id, g AS threshold, {_r('(a - n0) / a', 'light')} FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY apart DESC, g) = 1",
    "q_margin": f"{_PX}, b AS (SELECT image_id, stddev_pop(g) FILTER (x < trunc(w * 0.08::DOUBLE) OR x > w - trunc(w * 0.08::DOUBLE) OR y < trunc(h * 0.08::DOUBLE) OR y > h - trunc(h * 0.08::DOUBLE)) AS std FROM px GROUP BY 1) SELECT image_id, {_r('std')} FROM b",
    "q_screen": _SCREEN,
    "q_portrait_features": _FEATURES,
    "q_error_level": f"{_ER}, b AS (SELECT image_id, sum(s) AS total, max(s) AS top, sum(s * s) AS square, any_value(n) AS n FROM re WHERE quality = 8 GROUP BY 1), c AS (SELECT *, total::DOUBLE * {measures.AMPLIFY / measures.ERROR_PART}::DOUBLE / (n * 64)::DOUBLE AS mean, top::DOUBLE * {measures.AMPLIFY / measures.ERROR_PART}::DOUBLE / n::DOUBLE AS highest, sqrt((square * 64 - total * total)::DOUBLE) * {measures.AMPLIFY / measures.ERROR_PART}::DOUBLE / (n * 64)::DOUBLE AS std FROM b) SELECT image_id, {_r('mean')}, {_r('highest')}, {_r('std')}, {_r('CASE WHEN std > 80 OR top * 128 > total * 7 THEN greatest(0.1::DOUBLE, 1 - std / 200) ELSE 1.0 END', 'score')} FROM c",
    "q_error_outliers": f"{_ER}, m AS (SELECT image_id, quality, sum(s) AS total FROM re GROUP BY 1, 2), k AS (SELECT image_id, region, count(*) FILTER (total >= n * 32000000 AND s * 64 > total * 3) AS hits FROM re JOIN m USING (image_id, quality) GROUP BY 1, 2), o AS (SELECT image_id, count(*) FILTER (hits >= 3) AS outliers FROM k GROUP BY 1) SELECT image_id, outliers, {_r('CASE WHEN outliers >= 2 THEN greatest(0.10::DOUBLE, 1 - outliers * 0.12::DOUBLE) ELSE 1.0 END', 'score')} FROM o",
    "q_border_noise": (
        f"{_PX}, {_zone_of('px')}, zm AS (SELECT *, greatest(4, least(zw, zh) // 10) AS m FROM z), zp AS (SELECT *, {_PARTS} AS part FROM zm), pv AS (SELECT * FROM zp WHERE part IS NOT NULL), lim AS (SELECT image_id, part, min(x) AS x0, max(x) - min(x) + 1 AS nx, min(y) AS y0, max(y) - min(y) + 1 AS ny FROM pv GROUP BY 1, 2), "
        "pl AS (SELECT pv.image_id, pv.part, y, x, g, x0, nx, y0, ny FROM pv JOIN lim USING (image_id, part)), k(o, c) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)), "
        f"f1 AS (SELECT p.image_id, p.part, p.y, p.x, any_value(p.g) AS g, any_value(p.y0) AS y0, any_value(p.ny) AS ny, sum(k.c * q.g) AS v FROM pl p CROSS JOIN k JOIN pl q ON q.image_id = p.image_id AND q.part = p.part AND q.y = p.y AND q.x = {_mirror('p.x + k.o', 'p.x0', 'p.nx')} GROUP BY 1, 2, 3, 4), "
        f"f2 AS (SELECT p.image_id, p.part, p.y, p.x, any_value(p.g) AS g, sum(k.c * q.v) AS v FROM f1 p CROSS JOIN k JOIN f1 q ON q.image_id = p.image_id AND q.part = p.part AND q.x = p.x AND q.y = {_mirror('p.y + k.o', 'p.y0', 'p.ny')} GROUP BY 1, 2, 3, 4), "
        "n AS (SELECT image_id, part, stddev_pop(greatest(g - floor(v / 256.0::DOUBLE + 0.5), 0)) AS s FROM f2 GROUP BY 1, 2), a AS (SELECT image_id, coalesce(max(s) FILTER (part = 'inner'), 0) AS inner_, avg(s) FILTER (part <> 'inner') AS outer_ FROM n GROUP BY 1), e AS (SELECT *, (inner_ + 0.01::DOUBLE) / (outer_ + 0.01::DOUBLE) AS q FROM a) "
        f"SELECT image_id, {_r('inner_', chr(34) + 'inner' + chr(34))}, {_r('outer_', chr(34) + 'outer' + chr(34))}, {_r('CASE WHEN outer_ IS NULL THEN 0.85 WHEN q > 3.2 OR q < 0.30 THEN greatest(0, 1 - abs(ln(q)) / 2) ELSE 1 END', 'score')} FROM e"
    ),
    "q_portrait_zone": f"WITH s AS (SELECT vec_id AS image_id, {HIGH} AS h, {WIDE} AS w FROM embeddings), {_zone_of('s')} SELECT image_id, zx::INT AS x, zy::INT AS y, zw::INT AS w, zh::INT AS h FROM z",
    "q_noise_boundary": f"{_MAP}, p AS (SELECT a.image_id, a.v AS l, b.v AS r FROM m a JOIN m b ON b.image_id = a.image_id AND (b.y = a.y AND b.x = a.x + 1 OR b.x = a.x AND b.y = a.y + 1)), j AS (SELECT image_id, count(*) AS pairs, count(*) FILTER (greatest(l, r) > 0.5 AND abs(l - r) / greatest(l, r) > 0.70::DOUBLE) AS jumps FROM p GROUP BY 1) SELECT image_id, pairs, jumps, {_r('CASE WHEN jumps / pairs > 0.18::DOUBLE THEN greatest(0.1::DOUBLE, 1 - 3 * (jumps / pairs)) ELSE 1.0 END', 'score')} FROM j",
    "q_clone_picture": f"{_PX}, c AS (SELECT image_id, (y // 64) * ((w - 33) // 64 + 1) + x // 64 AS i, ((y % 64) // 4) * 8 + (x % 64) // 4 AS at, floor(sum(g) / 4 + 0.5) AS v FROM px WHERE (y // 64) * 64 + 32 < h AND (x // 64) * 64 + 32 < w AND y % 64 < 32 AND x % 64 < 32 AND y % 4 IN (1, 2) AND x % 4 IN (1, 2) GROUP BY 1, 2, 3), m AS (SELECT image_id, i, avg(v) AS m FROM c GROUP BY 1, 2), d AS (SELECT a.image_id, a.i AS a, b.i AS b, sum(((a.v > m.m) <> (b.v > m.m))::INT) AS distance FROM c a JOIN m ON m.image_id = a.image_id AND m.i = a.i JOIN c b ON b.image_id = a.image_id AND b.at = a.at AND b.i >= a.i + 2 GROUP BY 1, 2, 3), n AS (SELECT image_id, count(*) FILTER (distance <= 5) AS near FROM d GROUP BY 1), t AS (SELECT image_id, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM m GROUP BY 1) SELECT image_id, coalesce(near, 0) AS near, pairs, {_r('CASE WHEN coalesce(near, 0) / greatest(pairs, 1) > 0.05::DOUBLE THEN greatest(0.3::DOUBLE, 1 - 5 * (coalesce(near, 0) / greatest(pairs, 1))) ELSE 1.0 END', 'score')} FROM t LEFT JOIN n USING (image_id)",
    "q_grain_places": f"{_PX}, o AS (SELECT image_id, list_sort(list(g)) AS a FROM px WHERE y = 0 GROUP BY 1) SELECT image_id, a[len(a) // 2 + 1] AS median, a[trunc(len(a) * 0.8::DOUBLE)::INT + 1] AS p80 FROM o",
    "q_kernel_illumination": f"{_PX}, {_wide('px', 'i1', 'g', _WEIGHTS, 51, 'x')}, {_wide('i1', 'i2', 'v', _WEIGHTS, 51, 'y')}, i3 AS (SELECT image_id, y, x, max(y) OVER (PARTITION BY image_id) + 1 AS h, {WIDE} AS w, floor(v / 65536.0::DOUBLE + 0.5)::INT AS g FROM i2), {_filter('i3', 'dx', 'g', {-1: -1, 1: 1}, 'x', '0', 'p.w', 'h w')}, {_filter('dx', 'gx', 'v', _THREE, 'y', '0', 'p.h')}, {_filter('i3', 'sx', 'g', _THREE, 'x', '0', 'p.w', 'h w')}, {_filter('sx', 'gy', 'v', {-1: -1, 1: 1}, 'y', '0', 'p.h')}, a AS (SELECT image_id, sqrt((gx.v * gx.v + gy.v * gy.v)::DOUBLE) AS d FROM gx JOIN gy USING (image_id, y, x)), b AS (SELECT image_id, CASE WHEN avg(d) > 0 THEN stddev_pop(d) / avg(d) ELSE 0.0::DOUBLE END AS cv FROM a GROUP BY 1) SELECT image_id, {_r('cv')}, {_r('CASE WHEN cv > 2.5 THEN greatest(0.3::DOUBLE, 1 - (cv - 2.5) / 5) ELSE 1.0 END', 'score')} FROM b",
}


def _sole(name: str) -> str:
    """A query's SQL as a table of picture and score."""
    return f"(SELECT image_id, score FROM ({SQL[name]}))"


SQL["q_recapture_picture"] = f"SELECT image_id, f.score AS flat, b.score AS backlight, c.score AS screen, least(f.score, b.score, c.score) AS lowest FROM {_sole('q_kernel_flat')} f JOIN {_sole('q_backlight_cv')} b USING (image_id) JOIN {_sole('q_screen')} c USING (image_id)"
