"""Queries on pictures, analyzers and classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.operators import authenticity, raster, scoring, signals
from passplane.plans.derived import CAPTURES, CODES, PIXELS, captures, pixels, type_of
from passplane.sources.tables import table


def _six(rows: DataFrame, *names: str) -> DataFrame:
    """Rounds floats that are sums in no fixed order."""
    return rows.withColumns({n: F.round(n, 6) for n in names})


def q_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of 4 by 4 blocks."""
    return _six(raster.block_stats(pixels(spark, sf_dir), 4), "mean", "std")


def q_hist256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values of every picture."""
    return raster.histogram(pixels(spark, sf_dir))


def q_hist8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values in eight bins."""
    return raster.histogram(pixels(spark, sf_dir), 5)


def q_glare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burnt-out pixels."""
    return raster.glare(pixels(spark, sf_dir))


def q_dyn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic range."""
    return raster.dynamic_range(pixels(spark, sf_dir))


def q_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast."""
    return _six(raster.contrast(pixels(spark, sf_dir)), "std", "score")


def q_toner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toner grain in 4 by 4 blocks."""
    return raster.toner(pixels(spark, sf_dir), 4, 1)


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pictures: the channels are the grey values of three vectors."""
    grey = pixels(spark, sf_dir)
    picture = F.expr("image_id div 3")
    channel = lambda k: F.max(F.when(F.col("image_id") % 3 == k, F.col("g")))
    rows = grey.groupBy(picture.alias("picture"), "y", "x").agg(channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))
    return rows.where("b is not null and g is not null and r is not null").withColumnRenamed("picture", "image_id")


def q_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation of colour pictures."""
    return _six(raster.saturation_score(_colours(spark, sf_dir)), "mean", "std", "score")


def q_colour_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bluish light areas."""
    return _six(raster.colour_temperature(_colours(spark, sf_dir), 3), "difference", "score")


def q_colour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour profiles of pictures of three types."""
    kind = F.when(F.col("image_id") % 3 == 0, "COL_CC_OLD").when(F.col("image_id") % 3 == 1, "COL_CC_NEW").otherwise("COL_PA")
    return _six(raster.colour_profile(_colours(spark, sf_dir), kind), "hue", "sat", "val", "score")


_ZONE = (0.2, 0.25, 0.4, 0.5)


def q_photo_obscured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portraits that are covered; every other picture is darkened."""
    dark = _colours(spark, sf_dir).withColumns({c: (F.col(c) / F.when(F.col("image_id") % 2 == 0, 5).otherwise(1)).cast("int") for c in "bgr"})
    return _six(raster.obscured(dark, raster.photo_zone(F.lit(8), F.lit(8), *_ZONE)), "val", "sat")


def q_zone_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portraits whose colours differ from the document's."""
    return _six(raster.zone_colour(_colours(spark, sf_dir), raster.photo_zone(F.lit(8), F.lit(8), *_ZONE), F.lit(8), 1), "sat", "val", "score")


def q_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey values of negatives."""
    return raster.histogram(pixels(spark, sf_dir).withColumn("g", raster.inverted(F.col("g"))), 5)


def q_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of whole pictures."""
    found = pixels(spark, sf_dir).groupBy("image_id").agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"))
    return _six(found, "mean", "std")


def q_splice_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps between neighbours of a noise map."""
    noise = pixels(spark, sf_dir).select("image_id", "y", "x", (F.col("g") / 64.0).alias("v"))
    return raster.boundaries(noise)


def q_lbp_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local binary patterns."""
    return raster.lbp_histogram(pixels(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 50 blocks; each vector is a block."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("image_id"), (F.col("vec_id") % 50).alias("i"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 4)).alias("g"))


def q_clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near blocks."""
    return raster.similar_blocks(_blocks(spark, sf_dir), 22)


def q_clone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone scores of pictures."""
    return raster.clone_score(_blocks(spark, sf_dir), 22)


def q_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of pictures against a card's."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(raster.aspect_score(F.lit(1000.0), F.col("p_size") * 25.0), 9).alias("score"))


def q_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rectangle of each brand."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("w"), (F.col("p_partkey") % 9).alias("h"))
    return raster.largest(rows, ["p_brand"])


def q_classifier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that the montage classifier looks at."""
    rows = captures(spark, sf_dir).withColumn("document_type", type_of("session_id"))
    return rows.where(authenticity.classifier_applies(F.col("document_type"), F.col("side"))).select("session_id", "side")


# Scores of analyzers, made from a part's number.
_SIGNALS = {"moire": 7, "screen": 11, "flat": 13, "backlight": 17, "colour": 19, "background": 23, "sharpness": 29, "perspective": 31, "glare": 37, "saturation": 41, "halftone": 43, "toner": 47, "dynamic_range": 53, "border": 59, "zone_ela": 61, "ring": 67, "ela": 71, "multi_ela": 73, "photo": 79, "noise": 83, "illumination": 89, "clone": 97, "splice": 101, "aspect": 103, "contrast": 107}


def _signal(p: int) -> str:
    return f"CAST((p_partkey * {p} + {p}) % 101 AS DOUBLE) / 100"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[F.expr(_signal(p)).alias(n) for n, p in _SIGNALS.items()], F.expr("(p_partkey * 7) % 900").alias("diagonals"), (F.col("p_partkey") % 4 == 0).alias("is_passport"))


def _combiner(score: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _signals(spark, sf_dir).select("p_partkey", F.round(score(), 9).alias("score"))


def q_signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of signals from their measures."""
    c = F.col
    found = {
        "ela": signals.error_level(c("ela") * 120, c("photo") * 200, c("noise") * 50), "outliers": signals.consistent_outliers(F.floor(c("multi_ela") * 12)), "face_ring": signals.face_ring(c("ring") / 4),
        "border": signals.border_noise(c("border") * 4, c("clone") * 4), "zone_ela": signals.zone_error_level(c("zone_ela") * 9, c("splice") * 9), "background": signals.background(c("background") / 3, c("contrast") * 130),
        "perspective": signals.perspective(F.floor(c("moire") * 5), F.floor(c("screen") * 5), F.floor(c("flat") * 9)), "screen": signals.screen(c("colour") * 9, c("glare") * 9, c("sharpness") * 20, c("toner") * 12),
    }
    return _signals(spark, sf_dir).select("p_partkey", *[F.round(v, 9).alias(n) for n, v in found.items()])


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    pair = lambda name, c: F.struct(F.lit(name).alias("analyzer"), F.col(c).alias("score"))
    each = F.array(pair("RECAPTURE_DETECTION", "moire"), pair("PHOTOCOPY_DETECTION", "screen"), pair("TAMPERING_DETECTION", "flat"), pair("DOCUMENT_STRUCTURE", "backlight"), pair("OTHER", "colour"))
    return rows.select("p_partkey", "is_passport", F.inline(each))


def q_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face scores from analyzers, with their vetoes."""
    rows = authenticity.combine(_checks(spark, sf_dir), ["p_partkey"])
    return rows.select("p_partkey", F.round("side_score", 9).alias("side_score"), "veto")


def q_passport_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of passport fronts with their zones, and what a montage leaves of them."""
    rows = authenticity.combine(_checks(spark, sf_dir), ["p_partkey"]).withColumn("kind", F.col("p_partkey") % 4)
    mrz = F.when(F.col("kind") == 0, 1.0).when(F.col("kind") == 3, 0.1).otherwise(0.4)
    blend = authenticity.passport_blend(F.col("side_score"), mrz, F.col("kind") != 3, F.col("kind") == 2)
    return rows.select("p_partkey", F.round(authenticity.final_score(blend, F.col("p_partkey") % 5 == 0), 3).alias("score"))


def q_l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length 1: their first component and length."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scoring.unit_length(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v), 6).alias("squared"))


_W = "CAST(i % 7 AS DOUBLE) / 7 - 0.4"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.expr(f"transform(sequence(1, 64), i -> {_W})")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), scoring.decision(F.col("embedding"), weights, F.lit(0.1)).alias("value"))
    return rows.withColumn("predicted", (F.col("value") > 0).cast("int"))


def q_svm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a linear machine."""
    return _decided(spark, sf_dir).select("vec_id", F.round("value", 6).alias("value"), "predicted")


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its confusion matrix, by the vectors' number modulo 3."""
    return scoring.confusion(_decided(spark, sf_dir).withColumn("fold", F.col("vec_id") % 3), ["fold"], "label", "predicted")


#: The weights of class 1 that are compared.
CLASS_WEIGHTS = [1.0, 2.0, 3.0, 5.0, 8.0, 11.4]


def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of held-out vectors under each weight of class 1, and the share of right ones; machines of Spark's trainer."""
    # the rarer class leans to one side of the vectors' space; every seventeenth label is turned round
    truth = F.expr("embedding[0] + embedding[1] + embedding[2] + embedding[3] > 0.25").cast("int")
    label = F.when(F.col("vec_id") % 17 == 0, 1 - truth).otherwise(truth)
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("vec"), label.alias("label"))
    found = scoring.confusion(scoring.leave_out(samples, CLASS_WEIGHTS, folds=2, steps=20), ["class_weight"], "label", "predicted")
    right, every = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return found.withColumn("score", F.round(right / every, 6))


def q_checks_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON read as structs; malformed text is null."""
    stored = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct((F.col("event_id") % 100 / 100).alias("score"), (F.col("event_id") % 2 == 0).alias("veto"))))
    parsed = F.from_json(stored, "score double, veto boolean")
    return table(spark, sf_dir, "events").select("event_id", parsed["score"].alias("score"), parsed["veto"].alias("veto"))


def q_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (q_block_stats, q_hist256, q_hist8, q_glare, q_dyn_range, q_contrast, q_toner, q_saturation, q_colour_temperature, q_colour_profile, q_photo_obscured, q_zone_colour, q_invert, q_moments, q_splice_boundary, q_lbp_hist, q_clone_pairs, q_clone_score, q_aspect, q_largest, q_classifier_gate, q_signal_scores, q_weighted_score, q_passport_blend, q_l2_norm, q_svm_score, q_confusion, q_class_weights, q_checks_json, q_sha256)}
QUERIES |= {"q_structure_score": _combiner(lambda: authenticity.structure()), "q_photocopy_score": _combiner(lambda: authenticity.photocopy()), "q_recapture_score": _combiner(lambda: authenticity.recapture()), "q_photo_zone_score": _combiner(lambda: authenticity.photo_zone()), "q_tampering_score": _combiner(lambda: authenticity.tampering(F.col("is_passport")))}

_S = "s AS (SELECT p_partkey, p_partkey % 4 = 0 AS is_passport, (p_partkey * 7) % 900 AS diagonals, " + ", ".join(f"{_signal(p)} AS {n}" for n, p in _SIGNALS.items()) + " FROM part)"


def _sum(parts: dict[str, float]) -> str:
    return " + ".join(f"{n} * {w}::DOUBLE" for n, w in parts.items())


def _capped(score: str, caps: list[tuple[str, str]]) -> str:
    return f"WITH {_S} SELECT p_partkey, round(least({score}, " + ", ".join(f"CASE WHEN {w} THEN {c}::DOUBLE ELSE 9 END" for w, c in caps) + "), 9) AS score FROM s"


_TAMPER = [("ela", 0.20, 0.20), ("multi_ela", 0.20, 0.15), ("photo", 0.25, 0.15), ("noise", 0.15, 0.20), ("illumination", 0.10, 0.15), ("clone", 0.05, 0.05), ("splice", 0.05, 0.10)]
_CHECKS = f"{_S}, c AS (SELECT p_partkey, is_passport, unnest([1, 2, 3, 4, 5]) AS k, unnest([moire, screen, flat, backlight, colour]) AS score FROM s), w AS (SELECT *, CASE WHEN k <= 2 THEN 0.30 WHEN k <= 4 THEN 0.35 ELSE 0.25 END::DOUBLE AS w, k <= 3 AND score < CASE WHEN is_passport THEN 0.35 ELSE 0.60 END AS low FROM c), f AS (SELECT p_partkey, least(sum(score * w) / sum(w), coalesce(min(CASE WHEN low THEN score + CASE WHEN is_passport THEN 0.0 ELSE 0.05 END END), 9)) AS side_score, bool_or(low) AS veto FROM w GROUP BY 1)"
_MEANS = f"WITH {PIXELS}"
_COLOURS = f"{PIXELS}, colours AS (SELECT image_id // 3 AS image_id, y, x, max(CASE WHEN image_id % 3 = 0 THEN g END) AS b, max(CASE WHEN image_id % 3 = 1 THEN g END) AS g, max(CASE WHEN image_id % 3 = 2 THEN g END) AS r FROM pixels GROUP BY 1, 2, 3 HAVING b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL)"
_BINS = "[" + ", ".join(map(str, raster.uniform_bins())) + "]"
_PAIRS = "b AS (SELECT vec_id // 50 AS image_id, vec_id % 50 AS i, list_transform(embedding, lambda e: floor(e::DOUBLE * 4)) AS g FROM embeddings), m AS (SELECT *, list_sum(g) / 64 AS m FROM b), p AS (SELECT m.image_id, m.i AS a, b.i AS b, list_sum(list_transform(generate_series(1, 64), lambda k: ((m.g[k] > m.m) <> (b.g[k] > m.m))::INT))::INT AS distance FROM m JOIN b ON m.image_id = b.image_id AND b.i >= m.i + 2), n AS (SELECT * FROM p WHERE distance <= 22)"

SQL = {
    "q_block_stats": f"{_MEANS} SELECT image_id, (y // 4)::INT AS by, (x // 4)::INT AS bx, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std FROM pixels GROUP BY 1, 2, 3",
    "q_hist256": f"{_MEANS} SELECT image_id, g AS bin, count(*) AS n FROM pixels GROUP BY 1, 2",
    "q_hist8": f"{_MEANS} SELECT image_id, (g // 32)::INT AS bin, count(*) AS n FROM pixels GROUP BY 1, 2",
    "q_glare": f"{_MEANS}, a AS (SELECT image_id, count(*) FILTER (g > 250) / count(*) AS bright FROM pixels GROUP BY 1) SELECT *, CASE WHEN bright > 0.08 THEN greatest(0.3::DOUBLE, 1 - 4 * bright) ELSE 1.0::DOUBLE END AS score FROM a",
    "q_dyn_range": f"{_MEANS}, a AS (SELECT image_id, count(*) FILTER (g < 50 OR g >= 206) / count(*) AS extreme, count(*) FILTER (g BETWEEN 80 AND 175) / count(*) AS middle FROM pixels GROUP BY 1) SELECT *, CASE WHEN extreme > 0.75 AND middle < 0.10 THEN greatest(0.10::DOUBLE, 1 - extreme) ELSE 1.0::DOUBLE END AS score FROM a",
    "q_contrast": f"{_MEANS}, a AS (SELECT image_id, stddev_pop(g) AS std FROM pixels GROUP BY 1) SELECT image_id, round(std, 6) AS std, round(CASE WHEN std < 20 THEN greatest(0.1::DOUBLE, std / 20) ELSE 1.0::DOUBLE END, 6) AS score FROM a",
    "q_toner": f"{_MEANS}, b AS (SELECT image_id, avg(g) AS m, stddev_pop(g) AS s, count(*) FILTER (g <= 30 OR g > 225) / count(*) AS e FROM pixels GROUP BY image_id, y // 4, x // 4), a AS (SELECT image_id, count(*) FILTER (m > 40 AND m < 220 AND s > 50) AS blocks, count(*) FILTER (m > 40 AND m < 220 AND s > 50 AND e > 0.70) AS bimodal FROM b GROUP BY 1) SELECT *, CASE WHEN blocks >= 1 AND bimodal / blocks > 0.5 THEN greatest(0.10::DOUBLE, 1 - bimodal / blocks) ELSE 1.0::DOUBLE END AS score FROM a",
    "q_saturation": f"WITH {_COLOURS}, t AS (SELECT image_id, CASE WHEN greatest(b, g, r) > 0 THEN floor((greatest(b, g, r) - least(b, g, r)) * 255.0::DOUBLE / greatest(b, g, r) + 0.5) ELSE 0 END AS s FROM colours), a AS (SELECT image_id, avg(s) AS mean, stddev_pop(s) AS std, count(*) FILTER (s > 20) / count(*) AS coloured FROM t GROUP BY 1) SELECT image_id, round(mean, 6) AS mean, round(std, 6) AS std, coloured, round(CASE WHEN mean < 8 OR coloured < 0.05 THEN mean / 8 WHEN mean < 20 AND std < 12 THEN greatest(0.2::DOUBLE, mean / 30) ELSE 1.0::DOUBLE END, 6) AS score FROM a",
    "q_colour_temperature": f"WITH {_COLOURS}, a AS (SELECT image_id, count(*) FILTER (b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE > 180) AS n, avg(b) FILTER (b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE > 180) - avg(r) FILTER (b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE > 180) AS d FROM colours GROUP BY 1) SELECT image_id, CASE WHEN n >= 3 THEN round(d, 6) END AS difference, round(CASE WHEN n >= 3 AND d > 8 THEN greatest(0.1::DOUBLE, 1 - (d - 8) / 30) ELSE 1.0::DOUBLE END, 6) AS score FROM a",
    "q_splice_boundary": f"{_MEANS}, v AS (SELECT image_id, g / 64.0::DOUBLE AS v, lead(g / 64.0::DOUBLE) OVER (PARTITION BY image_id, y ORDER BY x) AS r, lead(g / 64.0::DOUBLE) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM pixels), a AS (SELECT image_id, (count(r) + count(d))::BIGINT AS pairs, (count(*) FILTER (greatest(v, r) > 0.5 AND abs(v - r) / greatest(v, r) > 0.7::DOUBLE) + count(*) FILTER (greatest(v, d) > 0.5 AND abs(v - d) / greatest(v, d) > 0.7::DOUBLE))::BIGINT AS jumps FROM v GROUP BY 1) SELECT *, CASE WHEN jumps / greatest(pairs, 1) > 0.18::DOUBLE THEN greatest(0.1::DOUBLE, 1 - 3 * (jumps / greatest(pairs, 1))) ELSE 1.0::DOUBLE END AS score FROM a",
    "q_lbp_hist": f"{_MEANS}, c AS (SELECT c.image_id, " + " + ".join(f"max(CASE WHEN n.y = c.y + {dy} AND n.x = c.x + {dx} AND n.g >= c.g THEN {1 << (7 - k)} ELSE 0 END)" for k, (dy, dx) in enumerate([(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)])) + f" AS code FROM pixels c JOIN pixels n ON n.image_id = c.image_id AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY c.image_id, c.y, c.x), b AS (SELECT image_id, {_BINS}[code + 1] AS bin FROM c) SELECT image_id, bin, count(*) / 36::DOUBLE AS share FROM b GROUP BY 1, 2",
    "q_clone_pairs": f"WITH {_PAIRS} SELECT * FROM n",
    "q_clone_score": f"WITH {_PAIRS}, k AS (SELECT image_id, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM b GROUP BY 1), x AS (SELECT image_id, count(*) AS near FROM n GROUP BY 1) SELECT image_id, coalesce(near, 0) AS near, pairs, CASE WHEN coalesce(near, 0) / greatest(pairs, 1) > 0.05::DOUBLE THEN greatest(0.3::DOUBLE, 1 - 5 * (coalesce(near, 0) / greatest(pairs, 1))) ELSE 1.0::DOUBLE END AS score FROM k LEFT JOIN x USING (image_id)",
    "q_aspect": "WITH r AS (SELECT p_partkey, abs(greatest(1000.0::DOUBLE, p_size * 25.0::DOUBLE) / least(1000.0::DOUBLE, p_size * 25.0::DOUBLE) - 85.60::DOUBLE / 53.98::DOUBLE) / (85.60::DOUBLE / 53.98::DOUBLE) AS off FROM part) SELECT p_partkey, round(CASE WHEN off <= 0.10::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - 3 * off) END, 9) AS score FROM r",
    "q_weighted_score": f"WITH {_CHECKS} SELECT p_partkey, round(side_score, 9) AS side_score, veto FROM f",
    "q_passport_blend": f"WITH {_CHECKS}, m AS (SELECT p_partkey, side_score * 0.65::DOUBLE + CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.1 ELSE 0.4 END::DOUBLE * 0.35::DOUBLE AS v FROM f), l AS (SELECT p_partkey, least(v, CASE p_partkey % 4 WHEN 2 THEN 0.30 WHEN 3 THEN 0.60 ELSE 9 END::DOUBLE, CASE WHEN p_partkey % 5 = 0 THEN 0.65 ELSE 9 END::DOUBLE) AS v FROM m) SELECT p_partkey, round(floor(greatest(0, least(1, v)) * 1000 + 0.5) / 1000, 3) AS score FROM l",
    "q_structure_score": f"WITH {_S} SELECT p_partkey, round({_sum({'aspect': 0.30, 'colour': 0.40, 'contrast': 0.30})}, 9) AS score FROM s",
    "q_photocopy_score": _capped(_sum({"saturation": 0.40, "halftone": 0.25, "toner": 0.20, "dynamic_range": 0.15}), [("saturation < 0.2", "0.25"), ("halftone < 0.4 AND dynamic_range < 0.5", "0.38")]),
    "q_recapture_score": _capped(_sum({"moire": 0.13, "screen": 0.15, "flat": 0.18, "backlight": 0.12, "colour": 0.12, "background": 0.12, "sharpness": 0.08, "perspective": 0.06, "glare": 0.04}), [("flat < 0.70 AND backlight < 0.70", "0.48"), ("colour < 0.55 AND flat < 0.80", "0.50"), ("diagonals > 500 AND perspective < 0.40 AND (flat < 0.70 OR colour < 0.70)", "0.45"), ("flat < 0.55 AND (screen < 0.95 OR backlight < 0.85)", "0.45"), ("backlight < 0.55 AND screen < 0.92", "0.48"), ("background < 0.50 AND (colour < 0.55 OR flat < 0.60)", "0.52"), ("background < 0.15", "0.50"), ("least(moire, screen) < 0.40", "0.40")]),
    "q_photo_zone_score": _capped(_sum({"border": 0.40, "colour": 0.30, "zone_ela": 0.30}), [(f"{x} < 0.60", x) for x in ("colour", "border", "ring")]),
    "q_tampering_score": _capped("CASE WHEN is_passport THEN " + _sum({n: p for n, _, p in _TAMPER}) + " ELSE " + _sum({n: c for n, c, _ in _TAMPER}) + " END", [("is_passport AND least(ela, multi_ela, photo) < 0.30", "0.50"), ("NOT is_passport AND least(ela, multi_ela, photo) < 0.40", "0.40"), ("is_passport AND splice < 0.50 AND ela < 0.60", "0.45"), ("NOT is_passport AND splice < 0.50 AND ela < 0.60", "0.38"), ("NOT is_passport AND photo < 0.60", "(photo + 0.10::DOUBLE)")]),
    "q_l2_norm": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(greatest(list_sum(list_transform(v, lambda e: e * e)), 1e-9)) AS n FROM v) SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda e: e / n * e / n)), 6) AS squared FROM n",
    "q_checks_json": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (event_id % 100)::DOUBLE / 100 END AS score, CASE WHEN event_id % 10 <> 0 THEN event_id % 2 = 0 END AS veto FROM events",
    "q_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
}
_SAT = "CASE WHEN greatest(b, g, r) > 0 THEN floor((greatest(b, g, r) - least(b, g, r)) * 255.0::DOUBLE / greatest(b, g, r) + 0.5) ELSE 0 END"
_HUE = "CASE WHEN v = least(b, g, r) THEN 0 WHEN v = r THEN (g - b) * 60.0::DOUBLE / (v - least(b, g, r)) WHEN v = g THEN (b - r) * 60.0::DOUBLE / (v - least(b, g, r)) + 120 ELSE (r - g) * 60.0::DOUBLE / (v - least(b, g, r)) + 240 END"
_RATIOS = "r AS (SELECT *, (border * 4 + 0.01) / (clone * 4 + 0.01) AS n, zone_ela * 9 / (splice * 9 + 0.01) AS e, floor(moire * 5) + floor(screen * 5) AS aligned, floor(flat * 9) AS diagonal, (colour * 9 < 4 AND glare * 9 < 3)::INT AS s1, (sharpness * 20 < 8)::INT AS s2, (toner * 12 < 5)::INT AS s3 FROM s)"
SQL |= {
    "q_signal_scores": f"WITH {_S}, {_RATIOS} SELECT p_partkey, round(CASE WHEN ela * 120 > 80 OR photo * 200 > noise * 50 * 3.5 THEN greatest(0.1, 1 - ela * 120 / 200) ELSE 1 END, 9)::DOUBLE AS ela, round(CASE WHEN floor(multi_ela * 12) >= 2 THEN greatest(0.1, 1 - floor(multi_ela * 12) * 0.12) ELSE 1 END, 9)::DOUBLE AS outliers, round(CASE WHEN ring / 4 > 0.11::DOUBLE THEN greatest(0.1, 0.55 - 5 * (ring / 4 - 0.11)) ELSE 1 END, 9)::DOUBLE AS face_ring, round(CASE WHEN n > 3.2 OR n < 0.30 THEN greatest(0, 1 - abs(ln(n)) / 2) ELSE 1 END, 9)::DOUBLE AS border, round(CASE WHEN e > 2.2 OR e < 0.45 THEN greatest(0.05, 1 - abs(ln(e + 0.01)) / 2) ELSE 1 END, 9)::DOUBLE AS zone_ela, round(CASE WHEN background / 3 > 0.20 OR contrast * 130 > 95 THEN greatest(0, 1 - background / 3 * 2 - (contrast * 130 - 95) / 150) ELSE 1 END, 9)::DOUBLE AS background, round(CASE WHEN aligned + diagonal = 0 THEN 0.85 WHEN aligned / (aligned + diagonal) < 0.60 THEN aligned / (aligned + diagonal) ELSE 1 END, 9)::DOUBLE AS perspective, round(greatest(0, 1 - s1 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.30 ELSE 0.08 END - s2 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.35 ELSE 0.10 END - s3 * CASE WHEN s1 + s2 + s3 >= 2 THEN 0.20 ELSE 0.08 END), 9)::DOUBLE AS screen FROM r",
    "q_colour_profile": f"WITH {_COLOURS}, a AS (SELECT *, greatest(b, g, r) AS v, {_SAT} AS s FROM colours), h AS (SELECT *, {_HUE} AS h FROM a), m AS (SELECT image_id, avg(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2) AS hue, avg(s) AS sat, avg(v) AS val FROM h GROUP BY 1) SELECT image_id, round(hue, 6) AS hue, round(sat, 6) AS sat, round(val, 6) AS val, round(CASE WHEN val < 80 THEN 0.4 ELSE greatest(0.2, 1 - CASE image_id % 3 WHEN 0 THEN CASE WHEN hue BETWEEN 12 AND 50 AND sat > 30 THEN 0 ELSE 0.3 END WHEN 1 THEN CASE WHEN sat > 70 THEN 0.15 ELSE 0 END ELSE 0 END) END, 6)::DOUBLE AS score FROM m",
    "q_photo_obscured": f"WITH {_COLOURS}, d AS (SELECT image_id, floor(b / CASE WHEN image_id % 2 = 0 THEN 5 ELSE 1 END)::INT AS b, floor(g / CASE WHEN image_id % 2 = 0 THEN 5 ELSE 1 END)::INT AS g, floor(r / CASE WHEN image_id % 2 = 0 THEN 5 ELSE 1 END)::INT AS r FROM colours WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 5), m AS (SELECT image_id, avg(greatest(b, g, r)) AS val, avg({_SAT}) AS sat, count(*) FILTER (greatest(b, g, r) < 40) / count(*) AS dark FROM d GROUP BY 1) SELECT image_id, round(val, 6) AS val, round(sat, 6) AS sat, dark, CASE WHEN val < 35 OR dark > 0.7 THEN 0.0 WHEN val < 60 AND sat < 30 AND dark > 0.4 THEN 0.25 ELSE 1.0 END::DOUBLE AS score FROM m",
    "q_zone_colour": f"WITH {_COLOURS}, a AS (SELECT *, greatest(b, g, r) AS v, {_SAT} AS s FROM colours WHERE greatest(b, g, r) <= 230), m AS (SELECT image_id, avg(s) FILTER (x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 5) - avg(s) FILTER (x >= 5) AS sat, abs(avg(v) FILTER (x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 5) - avg(v) FILTER (x >= 5)) AS val FROM a GROUP BY 1) SELECT image_id, round(sat, 6) AS sat, round(val, 6) AS val, round(CASE WHEN sat > 30 OR val > 60 THEN greatest(0.1::DOUBLE, 1 - (greatest(sat, val) - 8) / 40) ELSE 1.0::DOUBLE END, 6) AS score FROM m",
    "q_invert": f"{_MEANS} SELECT image_id, ((255 - g) // 32)::INT AS bin, count(*) AS n FROM pixels GROUP BY 1, 2",
    "q_largest": "SELECT p_brand, p_partkey AS i, p_size::BIGINT * (p_partkey % 9) AS area FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, p_partkey) = 1",
    "q_classifier_gate": f"WITH {CAPTURES} SELECT session_id, side FROM captures WHERE side = 'FRONT' AND session_id % 14 = {CODES.index('COL_CC_OLD')}",
    "q_moments": f"{_MEANS} SELECT image_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std FROM pixels GROUP BY 1",
}
_VALUE = f"(SELECT vec_id, label % 2 AS label, list_sum(list_transform(generate_series(1, 64), lambda i: embedding[i]::DOUBLE * ({_W}))) - 0.1 AS value FROM embeddings)"
SQL["q_svm_score"] = f"SELECT vec_id, round(value, 6) AS value, (value > 0)::INT AS predicted FROM {_VALUE}"
SQL["q_confusion"] = f"SELECT vec_id % 3 AS fold, count(*) FILTER (label = 1 AND value > 0) AS tp, count(*) FILTER (label = 0 AND value <= 0) AS tn, count(*) FILTER (label = 0 AND value > 0) AS fp, count(*) FILTER (label = 1 AND value <= 0) AS fn FROM {_VALUE} GROUP BY 1"
