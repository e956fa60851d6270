"""Combining analyzer scores into a face's authenticity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions.registrations import add, added
from passplane.functions.text import literal_map, rounded

# Weights of analyzers (others: 0.25) and those whose low score is a veto.
WEIGHTS = {"RECAPTURE_DETECTION": 0.30, "PHOTOCOPY_DETECTION": 0.30, "TAMPERING_DETECTION": 0.35, "DOCUMENT_STRUCTURE": 0.35}
CRITICAL = ("RECAPTURE_DETECTION", "TAMPERING_DETECTION", "PHOTOCOPY_DETECTION")
#: Score at which an analyzer passes.
PASS = 0.60


def weight(analyzer: Column, weights: dict[str, float] | None = None) -> Column:
    """The analyzer's weight."""
    return F.coalesce(F.element_at(literal_map(weights or WEIGHTS), analyzer), F.lit(0.25))


def register(analyzer: str, weight_of: float, spark: SparkSession | None = None) -> None:
    """Gives another analyzer a weight of its own in a session (the active one, if none is given); a known one is refused. It is no veto."""
    add(spark, "analyzers", WEIGHTS, analyzer, weight_of)


def combine(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side_score, veto) of checks (keys, analyzer, score, is_passport): one aggregation.

    The weighted mean, held to each critical score below the veto threshold (0.60, passports 0.35) plus a margin (0.05,
    passports none).
    """
    w = weight(F.col("analyzer"), WEIGHTS | added(checks.sparkSession, "analyzers"))
    threshold, margin = F.when(F.col("is_passport"), 0.35).otherwise(0.60), F.when(F.col("is_passport"), 0.0).otherwise(0.05)
    low = F.col("analyzer").isin(*CRITICAL) & (F.col("score") < threshold)
    found = checks.groupBy(*keys).agg(F.sum(F.col("score") * w).alias("total"), F.sum(w).alias("weights"), F.min(F.when(low, F.col("score") + margin)).alias("cap"), F.bool_or(low).alias("veto"))
    return found.select(*keys, F.least(F.col("total") / F.greatest("weights", F.lit(0.001)), "cap").alias("side_score"), "veto")


def passport_blend(score: Column, mrz_score: Column, detected: Column, wrong_format: Column) -> Column:
    """A passport front's score with its zone: 0.65 to 0.35, at most 0.30 for a card's zone, at most 0.60 without one."""
    blend = score * 0.65 + mrz_score * 0.35
    return F.when(wrong_format, F.least(blend, F.lit(0.30))).when(~detected, F.least(blend, F.lit(0.60))).otherwise(blend)


def final_score(score: Column, montage: Column) -> Column:
    """At most 0.65 if the classifier says montage; within 0 and 1; three digits."""
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(montage, F.least(score, F.lit(0.65))).otherwise(score))))


def _weighted(parts: dict[str, float]) -> Column:
    terms = [F.col(name) * w for name, w in parts.items()]
    return sum(terms[1:], terms[0])


def _capped(score: Column, caps: list[tuple[Column, Column | float]]) -> Column:
    """The least of the score and the caps whose condition holds."""
    return F.least(score, *[F.when(when, cap if isinstance(cap, Column) else F.lit(cap)) for when, cap in caps])


def classifier_applies(document_type: Column, side: Column, enabled: bool = True, available: bool = True) -> Column:
    """Whether the montage classifier looks at a face: only at the front of the old Colombian card."""
    return F.lit(enabled and available) & (document_type == "COL_CC_OLD") & (side == "FRONT")


def structure() -> Column:
    """aspect, colour, contrast."""
    return _weighted({"aspect": 0.30, "colour": 0.40, "contrast": 0.30})


def photocopy() -> Column:
    """saturation, halftone, toner, dynamic_range."""
    caps = [(F.col("saturation") < 0.2, 0.25), ((F.col("halftone") < 0.4) & (F.col("dynamic_range") < 0.5), 0.38)]
    return _capped(_weighted({"saturation": 0.40, "halftone": 0.25, "toner": 0.20, "dynamic_range": 0.15}), caps)


def recapture() -> Column:
    """moire, screen, flat, backlight, colour, background, sharpness, perspective, glare, diagonals."""
    c = F.col
    caps = [
        ((c("flat") < 0.70) & (c("backlight") < 0.70), 0.48),
        ((c("colour") < 0.55) & (c("flat") < 0.80), 0.50),
        ((c("diagonals") > 500) & (c("perspective") < 0.40) & ((c("flat") < 0.70) | (c("colour") < 0.70)), 0.45),
        ((c("flat") < 0.55) & ((c("screen") < 0.95) | (c("backlight") < 0.85)), 0.45),
        ((c("backlight") < 0.55) & (c("screen") < 0.92), 0.48),
        ((c("background") < 0.50) & ((c("colour") < 0.55) | (c("flat") < 0.60)), 0.52),
        (c("background") < 0.15, 0.50),
        (F.least("moire", "screen") < 0.40, 0.40),
    ]
    weights = {"moire": 0.13, "screen": 0.15, "flat": 0.18, "backlight": 0.12, "colour": 0.12, "background": 0.12, "sharpness": 0.08, "perspective": 0.06, "glare": 0.04}
    return _capped(_weighted(weights), caps)


def photo_zone() -> Column:
    """border, colour, zone_ela, ring: each of border, colour and ring below 0.60 is a cap."""
    c = F.col
    return _capped(_weighted({"border": 0.40, "colour": 0.30, "zone_ela": 0.30}), [(c(x) < PASS, c(x)) for x in ("colour", "border", "ring")])


def tampering(is_passport: Column) -> Column:
    """ela, multi_ela, photo, noise, illumination, clone, splice."""
    c = F.col
    names = ("ela", "multi_ela", "photo", "noise", "illumination", "clone", "splice")
    card = dict(zip(names, (0.20, 0.20, 0.25, 0.15, 0.10, 0.05, 0.05), strict=True))
    passport = dict(zip(names, (0.20, 0.15, 0.15, 0.20, 0.15, 0.05, 0.10), strict=True))
    by = lambda a, b: F.when(is_passport, F.lit(a)).otherwise(F.lit(b))
    caps = [
        (F.least("ela", "multi_ela", "photo") < by(0.30, 0.40), by(0.50, 0.40)),
        ((c("splice") < 0.50) & (c("ela") < 0.60), by(0.45, 0.38)),
        (~is_passport & (c("photo") < 0.60), c("photo") + 0.10),
    ]
    return _capped(F.when(is_passport, _weighted(passport)).otherwise(_weighted(card)), caps)
