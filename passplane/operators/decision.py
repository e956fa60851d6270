"""The explainable decision on a session from its captures, cross checks and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.functions.text import comparable, parsed_date, rounded

#: Weights of the two faces; the score below which the worse face counts; the score below which a person looks.
FRONT_WEIGHT, BACK_WEIGHT, WORST_BELOW, REVIEW_BELOW = 0.55, 0.45, 0.65, 0.70
#: Edits that two faces may differ by.
MOST_EDITS = 2


def worst_face(front: Column, back: Column, threshold: float = WORST_BELOW) -> Column:
    """Both faces: their blend, or the worse face if it is below the threshold and lower; one face: its score."""
    blend = front * FRONT_WEIGHT + back * BACK_WEIGHT
    worst = F.least(front, back)
    both = rounded(F.when(worst < threshold, F.least(blend, worst)).otherwise(blend))
    return F.when(front.isNotNull() & back.isNotNull(), both).otherwise(F.coalesce(front, back))


def face_scores(captures: DataFrame, key: str = "session_id") -> DataFrame:
    """key, front, back, score, veto: one aggregation of captures (side, authenticity_score, veto)."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("authenticity_score")))
    faces = captures.groupBy(key).agg(side("FRONT").alias("front"), side("BACK").alias("back"), F.bool_or(F.coalesce("veto", F.lit(False))).alias("veto"))
    return faces.withColumn("score", worst_face(F.col("front"), F.col("back")))


def edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of two values as they are compared; null if one is blank."""
    return F.levenshtein(comparable(a), comparable(b))


def faces_match(a: Column, b: Column) -> Column:
    """Whether values of two faces agree up to OCR noise; null if one is blank."""
    return edits(a, b) <= MOST_EDITS


def not_expired(expiry: Column, as_of: Column) -> Column:
    """Whether the date has not passed; null if it is no date."""
    return parsed_date(expiry) >= as_of


def reasons(veto: Column, expired: Column, photo_suspect: Column, mismatch: Column, score: Column, number: Column) -> Column:
    """The reasons in their fixed order. A veto, then an expired document, stands alone."""
    no = F.lit(None).cast("string")
    found = F.array(
        F.when(photo_suspect, "PHOTO_SUBSTITUTION_SUSPECT").otherwise(no),
        F.when(mismatch, "FRONT_BACK_MISMATCH").otherwise(no),
        F.when(score.isNull(), "AUTHENTICITY_UNAVAILABLE").when(score < REVIEW_BELOW, "LOW_AUTHENTICITY_SCORE").otherwise(no),
        F.when(number.isNull(), "DOCUMENT_NUMBER_NOT_READ").otherwise(no),
    )
    return F.when(veto, F.array(F.lit("AUTHENTICITY_VETO"))).when(expired, F.array(F.lit("DOCUMENT_EXPIRED"))).otherwise(F.array_compact(found))


def outcome(veto: Column, expired: Column, why: Column) -> Column:
    """REJECTED on a veto or an expired document, REVIEW for any other reason, else APPROVED."""
    return F.when(veto | expired, "REJECTED").when(F.size(why) > 0, "REVIEW").otherwise("APPROVED")


def decide(sessions: DataFrame) -> DataFrame:
    """Adds reasons and outcome to sessions (veto, expired, photo_suspect, mismatch, score, document_number)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = reasons(flag("veto"), flag("expired"), flag("photo_suspect"), flag("mismatch"), F.col("score"), F.col("document_number"))
    return sessions.withColumn("reasons", why).withColumn("outcome", outcome(flag("veto"), flag("expired"), F.col("reasons")))
