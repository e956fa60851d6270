"""Whole analyzers: the scores of a picture's parts, measured apart, as one row a picture, and their combined score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.operators import authenticity

#: The parts of each analyzer.
PHOTO = ("border", "colour", "zone_ela", "ring")
TAMPERING = ("ela", "multi_ela", "noise", "illumination", "clone", "splice")


def side_by_side(parts: dict[str, DataFrame]) -> DataFrame:
    """(image_id, a column a part) of parts (image_id, score): one aggregation, not a join a part. A picture that a part does not know has null there."""
    rows = reduce(DataFrame.union, [found.select("image_id", F.lit(name).alias("part"), F.col("score").cast("double").alias("score")) for name, found in parts.items()])
    return rows.groupBy("image_id").agg(*[F.max(F.when(F.col("part") == name, F.col("score"))).alias(name) for name in parts])


def tampering(parts: dict[str, DataFrame], is_passport: Column) -> DataFrame:
    """(image_id, the parts, photo, score): the parts of PHOTO and TAMPERING, and `obscured`, which stands for the whole portrait where it is below 0.50.

    is_passport: from image_id. Parts that are not known count as 1."""
    wide = side_by_side(parts).na.fill(1.0)
    photo = F.when(F.col("obscured") < 0.50, F.col("obscured")).otherwise(F.greatest(F.lit(0.0), authenticity.photo_zone()))
    return wide.withColumn("photo", photo).withColumn("score", authenticity.tampering(is_passport))
