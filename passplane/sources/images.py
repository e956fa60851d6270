"""Image files as rows: bytes, digest, labels from folders, and decoded pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.sources import pictures


def image_files(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,pgm,ppm}") -> DataFrame:
    """(path, label, sha256, length, content) of all image files below a folder; the label is the last folder's name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("label"), F.sha2("content", 256).alias("sha256"), "length", "content")


def non_empty(images: DataFrame) -> DataFrame:
    """Images with content."""
    return images.where(F.length("content") > 0)


def pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, b, g, r) of images (path, content); files that cannot be decoded give no rows (`pictures.decoded` says why)."""
    return pictures.pixels(pictures.decoded(images))
