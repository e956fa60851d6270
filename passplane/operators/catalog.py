"""The catalog of document types: a small dimension that joins by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, country, sides, machine-readable zone and its format, chip, expiry, and whether OCR looks for a zone.
TYPES = [
    ("COL_CC_OLD", "COL", "FRONT,BACK", False, None, False, False, False),
    ("COL_CC_NEW", "COL", "FRONT,BACK", True, "TD1", False, True, False),
    ("COL_PA", "COL", "FRONT", True, "TD3", True, True, True),
    ("COL_TI", "COL", "FRONT,BACK", False, None, False, True, False),
    ("COL_PPT", "COL", "FRONT,BACK", False, None, False, True, False),
    ("COL_CE", "COL", "FRONT,BACK", True, "TD1", False, True, False),
    ("ESP_DNI_OLD", "ESP", "FRONT,BACK", True, "TD1", False, True, False),
    ("ESP_DNI_NEW", "ESP", "FRONT,BACK", True, "TD1", False, True, True),
    ("ECU_DNI_OLD", "ECU", "FRONT,BACK", False, None, False, True, False),
    ("ECU_DNI_NEW", "ECU", "FRONT,BACK", False, None, False, True, False),
    ("PER_DNI_OLD", "PER", "FRONT,BACK", False, None, False, True, False),
    ("PER_DNI_NEW", "PER", "FRONT,BACK", True, "TD1", False, True, False),
    ("PAN_DNI_OLD", "PAN", "FRONT,BACK", False, None, False, True, False),
    ("PAN_DNI_NEW", "PAN", "FRONT,BACK", False, None, False, True, False),
]

CODES = [t[0] for t in TYPES]


def catalog(spark: SparkSession) -> DataFrame:
    """code, country, sides, has_mrz, mrz_format, supports_nfc, expires, ocr_has_mrz; 14 rows."""
    rows = spark.createDataFrame(TYPES, "code string, country string, sides string, has_mrz boolean, mrz_format string, supports_nfc boolean, expires boolean, ocr_has_mrz boolean")
    return rows.withColumn("sides", F.split("sides", ","))


def sorted_catalog(spark: SparkSession) -> DataFrame:
    """The catalog by code."""
    return catalog(spark).orderBy("code")


def with_type(rows: DataFrame, code: str = "document_type") -> DataFrame:
    """Joins the catalog's columns to rows; rows of unknown types go."""
    types = catalog(rows.sparkSession).withColumnRenamed("code", "_known_code")
    return rows.join(F.broadcast(types), rows[code] == types["_known_code"]).drop(types["_known_code"])


def unsupported(rows: DataFrame, code: str = "document_type") -> DataFrame:
    """Rows whose type is not in the catalog."""
    return rows.join(F.broadcast(catalog(rows.sparkSession).select(F.col("code").alias(code))), code, "left_anti")


def by_country(spark: SparkSession) -> DataFrame:
    """country and its codes in order."""
    return catalog(spark).groupBy("country").agg(F.array_sort(F.collect_list("code")).alias("codes"))
