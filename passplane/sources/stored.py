"""JSON columns and whole tables in several file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored values.
OCR = "fields map<string,string>, fieldConfidence map<string,double>, mrz struct<raw:array<string>,format:string,checkDigits:struct<total:int,valid:int>,fields:map<string,string>>"
AUTHENTICITY = "score double, veto boolean, checks array<struct<name:string,score:double,passed:boolean>>"

FORMATS = ("parquet", "orc", "json", "csv")


def read_json(c: Column, schema: str) -> Column:
    """JSON text as a struct; malformed or blank text is null."""
    parsed = F.from_json(F.when(F.trim(c) != "", c), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(parsed["_bad"].isNull(), parsed.dropFields("_bad"))


def write_json(c: Column) -> Column:
    """A struct as JSON text."""
    return F.to_json(c)


def fields_long(captures: DataFrame) -> DataFrame:
    """(session_id, side, field, value, confidence) from captures with ocr_json; a field without confidence has 0."""
    ocr = captures.select("session_id", "side", read_json(F.col("ocr_json"), OCR).alias("ocr"))
    rows = ocr.select("session_id", "side", F.explode("ocr.fields").alias("field", "value"), F.col("ocr.fieldConfidence").alias("c"))
    return rows.select("session_id", "side", "field", "value", F.coalesce(F.element_at("c", F.col("field")), F.lit(0.0)).alias("confidence"))


def failed_check(captures: DataFrame, name: str = "PHOTO_SUBSTITUTION_ML") -> DataFrame:
    """(session_id, failed): whether any capture's authenticity_json has this check not passed."""
    stored = read_json(F.col("authenticity_json"), AUTHENTICITY)
    failed = F.exists(stored["checks"], lambda x: (x["name"] == name) & ~x["passed"])
    return captures.groupBy("session_id").agg(F.bool_or(F.coalesce(failed, F.lit(False))).alias("failed"))


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A table in one of FORMATS; CSV has a header."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").format(_known(kind)).load(path)


def write(rows: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    """Writes rows in one of FORMATS."""
    writer = rows.write.option("header", "true").format(_known(kind))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _known(kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(FORMATS)}")
    return kind
