"""Reconciling field values by confidence: within a side, across sides, and with decoded zones and barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.functions.text import literal_map

# Names of extracted fields in the contract. Others keep their names.
NAMES = {
    "apellidos": "lastNames", "nombres": "firstNames", "nombre": "firstNames", "fechaNacimiento": "birthDate",
    "fechaVencimiento": "expiryDate", "fechaExpiracion": "expiryDate", "fechaValidez": "expiryDate", "fechaVigencia": "expiryDate",
    "fechaExpedicion": "issueDate", "fechaEmision": "issueDate", "sexo": "sex", "nacionalidad": "nationality",
    "grupoSanguineo": "bloodType", "lugarNacimiento": "birthPlace", "ciudadNacimiento": "birthPlace", "paisNacimiento": "birthCountry",
    "lugarExpedicion": "issuePlace", "estatura": "height", "numSoporte": "supportNumber", "numeroPersonal": "personalNumber",
    "estadoCivil": "civilStatus",
}


def contract_name(field: Column) -> Column:
    """The field's name in the contract."""
    return F.coalesce(F.element_at(literal_map(NAMES), field), field)


def best_values(fields: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per keys the value with the highest confidence; of equal ones the first by order.

    A reduction to one struct per key, which pre-aggregates before its shuffle, so a hot key costs one row a task.
    order: columns that are together unique within keys.
    """
    row = F.struct((-F.col("confidence")).alias("by"), *[F.col(c) for c in order], "value", "confidence")
    return fields.groupBy(*keys).agg(F.min(row).alias("best")).select(*keys, "best.value", "best.confidence", *[f"best.{c}" for c in order])


def contract_fields(fields: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Renames fields (field, value, confidence), drops blank values, keeps the best of each name."""
    named = fields.withColumn("field", contract_name(F.col("field"))).where("trim(value) <> ''")
    return best_values(named, [*keys, "field"], order)


def _merged(fields: DataFrame, decoded: DataFrame, keys: list[str], take: Column, confidence: Column, inserted: float) -> DataFrame:
    """Full outer merge of fields and decoded values by keys."""
    other = decoded.where("trim(value) <> ''").select(*keys, F.col("value").alias("decoded"))
    both = fields.join(other, keys, "full_outer")
    absent = F.col("confidence").isNull()
    wins = F.col("decoded").isNotNull() & (absent | take)
    return both.select(
        *keys,
        F.when(wins, F.col("decoded")).otherwise(F.col("value")).alias("value"),
        F.when(absent, F.lit(inserted)).when(wins, confidence).otherwise(F.col("confidence")).alias("confidence"),
        wins.alias("replaced"),
    )


def enrich_from_mrz(fields: DataFrame, mrz: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the zone replace null ones and those of a confidence below 0.95 (then 0.97); new ones get 0.98."""
    return _merged(fields, mrz, keys, F.col("value").isNull() | (F.col("confidence") < 0.95), F.lit(0.97), 0.98)


def enrich_from_barcode(fields: DataFrame, barcode: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the barcode always replace, with confidence 1."""
    return _merged(fields, barcode, keys, F.lit(True), F.lit(1.0), 1.0)


def consolidated(fields: DataFrame, zone: DataFrame, barcode: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value, confidence): what was recognised, with the zone's and the barcode's values, and the barcode itself.

    fields: keys, field, value, confidence; zone and barcode: keys, field, value; raw: keys, value, the barcode's text.
    """
    read = enrich_from_mrz(fields, zone, [*keys, "field"]).drop("replaced")
    decoded = enrich_from_barcode(read, barcode, [*keys, "field"]).drop("replaced")
    return decoded.unionByName(raw.where("trim(value) <> ''").select(*keys, F.lit("codigoBarras").alias("field"), "value", F.lit(1.0).alias("confidence")))
