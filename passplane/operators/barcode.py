"""Colombian barcode text: series, sequence, sex, number and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.functions.text import sliced_date, strip_zeros

# The full line, and what is left of it when recognition broke it up.
FULL = r"(?s)([APEape]-\d{7}-\d{8}-[MFmf]-)(\d{7,13})-(\d{8}).*"
BROKEN = r"(?i)[APEape]-\d{5,7}[\s\-]*\d{0,3}[\s\S]{0,30}?([MFmf])-[\s]*(\d{7,13})[\s\S]{0,20}?(\d{8})"


def parse(text: Column) -> Column:
    """A struct (parsed, series, sequence, sex, number, issued, raw): by the full line, else by the broken one."""
    full = text.rlike(FULL)
    prefix = F.split(F.regexp_extract(text, FULL, 1), "-")
    broken = ~full & text.rlike(BROKEN)
    part = lambda k, g: F.when(full, k).when(broken, F.regexp_extract(text, BROKEN, g))
    number = part(F.regexp_extract(text, FULL, 2), 2)
    return F.struct(
        F.coalesce(full | broken, F.lit(False)).alias("parsed"),
        F.when(full, F.concat_ws("-", prefix[0], prefix[1])).alias("series"),
        F.when(full, prefix[2]).alias("sequence"),
        F.upper(part(prefix[3], 1)).alias("sex"),
        strip_zeros(number, keep_all_zero=True).alias("number"),
        sliced_date(part(F.regexp_extract(text, FULL, 3), 3)).alias("issued"),
        text.alias("raw"),
    )


def with_barcode(rows: DataFrame, text: str = "raw", out: str = "barcode") -> DataFrame:
    """Adds the struct of a barcode's text."""
    # exploding one element keeps the patterns from being copied into what uses the struct
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], F.explode(F.array(parse(F.col(text)))).alias(out))


def fields(parsed: Column) -> Column:
    """What a parsed barcode says, as an array of (field, value, confidence); an unstructured one gives its raw text."""
    item = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(1.0).alias("confidence"))
    known = F.array(item("documentNumber", parsed["number"]), item("sexo", parsed["sex"]), item("fechaExpedicion", parsed["issued"]), item("codigoBarras", parsed["raw"]))
    return F.filter(F.when(parsed["parsed"], known).otherwise(F.array(item("barcodeRaw", parsed["raw"]))), lambda x: F.trim(x["value"]) != "")
