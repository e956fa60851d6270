"""Queries on dates, check digits, machine-readable zones and barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions import checkdigits, text
from passplane.operators import barcode, consolidate, mrz
from passplane.plans.derived import BIRTH, COUNTRY, EXPIRY, GIVEN, SURNAME, K, pad
from passplane.sources.tables import spread, table

DOC = f"concat('AB', {pad(f'({K} % 1000000)', 6)})"
CARD = pad(f"({K} % 1000000000)", 9)
#: Errors put into the check digits by the customer's number modulo 10.
WRONG_NUMBER, WRONG_BIRTH, WRONG_EXPIRY = "c_custkey % 10 IN (1, 2, 3)", "c_custkey % 10 IN (1, 2)", "c_custkey % 10 = 2"

_MONTHS = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEPT", "OCT", "NOV", "DIC"]


def q_normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates printed in eight forms, and one that is none, as ISO."""
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), F.month(d))
    day, year = F.date_format(d, "dd"), F.date_format(d, "yyyy")
    forms = [
        F.date_format(d, "yyMMdd"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "dd-MM-yyyy"),
        F.concat_ws("-", day, F.lower(month), year), F.concat_ws(" ", day, month, year), F.concat(F.lit(" "), F.date_format(d, "dd MM yyyy")), F.concat_ws(" ", day, F.lit("augusto"), year),
    ]
    printed = F.element_at(F.array(*forms), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", printed.alias("printed")).select("o_orderkey", text.iso_date(F.col("printed")).alias("iso"))


def _checked(data: Column, n: int, wrong: str) -> Column:
    digit = (checkdigits.check_digit(data, n) + F.when(F.expr(wrong), 1).otherwise(0)) % 10
    return F.concat(data, digit.cast("string"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    named = {"doc": f"concat({DOC}, '<')", "card": CARD, "birth": BIRTH, "expiry": EXPIRY, "surname": SURNAME, "given": GIVEN, "country": COUNTRY, "sex": "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END"}
    return rows.select("c_custkey", *[F.expr(e).alias(n) for n, e in named.items()])


def _td3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, line1, line2) of passports."""
    rows = _people(spark, sf_dir)
    c = F.col
    one = F.rpad(F.concat(F.lit("P<"), c("country"), c("surname"), F.lit("<<"), c("given")), 44, "<")
    number, birth, expiry = _checked(c("doc"), 9, WRONG_NUMBER), _checked(c("birth"), 6, WRONG_BIRTH), _checked(c("expiry"), 6, WRONG_EXPIRY)
    optional = F.rpad(F.lit("1234"), 15, "<")
    rows = rows.select("c_custkey", "country", "sex", one.alias("line1"), number.alias("n"), birth.alias("b"), expiry.alias("e"), optional.alias("o"))
    rows = rows.withColumn("all", F.concat("n", "b", "e", "o"))
    return rows.select("c_custkey", "line1", F.concat("n", "country", "b", "sex", "e", "o", checkdigits.check_digit(F.col("all"), 39).cast("string")).alias("line2"))


def _td1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, line1, line2, line3) of cards."""
    rows = _people(spark, sf_dir)
    c = F.col
    number, birth, expiry = _checked(c("card"), 9, WRONG_NUMBER), _checked(c("birth"), 6, WRONG_BIRTH), _checked(c("expiry"), 6, WRONG_EXPIRY)
    optional, tail = F.lpad(F.lit(""), 15, "<"), F.rpad(F.expr(pad(K, 10)), 11, "<")
    three = F.rpad(F.concat(c("surname"), F.lit("<<"), c("given")), 30, "<")
    rows = rows.select("c_custkey", "country", "sex", three.alias("line3"), number.alias("n"), birth.alias("b"), expiry.alias("e"), optional.alias("o"), tail.alias("t"))
    rows = rows.withColumn("all", F.concat("n", "o", "b", "e", "t"))
    two = F.concat("b", "sex", "e", "country", "t", checkdigits.check_digit(F.col("all"), 50).cast("string"))
    return rows.select("c_custkey", F.concat(F.lit("ID"), "country", "n", "o").alias("line1"), two.alias("line2"), "line3")


_SHOWN = ["format", "issuing_country", "document_number", "surnames", "given_names", "date_of_birth", "sex", "expiry_date", "nationality", "number_valid", "birth_valid", "expiry_valid", "composite_valid", "all_valid"]


def _td3_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrz.with_zone(_td3(spark, sf_dir).select("c_custkey", F.array("line1", "line2").alias("lines")))


def q_mrz_td3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport zones, parsed."""
    return _td3_zones(spark, sf_dir).select("c_custkey", *[f"zone.{x}" for x in _SHOWN])


def q_mrz_td1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card zones, parsed."""
    rows = mrz.with_zone(_td1(spark, sf_dir).select("c_custkey", F.array("line1", "line2", "line3").alias("lines")))
    return rows.select("c_custkey", *[f"zone.{x}" for x in _SHOWN])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts of cards: prose, then the zone, its first line also in a poorer reading."""
    rows = _td1(spark, sf_dir)
    poorer = F.concat(F.substring("line1", 1, 20), F.lit("A" * 10))
    return rows.select("c_custkey", F.concat_ws("\n", F.lit("Este documento es personal"), poorer, F.lower("line1"), "line2", F.lit("texto corto"), "line3").alias("text"))


def q_mrz_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones found in recognised texts, parsed."""
    rows = mrz.with_zone(mrz.with_zone_lines(_texts(spark, sf_dir)))
    return rows.select("c_custkey", *[f"zone.{x}" for x in ("format", "document_number", "surnames", "given_names", "sex", "number_valid", "birth_valid", "expiry_valid")])


def q_mrz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidate lines each text has, and how many stay of the same prefix."""
    rows = mrz.with_candidates(_texts(spark, sf_dir), out="found")
    return rows.select("c_custkey", F.size("found").alias("candidates"), F.size(mrz.best_of_prefix(F.col("found"))).alias("kept"))


def q_mrz_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of zones by their valid check digits."""
    rows = _td3_zones(spark, sf_dir).select(mrz.valid_count(F.col("zone")).alias("valid"))
    return rows.groupBy("valid", mrz.gate(F.col("valid")).alias("gate")).agg(F.count("*").alias("zones"))


def q_mrz_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones in the contract."""
    rows = _td3_zones(spark, sf_dir).select("c_custkey", mrz.contract(F.col("zone")).alias("z"))
    return rows.select("c_custkey", F.col("z.format").alias("format"), F.col("z.check_digits.valid").alias("valid"), *[F.element_at("z.fields", F.lit(n)).alias(n) for n in ("documentNumber", "lastNames", "birthDate", "expiryDate", "issuingCountry", "documentCode")])


def q_passport_mrz_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport texts: with both lines, with the second broken off, with a card's lines, with neither."""
    p = _td3(spark, sf_dir).select("c_custkey", F.concat_ws("\n", F.lit("PASAPORTE"), "line1", "line2").alias("good"), F.concat_ws("\n", "line1", F.substring("line2", 1, 28)).alias("cut"))
    c = _td1(spark, sf_dir).select("c_custkey", F.concat_ws("\n", "line1", "line2", "line3").alias("card"))
    rows = p.join(c, "c_custkey").withColumn("kind", F.expr("(c_custkey div 10) % 4"))
    kind = F.col("kind")
    rows = rows.select("c_custkey", F.when(kind == 0, F.col("good")).when(kind == 1, F.col("cut")).when(kind == 2, F.col("card")).otherwise("sin zona legible").alias("text"))
    rows = mrz.with_passport_check(rows)
    return rows.select("c_custkey", "check.detected", "check.valid", "check.wrong_format", mrz.passport_mrz_score(F.col("check")).alias("score"))


def q_icao_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of numbers and birth dates, and whether a given one holds."""
    rows = _people(spark, sf_dir)
    given = ((checkdigits.check_digit(F.col("doc"), 9) + F.when(F.expr(WRONG_NUMBER), 1).otherwise(0)) % 10).cast("string")
    return rows.select("c_custkey", checkdigits.check_digit(F.col("doc"), 9).cast("int").alias("number_digit"), checkdigits.check_digit(F.col("birth"), 6).cast("int").alias("birth_digit"), checkdigits.check_digit_valid(F.col("doc"), given, 9).alias("valid"))


def _digit_sql(data: str, n: int) -> str:
    terms = [f"greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({data}, {i + 1}, 1)) - 1, 0) * {(7, 3, 1)[i % 3]}" for i in range(n)]
    return f"(({' + '.join(terms)}) % 10)"


def q_ecu_mod10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-digit numbers by whether their check holds."""
    number = F.expr(pad(f"({K} * 7919 % 1000000007)", 10))
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), checkdigits.ecuador_valid(number).alias("valid"))


_BARCODE = "concat_ws('-', substr('APE', CAST(o_orderkey % 3 + 1 AS INT), 1), lpad(concat('', o_custkey), 7, '0'), lpad(concat('', o_orderkey), 8, '0'), CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'f' END, lpad(concat('', o_custkey), 10, '0'), {date})"


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(_BARCODE.format(date="date_format(o_orderdate, 'yyyyMMdd')"))
    kind = F.col("o_orderkey") % 7
    broken = F.concat(F.substring(line, 1, 9), F.lit("\n"), F.substring(line, 11, 8), F.lit(" - "), F.substring(line, 20, 2), F.lit(" "), F.substring(line, 22, 10), F.lit("\n"), F.substring(line, 33, 8))
    raw = F.when(kind == 1, broken).when(kind == 2, F.concat(F.lit("LOTE "), F.col("o_orderkey"))).otherwise(line)
    return barcode.with_barcode(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", "b").drop("raw")


def q_barcode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode texts: whole lines, broken ones and others."""
    return _barcodes(spark, sf_dir).select("o_orderkey", *[f"b.{x}" for x in ("parsed", "series", "sequence", "sex", "number", "issued")])


def q_barcode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often barcodes give each field."""
    rows = _barcodes(spark, sf_dir).select(F.inline(barcode.fields(F.col("b"))))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))


def _read_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as OCR reads them: the number (every third missing), surnames without value, sex with high confidence."""
    item = lambda name, value, confidence: F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(confidence).alias("confidence"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.inline(F.array(item("documentNumber", F.expr(pad(K, 8)), 0.90), item("apellidos", F.lit(None).cast("string"), 0.0), item("sexo", F.lit("X"), 0.96))))
    return rows.where("field <> 'documentNumber' OR c_custkey % 3 <> 0")


def q_enrich_mrz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields merged with those of the zone."""
    zone = F.col("zone")
    decoded = _td3_zones(spark, sf_dir).where(mrz.gate(mrz.valid_count(zone)) == "ENRICH").select("c_custkey", F.inline(mrz.fields(zone)))
    return consolidate.enrich_from_mrz(_read_fields(spark, sf_dir), decoded, ["c_custkey", "field"]).select("c_custkey", "field", "value", "confidence")


def q_enrich_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields merged with those of the customer's first order's barcode."""
    rows = _barcodes(spark, sf_dir).join(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), "o_orderkey")
    decoded = rows.select(F.col("o_custkey").alias("c_custkey"), F.inline(barcode.fields(F.col("b")))).where("field IN ('documentNumber', 'sexo')").drop("confidence")
    return consolidate.enrich_from_barcode(_read_fields(spark, sf_dir), decoded, ["c_custkey", "field"]).select("c_custkey", "field", "value", "confidence")


def q_enrich_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields merged with those of the zone and of the first order's barcode, and the barcode itself."""
    zone = F.col("zone")
    decoded = _td3_zones(spark, sf_dir).where(mrz.gate(mrz.valid_count(zone)) == "ENRICH").select("c_custkey", F.inline(mrz.fields(zone)))
    rows = _barcodes(spark, sf_dir).join(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), "o_orderkey")
    coded = rows.select(F.col("o_custkey").alias("c_custkey"), F.inline(barcode.fields(F.col("b")))).where("field IN ('documentNumber', 'sexo')").drop("confidence")
    raw = rows.select(F.col("o_custkey").alias("c_custkey"), F.col("b.number").alias("value"))
    return consolidate.consolidated(_read_fields(spark, sf_dir).select("c_custkey", "field", "value", "confidence"), decoded, coded, raw, ["c_custkey"])


def q_name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cleaners of names on damaged lines."""
    rows = _people(spark, sf_dir)
    line = F.concat(F.lit("- "), F.col("surname"), F.lit(" "), F.col("given"), F.lit(" . a."))
    passport = F.concat(F.col("surname"), F.lit(" "), F.col("given"), F.lit(" Given names 77-"))
    block = F.concat_ws("\n", F.lit("NUI"), F.concat(F.lit("- "), F.col("surname")), F.lit("NUI 17220"), F.concat(F.col("given"), F.lit("0.")), F.concat(F.col("given"), F.lit(".")))
    return rows.select("c_custkey", text.capital_run(line).alias("run"), text.passport_name(passport).alias("passport"), text.surname_lines(block).alias("block"))


QUERIES = {f.__name__: f for f in (q_normalize_date, q_mrz_td3, q_mrz_td1, q_mrz_text, q_mrz_dedup, q_mrz_gate, q_mrz_contract, q_passport_mrz_check, q_icao_check_digit, q_ecu_mod10, q_barcode_parse, q_barcode_fields, q_enrich_mrz, q_enrich_barcode, q_enrich_all, q_name_clean)}

_NV, _BV, _EV = (f"NOT ({w})" for w in (WRONG_NUMBER, WRONG_BIRTH, WRONG_EXPIRY))
_SEX = "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END"
_PERSONAL = f"CASE WHEN {COUNTRY} = 'COL' THEN (CASE WHEN c_custkey = 0 THEN '' ELSE concat('', c_custkey) END) ELSE {CARD} END"


def _zone_sql(form: str, number: str) -> str:
    return f"SELECT c_custkey, '{form}' AS format, {COUNTRY} AS issuing_country, {number} AS document_number, {SURNAME} AS surnames, {GIVEN} AS given_names, {BIRTH} AS date_of_birth, {_SEX} AS sex, {EXPIRY} AS expiry_date, {COUNTRY} AS nationality, {_NV} AS number_valid, {_BV} AS birth_valid, {_EV} AS expiry_valid, true AS composite_valid, {_NV} AND {_BV} AND {_EV} AS all_valid FROM customer"


_ECU_SUM = " + ".join(f"(CASE WHEN d{i} * {2 - i % 2} >= 10 THEN d{i} * {2 - i % 2} - 9 ELSE d{i} * {2 - i % 2} END)" for i in range(9))
_VALID = f"(({_NV})::INT + ({_BV})::INT + ({_EV})::INT)"
_BAR = f"SELECT o_orderkey, o_custkey, o_orderkey % 7 AS kind, {_BARCODE.format(date="strftime(o_orderdate, '%Y%m%d')")} AS line, strftime(o_orderdate, '%Y-%m-%d') AS issued FROM orders"
_READ = f"fields AS (SELECT c_custkey, 'documentNumber' AS field, {pad(K, 8)} AS value, 0.90::DOUBLE AS confidence FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'apellidos', NULL, 0.0 FROM customer UNION ALL SELECT c_custkey, 'sexo', 'X', 0.96 FROM customer)"


def _iso(yymmdd: str) -> str:
    return f"concat(CASE WHEN substr({yymmdd}, 1, 2) > '30' THEN '19' ELSE '20' END, substr({yymmdd}, 1, 2), '-', substr({yymmdd}, 3, 2), '-', substr({yymmdd}, 5, 2))"


_DECODED = " UNION ALL ".join(f"SELECT c_custkey, '{f}' AS field, {v} AS decoded FROM customer WHERE {_VALID} >= 2" for f, v in (("apellidos", SURNAME), ("nombres", GIVEN), ("documentNumber", DOC), ("fechaNacimiento", _iso(BIRTH)), ("fechaVencimiento", _iso(EXPIRY)), ("sexo", _SEX), ("nacionalidad", COUNTRY)))
_FIRST = f"first AS (SELECT b.*, f.o_custkey AS c FROM ({_BAR}) b JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) f ON o = o_orderkey), decoded AS (SELECT c AS c_custkey, 'documentNumber' AS field, CASE WHEN c = 0 THEN '0000000000' ELSE concat('', c) END AS decoded FROM first WHERE kind <> 2 UNION ALL SELECT c, 'sexo', CASE WHEN c % 2 = 0 THEN 'M' ELSE 'F' END FROM first WHERE kind <> 2)"

SQL = {
    "q_normalize_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN concat(strftime(o_orderdate, '%d'), ' AUGUSTO ', strftime(o_orderdate, '%Y')) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "q_mrz_td3": _zone_sql("TD3", DOC),
    "q_mrz_td1": _zone_sql("TD1", _PERSONAL),
    "q_mrz_text": f"SELECT c_custkey, format, document_number, surnames, given_names, sex, number_valid, birth_valid, expiry_valid FROM ({_zone_sql('TD1', _PERSONAL)})",
    "q_mrz_gate": f"SELECT {_VALID}::INT AS valid, CASE {_VALID} WHEN 0 THEN 'DROP' WHEN 1 THEN 'DISPLAY' ELSE 'ENRICH' END AS gate, count(*) AS zones FROM customer GROUP BY 1, 2",
    "q_mrz_contract": f"SELECT c_custkey, 'TD3' AS format, {_VALID}::INT AS valid, {DOC} AS \"documentNumber\", {SURNAME} AS \"lastNames\", {_iso(BIRTH)} AS \"birthDate\", {_iso(EXPIRY)} AS \"expiryDate\", {COUNTRY} AS \"issuingCountry\", 'P' AS \"documentCode\" FROM customer",
    "q_passport_mrz_check": f"WITH k AS (SELECT *, (c_custkey // 10) % 4 AS kind, {_NV} AND {_BV} AND {_EV} AS good, {_VALID} AS held FROM customer), r AS (SELECT c_custkey, kind = 0 OR kind = 2 OR kind = 1 AND held >= 2 AS detected, kind = 0 AND good OR kind = 1 AND good AS valid, kind = 2 AS wrong_format FROM k) SELECT *, CASE WHEN valid THEN 1.0 WHEN detected THEN 0.4 ELSE 0.1 END::DOUBLE AS score FROM r",
    "q_icao_check_digit": f"WITH p AS (SELECT c_custkey, concat({DOC}, '<') AS doc, {BIRTH} AS birth FROM customer) SELECT c_custkey, {_digit_sql('doc', 9)}::INT AS number_digit, {_digit_sql('birth', 6)}::INT AS birth_digit, {_NV} AS valid FROM p",
    "q_ecu_mod10": f"WITH n AS (SELECT c_custkey, {pad(f'({K} * 7919 % 1000000007)', 10)} AS number FROM customer), d AS (SELECT *, {', '.join(f'substr(number, {i + 1}, 1)::INT AS d{i}' for i in range(10))} FROM n) SELECT c_custkey, number, (10 - ({_ECU_SUM}) % 10) % 10 = d9 AS valid FROM d",
    "q_barcode_parse": f"WITH b AS ({_BAR}) SELECT o_orderkey, kind <> 2 AS parsed, CASE WHEN kind NOT IN (1, 2) THEN substr(line, 1, 9) END AS series, CASE WHEN kind NOT IN (1, 2) THEN substr(line, 11, 8) END AS sequence, CASE WHEN kind <> 2 THEN upper(substr(line, 20, 1)) END AS sex, CASE WHEN kind <> 2 THEN (CASE WHEN o_custkey = 0 THEN '0000000000' ELSE concat('', o_custkey) END) END AS number, CASE WHEN kind <> 2 THEN issued END AS issued FROM b",
    "q_barcode_fields": "WITH k AS (SELECT o_orderkey % 7 AS kind FROM orders), f AS (SELECT CASE WHEN kind = 2 THEN ['barcodeRaw'] ELSE ['documentNumber', 'sexo', 'fechaExpedicion', 'codigoBarras'] END AS names FROM k) SELECT field, count(*) AS n, 1.0::DOUBLE AS confidence FROM (SELECT unnest(names) AS field FROM f) GROUP BY 1",
    "q_enrich_mrz": f"WITH {_READ}, decoded AS ({_DECODED}) SELECT coalesce(f.c_custkey, d.c_custkey) AS c_custkey, coalesce(f.field, d.field) AS field, CASE WHEN d.decoded IS NOT NULL AND (f.confidence IS NULL OR f.value IS NULL OR f.confidence < 0.95) THEN d.decoded ELSE f.value END AS value, CASE WHEN f.confidence IS NULL THEN 0.98 WHEN d.decoded IS NOT NULL AND (f.value IS NULL OR f.confidence < 0.95) THEN 0.97 ELSE f.confidence END::DOUBLE AS confidence FROM fields f FULL JOIN decoded d ON f.c_custkey = d.c_custkey AND f.field = d.field",
    "q_enrich_all": f"WITH {_READ}, zoned AS ({_DECODED}), {_FIRST}, e AS (SELECT coalesce(f.c_custkey, d.c_custkey) AS c_custkey, coalesce(f.field, d.field) AS field, CASE WHEN d.decoded IS NOT NULL AND (f.confidence IS NULL OR f.value IS NULL OR f.confidence < 0.95) THEN d.decoded ELSE f.value END AS value, CASE WHEN f.confidence IS NULL THEN 0.98 WHEN d.decoded IS NOT NULL AND (f.value IS NULL OR f.confidence < 0.95) THEN 0.97 ELSE f.confidence END::DOUBLE AS confidence FROM fields f FULL JOIN zoned d ON f.c_custkey = d.c_custkey AND f.field = d.field) SELECT coalesce(f.c_custkey, d.c_custkey) AS c_custkey, coalesce(f.field, d.field) AS field, coalesce(d.decoded, f.value) AS value, CASE WHEN d.decoded IS NOT NULL THEN 1.0 ELSE f.confidence END::DOUBLE AS confidence FROM e f FULL JOIN decoded d ON f.c_custkey = d.c_custkey AND f.field = d.field UNION ALL SELECT c_custkey, 'codigoBarras', decoded, 1.0::DOUBLE FROM decoded WHERE field = 'documentNumber'",
    "q_enrich_barcode": f"WITH {_READ}, {_FIRST} SELECT coalesce(f.c_custkey, d.c_custkey) AS c_custkey, coalesce(f.field, d.field) AS field, coalesce(d.decoded, f.value) AS value, CASE WHEN d.decoded IS NOT NULL THEN 1.0 ELSE f.confidence END::DOUBLE AS confidence FROM fields f FULL JOIN decoded d ON f.c_custkey = d.c_custkey AND f.field = d.field",
    "q_mrz_dedup": "SELECT c_custkey, 4::INT AS candidates, 3::INT AS kept FROM customer",
    "q_name_clean": f"SELECT c_custkey, concat({SURNAME}, ' ', {GIVEN}) AS run, concat({SURNAME}, ' ', {GIVEN}) AS passport, concat({SURNAME}, ' ', {GIVEN}) AS block FROM customer",
}
