"""Domain inputs derived from the given tables, in Spark and, for the oracle, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.operators.catalog import TYPES
from passplane.sources.tables import table

#: The day on which sessions and documents are looked at; never the wall clock.
AS_OF = "1999-01-01"

#: Expressions that both engines read alike; k stands for the customer's number.
K = "c_custkey"


def pad(expression: str, n: int) -> str:
    """SQL: a number with leading zeros."""
    return f"lpad(concat('', {expression}), {n}, '0')"


#: Made-up names: the digits of the number as letters that no repair step touches.
SURNAME = f"translate({pad(K, 7)}, '0123456789', 'ABDEFGHJLM')"
GIVEN = f"translate(reverse({pad(K, 7)}), '0123456789', 'ABDEFGHJLM')"
BIRTH = f"concat({pad(f'(50 + {K} % 50)', 2)}, {pad(f'(1 + {K} % 12)', 2)}, {pad(f'(1 + {K} % 28)', 2)})"
EXPIRY = f"concat({pad(f'(20 + {K} % 10)', 2)}, {pad(f'(1 + {K} % 12)', 2)}, {pad(f'(1 + {K} % 28)', 2)})"
COUNTRY = "CASE c_nationkey % 5 WHEN 0 THEN 'COL' WHEN 1 THEN 'ESP' WHEN 2 THEN 'ECU' WHEN 3 THEN 'PER' ELSE 'PAN' END"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of sessions: an order's first three lines are its front, the others its back."""
    side = F.when(F.col("l_linenumber") <= 3, "FRONT").otherwise("BACK").alias("side")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), side)
    return rows.agg((F.floor((1 - 5 * F.max("l_discount")) * 1000 + 0.5) / 1000).alias("authenticity_score"), ((F.max("l_tax") >= 0.08) & (F.max("l_quantity") >= 49)).alias("veto"))


CAPTURES = """captures AS (SELECT l_orderkey AS session_id, CASE WHEN l_linenumber <= 3 THEN 'FRONT' ELSE 'BACK' END AS side,
floor((1 - 5 * max(l_discount)) * 1000 + 0.5) / 1000 AS authenticity_score, max(l_tax) >= 0.08 AND max(l_quantity) >= 49 AS veto
FROM lineitem GROUP BY 1, 2)"""

FACES = f"""{CAPTURES}, faces AS (SELECT *, CASE WHEN front IS NOT NULL AND back IS NOT NULL THEN
floor((CASE WHEN least(front, back) < 0.65 THEN least(front * 0.55::DOUBLE + back * 0.45::DOUBLE, front, back) ELSE front * 0.55::DOUBLE + back * 0.45::DOUBLE END) * 1000 + 0.5) / 1000
ELSE coalesce(front, back) END AS score FROM (SELECT session_id, max(CASE WHEN side = 'FRONT' THEN authenticity_score END) AS front,
max(CASE WHEN side = 'BACK' THEN authenticity_score END) AS back, bool_or(veto) AS veto FROM captures GROUP BY 1))"""


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'"


#: The catalog as a table expression, with each code's place by code.
CATALOG = "catalog AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(_sql, row))})" for k, row in enumerate(sorted(TYPES))) + ") AS t(place, code, country, sides, has_mrz, mrz_format, supports_nfc, expires, ocr_has_mrz))"

CODES = [row[0] for row in sorted(TYPES)]


def type_of(key: str, known: int = len(CODES)) -> Column:
    """A document type by a number; beyond the known ones an unknown type."""
    place = F.pmod(F.col(key), F.lit(known))
    return F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in CODES]), (place + 1).cast("int")), F.lit("UNKNOWN_TYPE"))


def _ranged(vectors: DataFrame) -> DataFrame:
    """(image_id, v, low, high): each vector (vec_id, embedding) with its extremes as columns, for a function of the whole vector inside a transform runs once an element."""
    return vectors.select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("v"), F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"))


def _grey(x: Column) -> Column:
    return F.floor((x.cast("double") - F.col("low")) / (F.col("high") - F.col("low")) * 255 + 0.5).cast("int")


def levels(vectors: DataFrame) -> DataFrame:
    """(image_id, all): the grey values 0 to 255 of each vector (vec_id, embedding)."""
    return _ranged(vectors).select("image_id", F.transform("v", _grey).alias("all"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, g): each vector as an 8 by 8 picture of grey values 0 to 255."""
    rows = _ranged(table(spark, sf_dir, "embeddings")).select("image_id", "low", "high", F.posexplode("v").alias("p", "e"))
    return rows.select("image_id", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).alias("x"), _grey(F.col("e")).alias("g"))


PIXELS = """vectors AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings),
flat AS (SELECT vec_id AS image_id, unnest(generate_series(0, 63)) AS p, unnest(v) AS e, list_min(v) AS low, list_max(v) AS high FROM vectors),
pixels AS (SELECT image_id, (p // 8)::INT AS y, (p % 8)::INT AS x, floor((e - low) / (high - low) * 255 + 0.5)::INT AS g FROM flat)"""
