"""Document type from keywords of the recognised text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions.registrations import add, added
from passplane.functions.text import keyword_hits

#: The own type is taken from this score on; another one contradicts it from this score on.
OWN_LEAST, OTHER_LEAST = 0.30, 0.50


@dataclass(frozen=True)
class Keywords:
    """A type's keywords, the score of each, and a correction if the text has one of some words."""

    unit: float
    words: tuple[str, ...]
    correction: float = 0.0
    corrected_by: tuple[str, ...] = ()


# Keywords and scores of the types. Spellings with and without accents count separately.
KEYWORDS = {
    "COL_CC_OLD": Keywords(0.12, ("REPUBLICA DE COLOMBIA", "CEDULA DE CIUDADANIA", "IDENTIFICACION PERSONAL", "REGISTRADURIA", "REGISTRADOR NACIONAL", "INDICE DERECHO", "FECHA Y LUGAR DE EXPEDICION", "G.S. RH", "ESTATURA"), -0.2, ("DIGITAL", "FECHA DE EXPEDICION", "VIGENCIA")),
    "COL_CC_NEW": Keywords(0.13, ("CEDULA DE CIUDADANIA", "CÉDULA DE CIUDADANÍA", "REPUBLICA DE COLOMBIA", "REPÚBLICA DE COLOMBIA", "NUIP", "FECHA DE NACIMIENTO", "FECHA DE EXPIRACIÓN", "LUGAR DE NACIMIENTO", "FECHA Y LUGAR DE EXPEDICIÓN")),
    "COL_PA": Keywords(0.13, ("REPUBLIC OF COLOMBIA", "REPUBLICA DE COLOMBIA", "PASAPORTE", "PASSPORT", "DATE OF BIRTH", "DATE OF EXPIRY", "NATIONALITY", "PLACE OF BIRTH")),
    "COL_TI": Keywords(0.14, ("TARJETA DE IDENTIDAD", "REPUBLICA DE COLOMBIA", "IDENTIFICACION PERSONAL", "REGISTRADURIA", "REGISTRADOR NACIONAL", "INDICE DERECHO", "FECHA Y LUGAR DE EXPEDICION", "FECHA DE VENCIMIENTO")),
    "COL_PPT": Keywords(0.15, ("PERMISO POR PROTECCION TEMPORAL", "PERMISO POR PROTECCIÓN TEMPORAL", "PPT", "ESTATUTO TEMPORAL", "MIGRACION COLOMBIA", "MIGRACIÓN COLOMBIA", "VENEZUELA", "VENEZOLAN")),
    "COL_CE": Keywords(0.18, ("CEDULA DE EXTRANJERIA", "CÉDULA DE EXTRANJERÍA", "MIGRACION COLOMBIA", "MIGRACIÓN COLOMBIA", "RESIDENTE", "MIGRANTE")),
    "ESP_DNI_OLD": Keywords(0.14, ("ESPAÑA", "ESPANA", "DOCUMENTO NACIONAL DE IDENTIDAD", "NUM SOPORT", "SEXO", "NACIONALIDAD", "FECHA DE NACIMIENTO"), -0.3, ("COGNOMS", "EQUIPO", "HIJO/A DE")),
    "ESP_DNI_NEW": Keywords(0.09, ("REINO DE ESPAÑA", "ESPAÑA", "DOCUMENTO NACIONAL DE IDENTIDAD", "DNI", "NUM SOPORTE", "NACIMIENTO/NAIXEMENT", "APELLIDOS / COGNOMS", "NOMBRE / NOM", "EMISIÓN", "DOMICILIO / DOMICILI", "LUGAR DE NACIMIENTO / LLOC", "HIJO/A DE", "NATIONAL IDENTITY CARD")),
    "ECU_DNI_OLD": Keywords(0.13, ("REPUBLICA DEL ECUADOR", "REPÚBLICA DEL ECUADOR", "REGISTRO CIVIL", "CEDULA DE CIUDADANO", "CÉDULA DE CIUDADANO", "ESTADO CIVIL", "APELLIDOS Y NOMBRES", "LUGAR DE NACIMIENTO"), -0.2, ("VENCIMIENTO", "NUI")),
    "ECU_DNI_NEW": Keywords(0.13, ("REPUBLICA DEL ECUADOR", "REPÚBLICA DEL ECUADOR", "CEDULA DE IDENTIDAD", "CÉDULA DE IDENTIDAD", "NUI", "FECHA DE VENCIMIENTO", "NAT/CAN", "CONDICION CIUDADANIA", "LUGAR Y FECHA DE EMISION")),
    "PER_DNI_OLD": Keywords(0.13, ("REPUBLICA DEL PERU", "REPÚBLICA DEL PERÚ", "RENIEC", "DOCUMENTO NACIONAL DE IDENTIDAD", "PRIMER APELLIDO", "SEGUNDO APELLIDO", "PRE NOMBRES", "NACIMIENTO: FECHA Y UBIGEO")),
    "PER_DNI_NEW": Keywords(0.12, ("REPUBLICA DEL PERU", "REPÚBLICA DEL PERÚ", "RENIEC", "DOCUMENTO NACIONAL DE IDENTIDAD", "PRIMER APELLIDO", "PRENOMBRES", "CUI", "DONACIÓN DE ÓRGANOS", "N° DE TARJETA")),
    "PAN_DNI_OLD": Keywords(0.17, ("REPUBLICA DE PANAMA", "REPÚBLICA DE PANAMÁ", "TRIBUNAL ELECTORAL", "FECHA DE NACIMIENTO", "EXPEDIDA", "EXPIRA")),
    "PAN_DNI_NEW": Keywords(0.15, ("REPUBLICA DE PANAMA", "REPÚBLICA DE PANAMÁ", "TRIBUNAL ELECTORAL", "DOCUMENTO DE IDENTIDAD", "FECHA DE NACIMIENTO", "EXPEDIDA", "EXPIRA"), 0.1, ("DOCUMENTO DE IDENTIDAD",)),
}


def types_of(spark: SparkSession) -> dict[str, Keywords]:
    """The document types that the session knows: the library's and its own."""
    return KEYWORDS | added(spark, "types")


def score(upper_text: Column, code: str, types: dict[str, Keywords] | None = None) -> Column:
    """The type's score for an upper-case text, 0 to 1. A penalty keeps it from falling below 0, a bonus from passing 1."""
    k = (types or KEYWORDS)[code]
    points = keyword_hits(upper_text, k.words) * F.lit(k.unit)
    if k.correction:
        points = points + F.when(keyword_hits(upper_text, k.corrected_by) > 0, F.lit(k.correction)).otherwise(F.lit(0.0))
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(1.0))


def scores(texts: DataFrame, keys: list[str], text: str = "text", codes: list[str] | None = None) -> DataFrame:
    """(keys, code, type_score) for every type: one pass, no shuffle. codes: candidates, of one country for instance."""
    types = types_of(texts.sparkSession)
    upper = texts.select(*keys, F.upper(F.col(text)).alias("_upper"))
    each = F.array(*[F.struct(F.lit(c).alias("code"), score(F.col("_upper"), c, types).alias("type_score")) for c in (codes or sorted(types))])
    return upper.select(*keys, F.inline(each))


def best_of(texts: DataFrame, keys: list[str], text: str = "text", codes: list[str] | None = None) -> DataFrame:
    """(keys, code, type_score): the type with the highest score (ties: the first code); UNKNOWN if none is above 0.

    An arg-max over columns of the row itself, so it needs no shuffle.
    """
    types = types_of(texts.sparkSession)
    upper = texts.select(*keys, F.upper(F.col(text)).alias("_upper"))
    each = F.array(*[F.struct((-score(F.col("_upper"), c, types)).alias("by"), F.lit(c).alias("code")) for c in (codes or sorted(types))])
    best = upper.select(*keys, F.array_min(each).alias("best"))
    known = F.col("best.by") < 0
    return best.select(*keys, F.when(known, F.col("best.code")).otherwise("UNKNOWN").alias("code"), F.when(known, -F.col("best.by")).otherwise(F.lit(0.0)).alias("type_score"))


def ranking(texts: DataFrame, keys: list[str], text: str = "text", codes: list[str] | None = None) -> DataFrame:
    """(keys, code, type_score, rank) for every type: by score, then code. The 14 scores are sorted inside the row: no shuffle."""
    types = types_of(texts.sparkSession)
    upper = texts.select(*keys, F.upper(F.col(text)).alias("_upper"))
    # exploding one element keeps the scores from being copied into the sort
    each = F.array(*[F.struct((-score(F.col("_upper"), c, types)).alias("by"), F.lit(c).alias("code")) for c in (codes or sorted(types))])
    ranks = upper.select(*keys, F.posexplode(F.array_sort(each)).alias("_place", "_x"))
    return ranks.select(*keys, F.col("_x.code").alias("code"), (-F.col("_x.by")).alias("type_score"), (F.col("_place") + 1).alias("rank"))


def against(texts: DataFrame, keys: list[str], own: str, text: str = "text") -> DataFrame:
    """(keys, own, own_score, best, best_score): a text's score for its session's type and the best type; no shuffle.

    best is null if no type scores above 0; own_score is null for an unknown type.
    """
    types = types_of(texts.sparkSession)
    upper = texts.select(*keys, F.col(own).alias("own"), F.upper(F.col(text)).alias("_upper"))
    each = F.array(*[F.struct((-score(F.col("_upper"), c, types)).alias("by"), F.lit(c).alias("code")) for c in sorted(types)])
    rows = upper.select(*keys, "own", F.explode(F.array(each)).alias("_all"))
    mine = F.filter("_all", lambda x: x["code"] == F.col("own"))
    rows = rows.select(*keys, "own", (-F.try_element_at(mine, F.lit(1))["by"]).alias("own_score"), F.array_min("_all").alias("_best"))
    return rows.select(*keys, "own", "own_score", F.when(F.col("_best.by") < 0, F.col("_best.code")).alias("best"), (-F.col("_best.by")).alias("best_score"))


def matches_session(own_score: Column, own: Column, best: Column, best_score: Column) -> Column:
    """Whether an image passes for its session's type: a good own score, or no other type with a clear one."""
    return (own_score >= OWN_LEAST) | best.isNull() | (best == own) | (best_score < OTHER_LEAST)


def register(code: str, keywords: Keywords, spark: SparkSession | None = None) -> None:
    """Makes another document type known to a session (the active one, if none is given); a known code is refused."""
    add(spark, "types", KEYWORDS, code, keywords)
