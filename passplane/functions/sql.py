"""The library's functions for SQL: defined in SQL itself (CREATE FUNCTION ... RETURN), so they stay in the JVM, and held by the session that
defines them, where any query can use them by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from passplane.functions.checkdigits import DIGITS_AND_LETTERS
from passplane.functions.text import MONTHS
from passplane.operators import classify

_TEN = r"'^[0-9]{10}$'"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _date_body() -> str:
    """As `text.iso_date`."""
    months = ", ".join(f"'{k}', '{v}'" for k, v in MONTHS.items())
    day_first = r"'^[0-9]{2}[/\\-][0-9]{2}[/\\-][0-9]{4}$'"
    return (
        "CASE WHEN t RLIKE '^[0-9]{6}$' THEN concat_ws('-', concat(IF(substring(t, 1, 2) > '30', '19', '20'), substring(t, 1, 2)), substring(t, 3, 2), substring(t, 5, 2)) "
        "WHEN t RLIKE '^[0-9]{4}/[0-9]{2}/[0-9]{2}$' THEN replace(t, '/', '-') "
        f"WHEN t RLIKE {day_first} OR t RLIKE '^[0-9]{{2}}\\\\s[0-9]{{2}}\\\\s[0-9]{{4}}$' THEN concat_ws('-', right(t, 4), substring(t, 4, 2), substring(t, 1, 2)) "
        "WHEN t RLIKE '^[0-9]{2}-[A-Z]{3,4}-[0-9]{4}$' OR t RLIKE '^[0-9]{2}\\\\s[A-Z]{3,4}\\\\s[0-9]{4}$' THEN concat_ws('-', right(t, 4), "
        f"coalesce(element_at(map({months}), regexp_extract(t, '^[0-9]{{2}}.([A-Z]{{3,4}}).[0-9]{{4}}$', 1)), regexp_extract(t, '^[0-9]{{2}}.([A-Z]{{3,4}}).[0-9]{{4}}$', 1)), substring(t, 1, 2)) ELSE t END"
    )


def _type_body(types: dict[str, classify.Keywords]) -> str:
    """The code of the best score, as `classify.best_of`, for an upper-case text t."""

    def score(k: classify.Keywords) -> str:
        hits = lambda words: " + ".join(f"CAST(contains(t, {_quoted(w.upper())}) AS INT)" for w in words) or "0"
        points = f"({hits(k.words)}) * {k.unit}D"
        if k.correction:
            points += f" + IF({hits(k.corrected_by)} > 0, {k.correction}D, 0D)"
        return f"least(greatest({points}, 0D), 1D)"

    each = ", ".join(f"named_struct('by', -{score(types[c])}, 'code', {_quoted(c)})" for c in sorted(types))
    return f"CASE WHEN t IS NULL THEN 'UNKNOWN' ELSE aggregate(array({each}), named_struct('by', 0D, 'code', 'UNKNOWN'), (a, x) -> IF(x.by < a.by, x, a)).code END"


def definitions(types: dict[str, classify.Keywords]) -> dict[str, tuple[str, str, str]]:
    """Parameters, type and body of each function, by name, in the order of definition."""
    weights = "element_at(array(7, 3, 1), (i - 1) % 3 + 1)"
    double = "CAST(substring(number, i, 1) AS INT) * (1 + i % 2)"
    return {
        "pp_zone_digit": ("data STRING", "INT", f"CASE WHEN data = '' THEN 0 ELSE aggregate(sequence(1, length(data)), 0, (a, i) -> a + greatest(instr('{DIGITS_AND_LETTERS}', substring(data, i, 1)) - 1, 0) * {weights}) % 10 END"),
        "pp_zone_digit_valid": ("data STRING, digit STRING", "BOOLEAN", "coalesce(digit RLIKE '^[0-9]$' AND data RLIKE '^[A-Z0-9<]*$' AND pp_zone_digit(data) = try_cast(digit AS INT), false)"),
        "pp_ecuador_valid": ("number STRING", "BOOLEAN", f"coalesce(CASE WHEN number RLIKE {_TEN} THEN (10 - aggregate(sequence(1, 9), 0, (a, i) -> a + IF({double} > 9, {double} - 9, {double})) % 10) % 10 = CAST(substring(number, 10, 1) AS INT) END, false)"),
        "pp_upper_trimmed": ("raw STRING", "STRING", "upper(regexp_replace(raw, '^\\\\s+|\\\\s+$', ''))"),
        "pp_date_of": ("t STRING", "STRING", _date_body()),
        "pp_date": ("raw STRING", "STRING", "pp_date_of(pp_upper_trimmed(raw))"),
        "pp_type_of": ("t STRING", "STRING", _type_body(types)),
        "pp_document_type": ("raw STRING", "STRING", "pp_type_of(upper(raw))"),
    }


def define(spark: SparkSession) -> list[str]:
    """Defines the functions in the session, for its own document types too, and gives their names. Again after a type was registered."""
    functions = definitions(classify.types_of(spark))
    for name, (parameters, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(functions)
