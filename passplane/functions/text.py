"""String and date functions as Columns. Blank results are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month abbreviations. Others, English ones too, stay as they are.
MONTHS = {"ENE": "01", "ENER": "01", "FEB": "02", "MAR": "03", "ABR": "04", "MAY": "05", "JUN": "06", "JUL": "07", "AGO": "08", "SEP": "09", "SEPT": "09", "OCT": "10", "NOV": "11", "DIC": "12"}


def literal_map(values: dict) -> Column:
    """A map column of constants."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_to_null(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The trimmed group of the first match; null without one. White space of any kind is trimmed."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, group), r"^\s+|\s+$", ""), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def comparable(c: Column) -> Column:
    """Upper case with only letters of Spanish, digits and spaces; null if blank."""
    return blank_to_null(F.regexp_replace(F.upper(c), "[^A-Z0-9ÑÁÉÍÓÚ ]", ""))


def keyword_hits(upper_text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the upper-case text contains, each once."""
    return sum((F.contains(upper_text, F.lit(k.upper())).cast("int") for k in keywords), F.lit(0))


def count_char(c: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(char)))


def pad_or_cut(c: Column, n: int) -> Column:
    """Exactly n characters: filled with < or cut."""
    return F.rpad(c, n, "<")


def strip_zeros(c: Column, keep_all_zero: bool) -> Column:
    """Without leading zeros. Of zeros only: as it is, or empty."""
    cut = F.regexp_replace(c, "^0+", "")
    return F.when(cut == "", c).otherwise(cut) if keep_all_zero else cut


def sliced_date(c: Column) -> Column:
    """yyyymmdd as yyyy-mm-dd."""
    return F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-"), F.substring(c, 7, 2))


def full_year(yy: Column) -> Column:
    """The four digits of a two-digit year: over 30 the 1900s."""
    return F.concat(F.when(yy > "30", "19").otherwise("20"), yy)


def mrz_date(c: Column) -> Column:
    """yymmdd as yyyy-mm-dd; anything else unchanged."""
    return F.when(c.rlike(r"^\d{6}$"), F.concat_ws("-", full_year(F.substring(c, 1, 2)), F.substring(c, 3, 2), F.substring(c, 5, 2))).otherwise(c)


def plausible_mrz_date(c: Column) -> Column:
    """Six digits with a month of 1 to 12 and a day of 1 to 31; the length of months is not checked."""
    return F.coalesce(c.rlike(r"^\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"), F.lit(False))


def iso_date(raw: Column) -> Column:
    """Eight printed forms as yyyy-mm-dd; others upper-cased and else unchanged. Calendars are not checked.

    yymmdd; yyyy-mm-dd; yyyy/mm/dd; dd/mm/yyyy and dd-mm-yyyy; dd-MMM-yyyy; dd MMM yyyy; dd mm yyyy.
    """
    c = F.upper(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    month = F.regexp_extract(c, r"^\d{2}.([A-Z]{3,4}).\d{4}$", 1)
    named = F.concat_ws("-", F.right(c, F.lit(4)), F.coalesce(F.element_at(literal_map(MONTHS), month), month), F.substring(c, 1, 2))
    numeric = F.concat_ws("-", F.right(c, F.lit(4)), F.substring(c, 4, 2), F.substring(c, 1, 2))
    return (
        F.when(c.rlike(r"^\d{6}$"), mrz_date(c))
        .when(c.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.replace(c, F.lit("/"), F.lit("-")))
        .when(c.rlike(r"^\d{2}[/\-]\d{2}[/\-]\d{4}$") | c.rlike(r"^\d{2}\s\d{2}\s\d{4}$"), numeric)
        .when(c.rlike(r"^\d{2}-[A-Z]{3,4}-\d{4}$") | c.rlike(r"^\d{2}\s[A-Z]{3,4}\s\d{4}$"), named)
        .otherwise(c)
    )


def parsed_date(c: Column) -> Column:
    """yyyy-mm-dd as a date; null if it is none."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def capital_run(c: Column) -> Column:
    """The first run of three or more capitals and spaces; null without one."""
    found = first_group(c, "([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{2,})")
    return F.when(F.length(found) >= 3, found)


def passport_name(c: Column) -> Column:
    """A name line without what follows it: digits and marks, then label words, then other signs."""
    c = F.trim(F.regexp_replace(c, r"[\d\-.,;:!?]+$", ""))
    c = F.trim(F.regexp_replace(c, r"(?i)\b(Nombres|Given|names|Surname|Apellidos|Nationality|Nacionalidad)\b.*", ""))
    return blank_to_null(F.regexp_replace(c, "[^A-ZÁÉÍÓÚÑa-záéíóúñ]+$", ""))


def surname_lines(c: Column) -> Column:
    """The lines of a block that are names, joined: no digits, letters only, two at least, not a label."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"\d"))
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[^A-ZÁÉÍÓÚÑa-záéíóúñ\s]", "")))
    return blank_to_null(F.array_join(F.filter(clean, lambda x: (F.length(x) >= 2) & (F.upper(x) != "NUI")), " "))


def sex_letter(c: Column) -> Column:
    """HOMBRE as M, MUJER as F, others in upper case."""
    up = F.upper(c)
    return F.when(up.startswith("H"), "M").when(up.startswith("MU"), "F").otherwise(up)


def compound(first: Column, second: Column) -> Column:
    """first, then second if there is one; null without first."""
    return F.when(first.isNotNull(), F.concat_ws(" ", first, second))


def rounded(c: Column, digits: int = 3) -> Column:
    """Rounded half up (toward plus infinity)."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def both_passes(normal: Column, inverted: Column) -> Column:
    """The texts recognised on a picture and on its negative, one after the other; the first alone if the second is blank."""
    return F.when(F.trim(F.coalesce(inverted, F.lit(""))) == "", normal).otherwise(F.concat_ws("\n", normal, inverted))
