"""Machine-readable zones: finding lines, repairing recognition errors, parsing two formats, and what counts as read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passplane.functions.checkdigits import check_digit_valid
from passplane.functions.text import count_char, mrz_date, pad_or_cut, plausible_mrz_date


def cleaned(line: Column) -> Column:
    """Only the characters of a zone."""
    return F.regexp_replace(F.upper(line), "[^A-Z0-9<]", "")


def looks_like_zone(line: Column) -> Column:
    """Separators, many digits, the beginning of a first line, or a name line whose separators were misread."""
    # fixed values: the least counts and the beginnings of lines
    return (
        (count_char(line, "<") >= 3)
        | (F.length(F.regexp_replace(line, "[^0-9]", "")) >= 12)
        | line.rlike("^P[<KXSC][A-Z]{3}")
        | line.rlike(r"^[IAC][A-Z0-9<][A-Z]{3}\d")
        | line.rlike("^[A-Z]+(?:[KXSC][A-Z]+)*[KXSC]{2,}$")
    )


def normalization_steps() -> list[Callable[[Column], Column]]:
    """Letters that recognition puts for separators turned back, in ordered steps of a line.

    The steps within a line also hit letters that are right; that is the known price of reading degraded lines.
    """

    # fixed values: the letters that stand for separators, and where

    def tail(line: Column) -> Column:
        n = F.length(F.regexp_extract(line, "([KSXCQ]{2,})$", 1))
        return F.concat(line.substr(F.lit(1), F.length(line) - n), F.repeat(F.lit("<"), n))

    def first_letters(line: Column) -> Column:
        line = F.regexp_replace(line, "^P[XKSC]([A-Z]{3})", "P<$1")
        return F.regexp_replace(line, "^1(?=C[A-Z0-9]{3}.{21})", "I")

    def within(line: Column) -> Column:
        rest = F.regexp_replace(line.substr(F.lit(6), F.lit(100)), "([A-Z])([KXSC]{2,})([A-Z])", "$1<<$3")
        return F.concat(F.substring(line, 1, 5), F.regexp_replace(rest, "([A-Z])([KXSC])([A-Z])", "$1<$3"))

    return [tail, first_letters, within, lambda line: F.regexp_replace(line, "[KSXCQ](<+)$", "<$1")]


def could_have_zone(type_has_zone: Column, text: Column) -> Column:
    """Whether it is worth looking for a zone: the type has one, or the text has a run that could be a line of one."""
    return F.coalesce(type_has_zone, F.lit(False)) | F.coalesce(text.rlike("[A-Z0-9<]{26,48}"), F.lit(False))


def _on_line(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["pos"].alias("pos"), step(x["line"]).alias("line"))


def _of_format(form: str) -> Callable[[Column], Column]:
    return lambda x: x["format"] == form


def with_candidates(rows: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Adds the lines of a text that can belong to a zone, as an array of (pos, format, line), repaired and cut to length.

    Steps are columns of their own, so that no step's expression is copied into the next.
    """
    rows = rows.withColumn(out, F.transform(F.split(F.upper(F.col(text)), "\n"), lambda x, i: F.struct(i.alias("pos"), count_char(F.trim(x), " ").alias("spaces"), cleaned(x).alias("line"))))
    rows = rows.withColumn(out, F.filter(out, lambda x: (x["spaces"] <= 4) & F.length(x["line"]).between(26, 48) & looks_like_zone(x["line"])))
    for step in normalization_steps():
        rows = rows.withColumn(out, F.transform(out, _on_line(step)))

    def formed(x: Column) -> Column:
        n = F.length(x["line"])
        form = F.when(n.between(40, 48), "TD3").when(n.between(26, 34), "TD1")
        return F.struct(x["pos"].alias("pos"), form.alias("format"), F.when(n >= 40, pad_or_cut(x["line"], 44)).otherwise(pad_or_cut(x["line"], 30)).alias("line"))

    return rows.withColumn(out, F.filter(F.transform(out, formed), lambda x: x["format"].isNotNull()))


def best_of_prefix(lines: Column) -> Column:
    """Of lines (pos, line) that begin with the same five characters the best: most separators, then longest, then first.

    They stand in the order in which their prefixes first appear.
    """
    prefixes = F.array_distinct(F.transform(lines, lambda x: F.substring(x["line"], 1, 5)))

    def best(prefix: Column) -> Column:
        own = F.filter(lines, lambda x: F.substring(x["line"], 1, 5) == prefix)
        return F.array_min(F.transform(own, lambda x: F.struct((-count_char(x["line"], "<")).alias("by"), (-F.length(x["line"])).alias("longest"), x["pos"].alias("pos"), x["line"].alias("line"))))["line"]

    return F.transform(prefixes, best)


def with_zone_lines(rows: DataFrame, text: str = "text", out: str = "lines") -> DataFrame:
    """Adds the lines of a text's zone: two of 44 if there are two candidates, else three of 30 if there are three.

    Null for no zone. If fewer prefixes than lines are left, the first candidates are taken as they come. A row's zone comes
    from the row alone, so nothing is shuffled.
    """
    rows = with_candidates(rows, text, "_candidates")
    for form in ("TD3", "TD1"):
        rows = rows.withColumn(f"_{form}", F.filter("_candidates", _of_format(form)))
    form = F.when(F.size("_TD3") >= 2, F.col("_TD3")).when(F.size("_TD1") >= 3, F.col("_TD1"))
    rows = rows.withColumn("_own", form).withColumn("_n", F.when(F.size("_TD3") >= 2, 2).otherwise(3))
    rows = rows.withColumn("_best", best_of_prefix(F.col("_own")))
    chosen = F.slice(F.when(F.size("_best") >= F.col("_n"), F.col("_best")).otherwise(F.transform("_own", lambda x: x["line"])), F.lit(1), F.col("_n"))
    return rows.withColumn(out, chosen).drop("_candidates", "_TD3", "_TD1", "_own", "_n", "_best")


def all_letters(line: Column) -> Column:
    """0 and 1 read as O and I."""
    return F.translate(line, "01", "OI")


def repaired(line: Column, length: int, letters_at: Sequence[int]) -> Column:
    """Letters O and I as digits, but at the given places digits 0 and 1 as letters."""
    parts, at = [], 0
    for p in sorted(letters_at):
        if p > at:
            parts.append(F.translate(F.substring(line, at + 1, p - at), "OI", "01"))
        parts.append(F.translate(F.substring(line, p + 1, 1), "01", "OI"))
        at = p + 1
    parts.append(F.translate(F.substring(line, at + 1, length - at), "OI", "01"))
    return F.concat(*parts)


def _span(line: Column, a: int, b: int) -> Column:
    return F.substring(line, a + 1, b - a)


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<"))


def _words(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("<"), F.lit(" ")))


def _colombian_number(tail: Column, number: Column) -> Column:
    """The personal number at the end of the second line; without a separator its last digit is the composite digit."""
    apart = F.regexp_extract(tail, r"^(\d{6,})<+\d?<*$", 1)
    joined = F.regexp_extract(tail, r"^(\d{6,})$", 1)
    joined = F.when(F.length(joined) > 6, joined.substr(F.lit(1), F.length(joined) - 1)).otherwise(joined)
    found = F.coalesce(F.nullif(apart, F.lit("")), F.nullif(joined, F.lit("")), F.regexp_extract(tail, r"(\d{6,})", 1))
    return F.when(found != "", F.regexp_replace(found, "^0+", "")).otherwise(number)


def _apart(rows: DataFrame, out: str, **steps: Column) -> tuple[DataFrame, list[Column]]:
    """The caller's row as one column beside the first steps, so that no name clashes, and its columns without out."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[c.alias(n) for n, c in steps.items()])
    return packed, [F.col("_row")[c].alias(c) for c in rows.columns if c != out]


def with_zone(rows: DataFrame, lines: str = "lines", out: str = "zone") -> DataFrame:
    """Adds the struct of a zone's two lines of 44 or three of 30; null for none.

    Lines, then fields, then checks are columns of their own, so that the many substrings refer to short columns.
    """
    rows, kept = _apart(rows, out, _lines=F.col(lines))
    line = F.col("_lines")
    td3 = F.col("_td3")
    rows = rows.withColumn("_td3", F.size(line) == 2)
    rows = rows.withColumns(
        {
            "_a": F.when(td3, all_letters(pad_or_cut(line[0], 44))).otherwise(repaired(pad_or_cut(line[0], 30), 30, (0, 1, 2, 3, 4))),
            "_b": F.when(td3, repaired(pad_or_cut(line[1], 44), 44, (10, 11, 12, 20))).otherwise(repaired(pad_or_cut(line[1], 30), 30, (7, 15, 16, 17))),
            "_c": F.when(~td3, all_letters(pad_or_cut(F.try_element_at(line, F.lit(3)), 30))),
        }
    )
    a, b, by = F.col("_a"), F.col("_b"), lambda x, y: F.when(td3, x).otherwise(y)
    rows = rows.withColumns(
        {
            "_number": by(_span(b, 0, 9), _span(a, 5, 14)), "_number_digit": by(_span(b, 9, 10), _span(a, 14, 15)), "_birth": by(_span(b, 13, 19), _span(b, 0, 6)), "_birth_digit": by(_span(b, 19, 20), _span(b, 6, 7)),
            "_expiry": by(_span(b, 21, 27), _span(b, 8, 14)), "_expiry_digit": by(_span(b, 27, 28), _span(b, 14, 15)), "_country": _plain(_span(a, 2, 5)), "_tail": _span(b, 18, 30), "_names": F.regexp_replace(by(_span(a, 5, 44), F.col("_c")), "<+$", ""),
            "_composite": by(F.concat(_span(b, 0, 10), _span(b, 13, 20), _span(b, 21, 43)), F.concat(_span(a, 5, 30), _span(b, 0, 7), _span(b, 8, 15), _span(b, 18, 29))), "_composite_digit": by(_span(b, 43, 44), _span(b, 29, 30)),
        }
    )
    at = F.instr("_names", F.lit("<<"))
    rows = rows.withColumn("_at", at).withColumns(
        {
            "_document": F.when(~td3 & (F.col("_country") == "COL"), _colombian_number(F.col("_tail"), _plain(F.col("_number")))).otherwise(_plain(F.col("_number"))),
            "_surnames": F.when(F.col("_at") > 1, _words(F.col("_names").substr(F.lit(1), F.col("_at") - 1))).otherwise(_words(F.col("_names"))),
            "_given": F.when(F.col("_at") > 1, _words(F.col("_names").substr(F.col("_at") + 2, F.length("_names")))).otherwise(""),
            **{f"_{x}_valid": check_digit_valid(F.col(f"_{x}"), F.col(f"_{x}_digit"), n) for x, n in (("number", 9), ("birth", 6), ("expiry", 6), ("composite", 50))},
        }
    )
    valid = [F.col(f"_{x}_valid") for x in ("number", "birth", "expiry", "composite")]
    zone = F.struct(
        by(F.lit("TD3"), F.lit("TD1")).alias("format"), _plain(_span(a, 0, 2)).alias("document_code"), F.col("_country").alias("issuing_country"), F.col("_document").alias("document_number"), F.col("_birth").alias("date_of_birth"),
        by(_span(b, 20, 21), _span(b, 7, 8)).alias("sex"), F.col("_expiry").alias("expiry_date"), _plain(by(_span(b, 10, 13), _span(b, 15, 18))).alias("nationality"), F.col("_surnames").alias("surnames"), F.col("_given").alias("given_names"),
        _words(by(_span(b, 28, 42), _span(b, 18, 29))).alias("optional_data"), *[v.alias(f"{x}_valid") for v, x in zip(valid, ("number", "birth", "expiry", "composite"), strict=True)], (valid[0] & valid[1] & valid[2] & valid[3]).alias("all_valid"),
    )
    # exploding one element keeps filters on the zone from being copied below, expression by expression
    return rows.select(*kept, F.explode(F.array(F.when(F.size(line) >= 2, zone))).alias(out))


def valid_count(zone: Column) -> Column:
    """How many check digits hold, 0 to 3: of the number, and of the two dates where these are plausible."""
    dated = lambda valid, c: (zone[valid] & plausible_mrz_date(zone[c])).cast("int")
    return zone["number_valid"].cast("int") + dated("birth_valid", "date_of_birth") + dated("expiry_valid", "expiry_date")


def gate(valid: Column) -> Column:
    """DROP without a valid digit, DISPLAY with one, ENRICH from two on."""
    return F.when(valid == 0, "DROP").when(valid == 1, "DISPLAY").otherwise("ENRICH")


def fields(zone: Column) -> Column:
    """What a zone says about fields, as an array of (field, value); blank values are left out."""
    item = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    found = F.array(
        item("apellidos", zone["surnames"]), item("nombres", zone["given_names"]), item("documentNumber", zone["document_number"]), item("fechaNacimiento", mrz_date(zone["date_of_birth"])),
        item("fechaVencimiento", mrz_date(zone["expiry_date"])), item("sexo", zone["sex"]), item("nacionalidad", zone["nationality"]),
    )
    return F.filter(found, lambda x: F.trim(x["value"]) != "")


def contract(zone: Column) -> Column:
    """The zone in the contract: format, check digits and the fields that are not blank."""
    named = {
        "documentNumber": zone["document_number"], "lastNames": zone["surnames"], "firstNames": zone["given_names"], "birthDate": mrz_date(zone["date_of_birth"]), "expiryDate": mrz_date(zone["expiry_date"]),
        "sex": zone["sex"], "nationality": zone["nationality"], "issuingCountry": zone["issuing_country"], "documentCode": zone["document_code"],
    }
    values = F.create_map(*[x for name, c in named.items() for x in (F.lit(name), c)])
    return F.struct(zone["format"].alias("format"), F.struct(F.lit(3).alias("total"), valid_count(zone).alias("valid")).alias("check_digits"), F.map_filter(values, lambda _, v: F.trim(v) != "").alias("fields"))


# A passport's zone is checked apart: strictly, then by its structure, then at an anchor.

# The places of a second line's parts.
STRUCTURE = r"([A-Z0-9]{2}\d{6})<?(\d)([A-Z0]{3})(\d{6})(\d)([MF])(\d{6})(\d)"


def _strict(rows: DataFrame, line2: str, out: str) -> DataFrame:
    """Adds whether all four digits of a second line hold; here the composite leaves out the last place of the optional data."""
    b = F.col(line2)
    parts = {"number": (_span(b, 0, 9), 9, 9), "birth": (_span(b, 13, 19), 19, 6), "expiry": (_span(b, 21, 27), 27, 6), "all": (F.concat(_span(b, 0, 10), _span(b, 13, 20), _span(b, 21, 42)), 43, 38)}
    rows = rows.withColumns({f"_{k}": data for k, (data, _, _) in parts.items()})
    holds = [check_digit_valid(F.col(f"_{k}"), _span(b, at, at + 1), n, strict=False) for k, (_, at, n) in parts.items()]
    return rows.withColumn(out, holds[0] & holds[1] & holds[2] & holds[3]).drop(*[f"_{k}" for k in parts])


def with_passport_check(rows: DataFrame, text: str = "text", out: str = "check") -> DataFrame:
    """Adds a struct (detected, valid, wrong_format) of a passport's text."""
    rows, kept = _apart(rows, out, _lines=F.transform(F.split(F.upper(F.col(text)), "\n"), cleaned))
    rows = rows.withColumn("_joined", F.array_join("_lines", ""))
    card = lambda x: F.length(x).between(26, 34) & ~x.startswith("P") & (x.rlike(r"^[IAC1][A-Z<][A-Z0-9]{3}\d{5,}") | x.rlike(r"^\d{7}[MF]\d{7}[A-Z0-9]{3}"))
    rows = rows.withColumn("_long", F.transform(F.filter("_lines", lambda x: F.length(x).between(40, 48)), lambda x: pad_or_cut(x, 44))).withColumn("_cards", F.size(F.filter("_lines", card)))
    rows = rows.withColumn("_first", F.try_element_at(F.filter("_long", lambda x: x.startswith("P")), F.lit(1)))
    rows = rows.withColumn("_second", F.coalesce(F.try_element_at(F.filter("_long", lambda x: x != F.col("_first")), F.lit(1)), F.try_element_at("_long", F.lit(2))))
    rows = rows.withColumns({f"_g{g}": F.regexp_extract("_joined", STRUCTURE, g) for g in (1, 2, 4, 5, 7, 8)})
    rows = rows.withColumn("_g1", pad_or_cut(F.col("_g1"), 9))
    held = sum((check_digit_valid(F.col(a), F.col(b), n).cast("int") for a, b, n in (("_g4", "_g5", 6), ("_g7", "_g8", 6))), check_digit_valid(F.col("_g1"), F.col("_g2"), 9).cast("int"))
    at = F.regexp_instr("_joined", F.lit("P[<KXSC][A-Z]{3}"))
    rows = rows.withColumn("_held", held).withColumn("_at", at).withColumn("_anchored", F.when((F.col("_at") > 0) & (F.length("_joined") - F.col("_at") + 1 >= 88), F.col("_joined").substr(F.col("_at") + 44, F.lit(44))))
    rows = _strict(_strict(rows, "_second", "_strict"), "_anchored", "_anchor_valid")
    two, structured = (F.size("_long") >= 2) & F.col("_first").isNotNull(), (F.col("_g2") != "") & (F.col("_held") >= 2)
    result = lambda detected, valid, wrong=False: F.struct(F.lit(detected).alias("detected"), (valid if isinstance(valid, Column) else F.lit(valid)).alias("valid"), F.lit(wrong).alias("wrong_format"))
    check = (
        F.when(two & F.col("_strict"), result(True, True))
        .when(two & structured, result(True, F.col("_held") == 3))
        .when(two, result(True, False))
        .when(F.col("_cards") >= 2, result(True, False, True))
        .when(structured, result(True, F.col("_held") == 3))
        .when(F.col("_anchored").isNotNull(), result(True, F.col("_anchor_valid")))
        .otherwise(result(False, False))
    )
    return rows.select(*kept, F.explode(F.array(check)).alias(out))


def passport_mrz_score(check: Column) -> Column:
    """1 for a valid zone, 0.4 for one with errors, 0.1 for none."""
    return F.when(check["valid"], 1.0).when(check["detected"], 0.4).otherwise(0.1)
