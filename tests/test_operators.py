"""Operators on small invented inputs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passplane.functions import checkdigits, sql, text
from passplane.operators import authenticity, barcode, catalog, classify, consolidate, decision, extract, measures, mrz, raster, scoring, sessions
from tests.test_functions import icao


def test_decision_order(spark):
    schema = "id int, veto boolean, expired boolean, photo_suspect boolean, mismatch boolean, score double, document_number string"
    rows = [(1, True, True, True, True, 0.1, None), (2, False, True, True, True, 0.1, None), (3, None, None, None, None, 0.9, "1"), (4, False, False, True, True, None, None), (5, False, False, False, False, 0.69, "1")]
    got = {r.id: (r.outcome, r.reasons) for r in decision.decide(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("REJECTED", ["AUTHENTICITY_VETO"]), 2: ("REJECTED", ["DOCUMENT_EXPIRED"]), 3: ("APPROVED", []), 4: ("REVIEW", ["PHOTO_SUBSTITUTION_SUSPECT", "FRONT_BACK_MISMATCH", "AUTHENTICITY_UNAVAILABLE", "DOCUMENT_NUMBER_NOT_READ"]), 5: ("REVIEW", ["LOW_AUTHENTICITY_SCORE"])}


def test_a_veto_never_helps(spark):
    rank = {"REJECTED": 0, "REVIEW": 1, "APPROVED": 2}
    rows = [(k, bool(k & 1), bool(k & 2), bool(k & 4), 0.5 + (k & 8) / 20, "1" if k & 16 else None) for k in range(32)]
    schema = "id int, expired boolean, photo_suspect boolean, mismatch boolean, score double, document_number string"
    base = spark.createDataFrame(rows, schema)
    by = [{r.id: rank[r.outcome] for r in decision.decide(base.withColumn("veto", F.lit(v))).collect()} for v in (False, True)]
    assert all(by[1][i] <= by[0][i] for i in by[0])


@pytest.mark.parametrize(("front", "back", "want"), [(0.9, 0.8, 0.855), (0.9, 0.5, 0.5), (0.6, None, 0.6), (None, 0.71234, 0.71234), (None, None, None)])
def test_worst_face(spark, front, back, want):
    assert spark.createDataFrame([(front, back)], "f double, b double").select(decision.worst_face(F.col("f"), F.col("b"))).first()[0] == want


def test_best_values_take_the_first_of_equals(spark):
    rows = [(1, "n", "a", 0.9, 2), (1, "n", "b", 0.9, 1), (1, "n", "c", 0.8, 0), (1, "m", None, 0.0, 3)]
    got = consolidate.best_values(spark.createDataFrame(rows, "id int, field string, value string, confidence double, ord int"), ["id", "field"], ["ord"]).collect()
    assert {(r.field, r.value) for r in got} == {("n", "b"), ("m", None)}


def test_merges(spark):
    fields = spark.createDataFrame([(1, "a", "x", 0.96), (1, "b", "x", 0.90), (1, "c", None, 0.0)], "id int, field string, value string, confidence double")
    other = spark.createDataFrame([(1, "a", "z"), (1, "b", "z"), (1, "c", "z"), (1, "d", "z"), (1, "e", " ")], "id int, field string, value string")
    got = {r.field: (r.value, r.confidence) for r in consolidate.enrich_from_mrz(fields, other, ["id", "field"]).collect()}
    assert got == {"a": ("x", 0.96), "b": ("z", 0.97), "c": ("z", 0.97), "d": ("z", 0.98)}
    got = {r.field: (r.value, r.confidence) for r in consolidate.enrich_from_barcode(fields, other, ["id", "field"]).collect()}
    assert got == {f: ("z", 1.0) for f in "abcd"}


def test_sessions(spark):
    t = datetime.datetime(2020, 1, 1, 10)
    rows = spark.createDataFrame([(t, "IN_PROGRESS"), (t, "COMPLETED")], "created timestamp, status string").withColumn("e", sessions.deadline(F.col("created")))
    at = lambda m: F.lit(t + datetime.timedelta(minutes=m))
    assert [r[0] for r in rows.select(sessions.lazily_expired(F.col("status"), F.col("e"), at(30))).collect()] == ["IN_PROGRESS", "COMPLETED"]
    assert [r[0] for r in rows.select(sessions.lazily_expired(F.col("status"), F.col("e"), at(31))).collect()] == ["EXPIRED", "COMPLETED"]
    tries = spark.createDataFrame([(1, "FRONT", 1, "a"), (1, "FRONT", 2, "b"), (1, "BACK", 3, "c")], "s int, side string, n int, image string")
    for replace, want in ((False, {"FRONT": "a", "BACK": "c"}), (True, {"FRONT": "b", "BACK": "c"})):
        assert {r.side: r.image for r in sessions.kept_capture(tries, ["s", "side"], ["n"], replace).collect()} == want


def test_catalog(spark):
    rows = catalog.sorted_catalog(spark).collect()
    assert len(rows) == 14 and [r.code for r in rows] == sorted(r.code for r in rows)
    asked = spark.createDataFrame([("COL_PA",), ("NONE",)], "document_type string")
    assert catalog.with_type(asked).first().sides == ["FRONT"] and catalog.unsupported(asked).first()[0] == "NONE"


def test_classification(spark):
    texts = spark.createDataFrame([(1, "passport  Republic of Colombia, date of birth"), (2, "nothing"), (3, "cedula de ciudadania\nrepublica de colombia digital estatura")], "id int, text string")
    got = {r.id: (r.code, round(r.type_score, 2)) for r in classify.best_of(texts, ["id"]).collect()}
    assert got[1] == ("COL_PA", 0.39) and got[2] == ("UNKNOWN", 0.0) and got[3] == ("COL_CC_NEW", 0.26)
    ranks = classify.ranking(texts, ["id"]).where("id = 2").orderBy("rank").collect()
    assert [r.code for r in ranks] == sorted(classify.KEYWORDS) and len(ranks) == 14


# an invented passport of the specimen state, without optional data
TD3 = ["P<UTOALTO<<ANNA<MAR<<<<<<<<<<<<<<<<<<<<<<<<<", "QZ55501X9", "500229", "310815"]
TD3[1] = f"{TD3[1]}{icao(TD3[1])}UTO{TD3[2]}{icao(TD3[2])}F{TD3[3]}{icao(TD3[3])}<<<<<<<<<<<<<<<"
del TD3[2:]
TD3[1] += str(icao(TD3[1][:10] + TD3[1][13:20] + TD3[1][21:43]))


def test_zone_of_a_text(spark):
    rows = spark.createDataFrame([(1, "Un texto que no es zona\n" + "\n".join(TD3)), (2, "solo prosa, sin nada"), (3, None), (4, "\n".join([TD3[0]] * 2))], "id int, text string")
    got = {r.id: r for r in mrz.with_zone(mrz.with_zone_lines(rows)).select("id", "lines", "zone", mrz.valid_count(F.col("zone")).alias("n")).collect()}
    z = got[1].zone
    assert (z.format, z.document_number, z.surnames, z.given_names, z.sex, z.nationality) == ("TD3", "QZ55501X9", "ALTO", "ANNA MAR", "F", "UTO")
    assert z.number_valid and z.birth_valid and z.expiry_valid and z.composite_valid and got[1].n == 3
    assert got[2].zone is None and got[3].zone is None and len(got[4].lines) == 2


def test_misread_separators_are_repaired(spark):
    worn = ["PKUTOALTOKKANNAKMARKKKKKKKKKKKKKKKKKKKKKKKKK", TD3[1]]
    zone = mrz.with_zone(mrz.with_zone_lines(spark.createDataFrame([("\n".join(worn),)], "text string"))).first().zone
    assert (zone.surnames, zone.given_names, zone.issuing_country) == ("ALTO", "ANNA MAR", "UTO")


def test_passport_check(spark):
    texts = {"good": "\n".join(TD3), "wrong": "\n".join([TD3[0], TD3[1][:-1] + str((int(TD3[1][-1]) + 1) % 10)]), "none": "hola", "joined": "x " + "".join(TD3)}
    got = {r.id: r.check for r in mrz.with_passport_check(spark.createDataFrame(list(texts.items()), "id string, text string")).collect()}
    assert (got["good"].detected, got["good"].valid) == (True, True) and (got["wrong"].detected, got["wrong"].valid) == (True, False) and not got["none"].detected
    assert got["joined"].detected


def test_callers_columns_stay(spark):
    rows = spark.createDataFrame([("\n".join(TD3), "m", "c", 7, "COL_PA")], "text string, _meta string, code string, _a int, document_type string")
    zone = mrz.with_zone(mrz.with_zone_lines(rows))
    assert zone.columns == [*rows.columns, "lines", "zone"] and zone.first()._meta == "m" and zone.first()._a == 7
    assert mrz.with_passport_check(rows).columns == [*rows.columns, "check"] and mrz.with_passport_check(rows).first().code == "c"
    assert catalog.with_type(rows).first().code == "c" and "_known_code" not in catalog.with_type(rows).columns


def test_barcodes(spark):
    rows = spark.createDataFrame([("E-3332221-66655544-M-0001234567-20110502",), ("E-3332221\n66655544 - f- 0001234567\n20110502",), ("QR 1",), (None,)], "t string")
    got = [r.b for r in rows.select(barcode.parse(F.col("t")).alias("b")).collect()]
    assert (got[0].series, got[0].sequence, got[0].sex, got[0].number, got[0].issued) == ("E-3332221", "66655544", "M", "1234567", "2011-05-02")
    assert (got[1].parsed, got[1].sex, got[1].number, got[1].issued) == (True, "F", "1234567", "2011-05-02") and not got[2].parsed and not got[3].parsed


def test_extraction_fallbacks(spark):
    old = spark.createDataFrame([(1, "12.345.678\nNUMERO\nP-7778889-11122233-F 007654321"), (2, "E-3332221-66655544-M-0001234567-20110502")], "id int, text string")
    got = {(r.id, r.field): (r.value, r.confidence) for r in extract.extract(old, ["id"], "COL_CC_OLD").collect()}
    assert got[1, "documentNumber"] == ("12345678", 0.90) and got[1, "codigoInferior"] == ("P-7778889-11122233-F 007654321", 0.60)
    assert got[2, "documentNumber"] == ("1234567", 0.97) and got[2, "fechaGeneracionCodigo"] == ("2011-05-02", 0.96)
    peru = spark.createDataFrame([(1, "DNI 20304050\nPrimer Apellido\nALTO\n")], "id int, text string")
    got = {r.field: (r.value, r.confidence) for r in extract.extract(peru, ["id"], "PER_DNI_NEW").collect()}
    assert got == {"documentNumber": ("20304050", 0.88), "primerApellido": ("ALTO", 0.88), "apellidos": ("ALTO", 0.88)}
    assert extract.extract(peru.where("id = 2"), ["id"], "ESP_DNI_NEW").count() == 0


def test_scores_and_vetoes(spark):
    rows = [(1, "RECAPTURE_DETECTION", 0.9, False), (1, "TAMPERING_DETECTION", 0.5, False), (2, "RECAPTURE_DETECTION", 0.5, True), (2, "OTHER", 1.0, True)]
    got = {r.id: (round(r.side_score, 4), r.veto) for r in authenticity.combine(spark.createDataFrame(rows, "id int, analyzer string, score double, is_passport boolean"), ["id"]).collect()}
    assert got == {1: (0.55, True), 2: (round((0.5 * 0.3 + 0.25) / 0.55, 4), False)}


def test_lbp_against_loops(spark):
    rng = np.random.default_rng(0)
    picture = rng.integers(0, 256, (7, 9))
    rows = [(1, y, x, int(picture[y, x])) for y in range(7) for x in range(9)]
    want = {}
    for y in range(1, 6):
        for x in range(1, 8):
            around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
            code = sum(int(picture[y + a, x + b] >= picture[y, x]) << (7 - k) for k, (a, b) in enumerate(around))
            want[raster.uniform_bins()[code]] = want.get(raster.uniform_bins()[code], 0) + 1 / 35
    got = {r.bin: r.share for r in raster.lbp_histogram(spark.createDataFrame(rows, "image_id long, y int, x int, g int")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and max(raster.uniform_bins()) == 58


def test_spectrum_against_loops():
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (7, 9)).astype(float)
    high, wide = raster.transform_size(7), raster.transform_size(9)
    assert (high, wide, raster.transform_size(1), raster.transform_size(131)) == (8, 9, 1, 135)
    log = np.zeros((high, wide))
    for v in range(high):
        for u in range(wide):
            total = sum(picture[y, x] * np.exp(-2j * np.pi * (v * y / high + u * x / wide)) for y in range(7) for x in range(9))
            log[(v + high // 2) % high, (u + wide // 2) % wide] = np.log1p(abs(total))
    want = (log - log.min()) / (log.max() - log.min())
    assert np.allclose(raster.spectrum(picture), want)
    reach, norm, ring_sum, peaks, peak_sum = min(high, wide) // 2, 0, 0.0, 0, 0.0
    for y in range(high):
        for x in range(wide):
            r = np.hypot(y - high // 2, x - wide // 2)
            if int(reach * 0.15) <= r <= int(reach * 0.40):
                ring_sum += want[y, x]
                norm += want[y, x] > 0.78
            if r > reach // 5 and want[y, x] > 0.75:
                peaks, peak_sum = peaks + 1, peak_sum + want[y, x]
    got = raster.halftone(picture)
    assert abs(got["peaks"] - norm / (want.size + 1)) < 1e-12 and abs(got["band"] - ring_sum / want.sum()) < 1e-9
    got = raster.moire(picture)
    assert abs(got["peaks"] - peaks / (want.size + 1)) < 1e-12 and abs(got["ratio"] - peak_sum / want.sum()) < 1e-9


def test_kernels_see_what_they_are_for():
    y, x = np.indices((130, 200))
    dots, flat = np.where((x % 20 == 0) & (y % 20 == 0), 220.0, 0.0), np.full((130, 200), 120.0)
    assert raster.halftone(dots)["score"] < 0.35 and raster.halftone(np.random.default_rng(0).normal(128, 30, (130, 200)))["score"] == 1.0
    scattered = np.where(np.random.default_rng(1).random((130, 200)) < 0.01, 255.0, 0.0)
    assert raster.moire(scattered)["score"] < 0.4 and raster.moire(flat)["score"] == 1.0
    patch = flat.copy()
    patch[:16, :16] = 250
    assert raster.illumination(patch)["score"] < 1 and raster.illumination(flat) == {"cv": 0.0, "score": 1.0}
    assert raster.soft_weights(51).sum() == 256


def _pixels(spark, *pictures):
    rows = [(k, y, x, int(v), int(v), int(v), int(v)) for k, p in enumerate(pictures) for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, g int, b int, r int, e int").withColumn("e", F.col("e").cast("double"))


def test_measures_of_tiny_and_no_pictures(spark):
    """Pictures too small for a measure have the score that says nothing could be seen."""
    rows = _pixels(spark, np.array([[7]]), np.arange(6).reshape(1, 6), np.full((5, 3), 255))
    score = lambda found: {r.image_id: r.score for r in found.collect()}
    assert score(measures.sharpness(rows)) == score(measures.noise_consistency(rows)) == dict.fromkeys(range(3), 0.85)
    assert score(measures.flat_texture(rows)) == score(measures.backlight(rows)) == dict.fromkeys(range(3), 1.0)
    seen = score(measures.screen(rows))
    assert seen[2] == 0.85 and all(0 <= v <= 1 for v in seen.values())
    assert measures.noise_map(rows).count() == measures.clone_blocks(rows).count() == 0
    zone = measures.portrait(F.col("width"), F.col("height"), F.lit("COL_PA"))
    assert len(score(measures.border_noise(rows, zone))) == 3 and len(score(measures.error_level(rows))) == 3
    assert measures.margin(rows).count() == measures.zone_threshold(rows.where("image_id > 0")).count() + 1 == 3
    nothing = rows.limit(0)
    for measure in (measures.sharpness, measures.noise_consistency, measures.flat_texture, measures.backlight, measures.screen, measures.margin, measures.error_level, measures.clone_blocks, measures.noise_map, measures.zone_threshold, measures.portrait_features):
        assert measure(nothing).count() == 0


def test_filters_against_loops(spark):
    rng = np.random.default_rng(6)
    p = rng.integers(0, 256, (6, 9))
    at = lambda y, x: int(p[(5 - abs(5 - abs(y)), 8 - abs(8 - abs(x)))])
    taps = [1, 4, 6, 4, 1]
    rows = measures.with_gradient(measures.blurred(_pixels(spark, p), ["image_id"]), ["image_id"]).collect()
    assert len(rows) == 54
    for r in rows:
        total = sum(taps[j + 2] * taps[k + 2] * at(r.y + j, r.x + k) for j in range(-2, 3) for k in range(-2, 3))
        assert r.soft == int(total / 256 + 0.5)
        gx = sum(w * (at(r.y + j, r.x + 1) - at(r.y + j, r.x - 1)) for j, w in zip((-1, 0, 1), (1, 2, 1), strict=True))
        gy = sum(w * (at(r.y + 1, r.x + j) - at(r.y - 1, r.x + j)) for j, w in zip((-1, 0, 1), (1, 2, 1), strict=True))
        assert abs(r.gradient - np.hypot(gx, gy)) < 1e-9
    for r in measures.row_means(_pixels(spark, p), "g", ["b"]).collect():
        assert r.level == int(sum(at(r.y, r.x + k) for k in range(-4, 5)) / 9 + 0.5) and r.b == r.g


def test_screens_and_pasted_pictures_are_seen(spark):
    rng = np.random.default_rng(9)
    y, x = np.indices((130, 200))
    even, grain = np.full((130, 200), 180), np.clip(rng.normal(150, 25, (130, 200)), 0, 255).astype(int)
    framed = np.where((y > 12) & (y < 118) & (x > 20) & (x < 180), 200, 5)
    rows = _pixels(spark, even, grain, framed)
    score = lambda found: {r.image_id: r.score for r in found.collect()}
    light = score(measures.backlight(rows))
    # a screen with a dark frame is told by its centre
    assert light[0] == light[2] == 0.15 and light[1] == 0.15
    flat = score(measures.flat_texture(rows))
    assert flat[0] == 0.05 and flat[1] == 1.0
    assert score(measures.screen(rows))[0] < 0.5


def test_leave_one_out(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (rng.normal(0, 1, 4) + 4 * (k % 3 == 0)).tolist(), int(k % 3 == 0)) for k in range(30)]
    samples = spark.createDataFrame(rows, "sample_id long, vec array<double>, label int")
    got = scoring.confusion(scoring.leave_one_out(samples, [1.0, 3.0]), ["class_weight"], "label", "predicted").collect()
    assert len(got) == 2 and all(r.tp + r.tn >= 28 for r in got)
    with pytest.raises(ValueError, match="at most"):
        scoring.leave_one_out(samples, [1.0], most=10)


def test_machines_of_the_trainer(spark):
    """The trained machine has about the least cost of the machines near it, and odd samples have a defined result."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (60, 3)), np.arange(60) % 4 == 0
    x[y] += 1.0
    schema = "sample_id long, vec array<double>, label int"
    samples = spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(60)], schema).coalesce(1)
    cost = lambda m: 0.5 * m[:3] @ m[:3] + (np.where(y, 3.0, 1.0) * np.maximum(0, 1 - np.where(y, 1, -1) * (x @ m[:3] - m[3]))).sum()
    weights, rho = scoring.fit(samples, 3.0, steps=30)
    own = np.array([*weights, rho])
    assert all(cost(own) <= 1.01 * cost(own + rng.normal(0, 0.1, 4)) for _ in range(300))
    # one class, none, and a null vector
    assert scoring.fit(samples.where("label = 1")) == ([], -1.0) and scoring.fit(samples.limit(0)) == ([], 1.0)
    odd = spark.createDataFrame([(100, None, 1), (101, [5.0, 5.0, 5.0], None)], schema)
    got = {r.sample_id: r for r in scoring.leave_out(samples.unionByName(odd), [3.0], 2, steps=30).collect()}
    assert len(got) == 62 and got[100].predicted is None and got[101].predicted == 1
    folds = {r.sample_id: r.f for r in samples.selectExpr("sample_id", "pmod(xxhash64(sample_id), 2) f").collect()}
    weights, rho = scoring.fit(samples.where("pmod(xxhash64(sample_id), 2) = 1"), 3.0, steps=30)
    value = x @ np.array(weights) - rho
    assert all(got[i].predicted == (value[i] > 0) for i in range(60) if folds[i] == 0 and abs(value[i]) > 0.1)
    assert sum((got[i].predicted == 1) == y[i] for i in range(60)) >= 40


def test_registering_types_and_analyzers(spark):
    """Held by the session: others do not see it."""
    own = spark.newSession()
    extract.register("X_CARD", [extract.one("documentNumber", 0.9, r"CARD\\s+(\\d{4})".replace("\\\\", "\\"))], own)
    classify.register("X_CARD", classify.Keywords(0.5, ("X CARD", "OF NOWHERE")), own)
    authenticity.register("HOLOGRAM", 1.0, own)
    row, schema = [(1, "x card of nowhere CARD 1234")], "id int, text string"
    texts = own.createDataFrame(row, schema)
    assert classify.best_of(texts, ["id"]).first().code == "X_CARD"
    assert [(r.field, r.value) for r in extract.extract(texts, ["id"], "X_CARD").collect()] == [("documentNumber", "1234")]
    checks = [(1, "HOLOGRAM", 0.0, False), (1, "OTHER", 1.0, False)], "id int, analyzer string, score double, is_passport boolean"
    assert abs(authenticity.combine(own.createDataFrame(*checks), ["id"]).first().side_score - 0.2) < 1e-12
    assert classify.best_of(spark.createDataFrame(row, schema), ["id"]).first().code == "UNKNOWN" and authenticity.combine(spark.createDataFrame(*checks), ["id"]).first().side_score == 0.5
    with pytest.raises(KeyError):
        extract.extract(spark.createDataFrame(row, schema), ["id"], "X_CARD")
    for again in (lambda: extract.register("X_CARD", [], own), lambda: classify.register("COL_PA", None, own), lambda: authenticity.register("HOLOGRAM", 1.0, own)):
        with pytest.raises(ValueError, match="known already"):
            again()
    # the same types are known to the session's SQL
    sql.define(own)
    assert own.sql("SELECT pp_document_type('x card of nowhere'), pp_document_type(NULL)").first()[:] == ("X_CARD", "UNKNOWN")
    sql.define(spark)
    assert spark.sql("SELECT pp_document_type('x card of nowhere')").first()[0] == "UNKNOWN"


def test_functions_of_sql(spark):
    """As the Columns of the same names."""
    sql.define(spark)
    rnd = random.Random(2)
    rows = [("".join(rnd.choice("AZ09<k") for _ in range(rnd.randrange(12))), rnd.choice("0123456789x"), "".join(rnd.choice("0123456789") for _ in range(rnd.choice([9, 10, 10])))) for _ in range(300)] + [(None, None, None)]
    dates = ["910305", "2007-10-30", "1968/12/01", "19/02/1977", "23-10-1959", "11-dec-2011", "02 SEPT 2020", "26 01 1999", " 08 MAR 1974 ", "15-AUG-1965", "never", "", None]
    table = spark.createDataFrame([(*r, dates[k % len(dates)]) for k, r in enumerate(rows)], "data string, digit string, number string, day string")
    table = table.select("*", F.expr("pp_zone_digit(data)").alias("a"), F.expr("pp_zone_digit_valid(data, digit)").alias("b"), F.expr("pp_ecuador_valid(number)").alias("c"), F.expr("pp_date(day)").alias("d"))
    want = [checkdigits.check_digit(F.col("data"), 12), checkdigits.check_digit_valid(F.col("data"), F.col("digit"), 12), checkdigits.ecuador_valid(F.col("number")), text.iso_date(F.col("day"))]
    bad = [table.where(~F.col(n).eqNullSafe(w) & ~(F.col("data").isNull() & F.lit(n == "a"))).count() for n, w in zip("abcd", want, strict=True)]
    assert bad == [0, 0, 0, 0] and table.where("b").count() > 5 and table.where("c").count() > 5


def test_sessions_are_created_and_uploaded(spark):
    now = F.lit(datetime.datetime(2020, 1, 1, 10))
    asked = spark.createDataFrame([(1, "COL_PA", 1.0, 2.0, "a"), (2, "NONE", 1.0, 2.0, "a"), (3, "COL_PA", 91.0, 2.0, "a")], "session_id long, document_type string, lat double, lng double, user_agent string")
    got = sessions.created(asked, now).collect()
    assert [(r.session_id, r.status, r.expires_at) for r in got] == [(1, "CREATED", datetime.datetime(2020, 1, 1, 10, 30))]
    files = spark.createDataFrame([(1, "FRONT", b"abc"), (1, "BACK", b"")], "session_id long, side string, content binary")
    row = sessions.uploaded(files, "content", "images").collect()
    assert [(r.image_path, r.image_sha256[:8]) for r in row] == [("images/1/FRONT.jpg", "ba7816bf")]
    assert sessions.lookup(files, spark.createDataFrame([(1, "FRONT"), (1, "FRONT")], "session_id long, side string"), ["session_id", "side"]).count() == 1
