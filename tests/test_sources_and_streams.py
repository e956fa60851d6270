"""Sources, stored values and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from passplane.sources import images, models, stored
from passplane.streaming import sessions


def test_images(spark, tmp_path):
    for label, name, data in (("good", "a.pgm", b"P5 3 2 255\n" + bytes(range(6))), ("bad", "b.ppm", b"P6 1 1 255\n" + bytes([1, 2, 3])), ("bad", "c.png", b"not a picture"), ("bad", "d.txt", b"x"), ("bad", "e.pgm", b"")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(data)
    files = images.image_files(spark, str(tmp_path))
    assert {(r.label, r.path[-5:]) for r in images.non_empty(files).collect()} == {("good", "a.pgm"), ("bad", "b.ppm"), ("bad", "c.png")}
    got = images.pixels(images.non_empty(files))
    assert got.count() == 7 and [tuple(r) for r in got.where("path like '%b.ppm'").select("b", "g", "r").collect()] == [(3, 2, 1)]


def test_stored_json(spark):
    rows = [(1, "FRONT", '{"fields":{"a":"x","b":"y"},"fieldConfidence":{"a":0.5}}', '{"score":0.4,"veto":false,"checks":[{"name":"PHOTO_SUBSTITUTION_ML","score":0.4,"passed":false}]}'), (2, "BACK", "{broken", None), (3, "BACK", " ", "{}")]
    captures = spark.createDataFrame(rows, "session_id int, side string, ocr_json string, authenticity_json string")
    assert {(r.session_id, r.field, r.value, r.confidence) for r in stored.fields_long(captures).collect()} == {(1, "a", "x", 0.5), (1, "b", "y", 0.0)}
    assert {r.session_id: r.failed for r in stored.failed_check(captures).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("kind", stored.FORMATS)
def test_formats(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, -1.0)], "id int, s string, v double")
    stored.write(rows, str(tmp_path / kind), kind)
    assert sorted(stored.read(spark, str(tmp_path / kind), kind, "id int, s string, v double").collect()) == sorted(rows.collect())
    with pytest.raises(ValueError, match="unknown format"):
        stored.read(spark, str(tmp_path), "dbase")


def streamed(spark, tmp_path, rows, transform, mode="append"):
    """All rows that a streaming transformation emits over files of events, one file a batch."""
    folder = tmp_path / "events"
    for k, batch in enumerate(rows):
        own = [(i, s, datetime.datetime(2020, 1, 1, 10) + datetime.timedelta(minutes=m)) for i, s, m in batch]
        spark.createDataFrame(own, "session_id long, side string, ts timestamp").coalesce(1).write.parquet(str(folder / f"b{k}"))
    events = spark.readStream.schema("session_id long, side string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = transform(events).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_first_captures(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, "FRONT", 0), (1, "FRONT", 1)], [(1, "BACK", 2), (1, "FRONT", 3)]], sessions.first_captures)
    assert sorted((r.session_id, r.side) for r in got.collect()) == [(1, "BACK"), (1, "FRONT")]


def test_windows(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, "FRONT", 0), (2, "FRONT", 5), (3, "BACK", 12)], [(4, "FRONT", 90)], [(5, "FRONT", 91)]], sessions.captures_per_window)
    assert sorted((r.start.minute, r.side, r.n) for r in got.collect()) == [(0, "FRONT", 2), (10, "BACK", 1)]


def test_statuses(spark, tmp_path):
    batches = [[(1, "FRONT", 0), (2, "FRONT", 0)], [(1, "BACK", 5)], [(3, "FRONT", 120)], [(3, "FRONT", 121)]]
    got = streamed(spark, tmp_path, batches, sessions.statuses)
    found = {(r.session_id, r.status, r.captured) for r in got.collect()}
    assert {(1, "IN_PROGRESS", "FRONT"), (1, "COMPLETED", "BACK,FRONT"), (2, "IN_PROGRESS", "FRONT"), (2, "EXPIRED", "FRONT")} <= found
    assert got.where(F.col("status") == "EXPIRED").select("at").first()[0] == datetime.datetime(2020, 1, 1, 10, 30)


def test_last_captures(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, "FRONT", 0), (1, "FRONT", 1)], [(1, "BACK", 2), (1, "FRONT", 3)]], sessions.last_captures, "complete")
    assert sorted((r.session_id, r.side, r.ts.minute, r.attempts) for r in got.collect()) == [(1, "BACK", 2, 1), (1, "FRONT", 3, 3)]


def test_linear_model_file(spark, tmp_path):
    text = "%YAML:1.0\n---\nmachine:\n   kernel:\n      type: LINEAR\n   class_labels: !!matrix\n      rows: 2\n      data: [ 0, 1 ]\n   sv_total: 1\n   support_vectors:\n      - [ 5.0e-01, -2.,\n          1. ]\n   decision_functions:\n      -\n         sv_count: 1\n         rho: 2.5e-01\n         alpha: [ 1. ]\n"
    (tmp_path / "m.yml").write_text(text)
    model = models.read_linear(spark, str(tmp_path / "m.yml"))
    assert model == models.LinearModel((0.5, -2.0, 1.0), 0.25, (0, 1))
    rows = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 1.0, 0.0],), ([1.0],), (None,)], "v array<double>")
    assert [tuple(r) for r in rows.select(model.value(F.col("v")), model.label(F.col("v"))).collect()] == [(0.25, 0), (-2.25, 1), (None, None), (None, None)]
    (tmp_path / "bad.yml").write_text("nothing: here")
    assert models.read_linear(spark, str(tmp_path / "bad.yml")) is None and models.read_linear(spark, str(tmp_path / "none.yml")) is None
