"""Picture files, keyed tables and stateful streams."""

import datetime
import pathlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passplane.plans import derived, stores
from passplane.sources import keyed
from passplane.sources import pictures as files
from passplane.sources import tables
from passplane.streaming import sessions
from tests.test_sources_and_streams import streamed


def png(width, height, depth, kind, rows, palette=None, laced=0, cut=None):
    """A PNG of rows of packed bytes, without filters."""
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(b"".join(b"\0" + r for r in rows))
    return files._SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, laced)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", body[:9]) + part(b"IDAT", body[9:cut]) + part(b"IEND", b"")


@pytest.mark.parametrize("filters", range(5))
def test_png_round_trip(filters):
    rng = np.random.default_rng(filters)
    for shape in ((1, 1, 3), (7, 5, 3), (4, 9), (13, 2)):
        picture = rng.integers(0, 256, shape).astype(np.uint8)
        got = files.decode(files.encode(picture, filters))
        assert (got == (picture if picture.ndim == 3 else picture[..., None])).all() and got.shape == (*shape[:2], 3)


def test_kinds_of_png():
    assert files.decode(png(10, 1, 1, 0, [bytes([0b10110000, 0b01000000])]))[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0, 0, 255]
    assert files.decode(png(3, 1, 2, 0, [bytes([0b00011011])]))[0, :, 1].tolist() == [0, 85, 170]
    assert files.decode(png(2, 1, 4, 3, [bytes([0x10])], palette=bytes([1, 2, 3, 4, 5, 6])))[0].tolist() == [[6, 5, 4], [3, 2, 1]]
    assert files.decode(png(1, 1, 16, 2, [bytes([9, 200, 8, 200, 7, 200])]))[0, 0].tolist() == [7, 8, 9]
    assert files.decode(png(1, 2, 8, 6, [bytes([1, 2, 3, 99]), bytes([4, 5, 6, 0])]))[:, 0].tolist() == [[3, 2, 1], [6, 5, 4]]
    assert files.decode(png(2, 1, 8, 4, [bytes([7, 0, 9, 255])]))[0].tolist() == [[7] * 3, [9] * 3]


def test_unreadable_pictures():
    good = files.encode(np.arange(12, dtype=np.uint8).reshape(3, 4))
    damaged = bytearray(good)
    damaged[-20] ^= 255
    for content, why in [
        (b"", "empty"), (b"hello", "unknown"), (good[:-13], "ends early"), (good[:20], "ends early"), (bytes(damaged), "damaged"), (png(2, 1, 8, 3, [b"\0\7"], palette=bytes(6)), "palette"),
        (png(1, 1, 8, 0, [b"\1"], laced=1), "interlaced"), (png(1, 1, 3, 0, [b"\1"]), "no sense"), (png(0, 1, 8, 0, [b""]), "no sense"), (png(9, 9, 8, 0, [b"\1"]), "missing"), (b"P5 3 2 255\n123", "missing"), (b"P5 a", "no sense"),
    ]:
        with pytest.raises(files.Unreadable, match=why):
            files.decode(content)


def test_picture_source(spark, tmp_path):
    rows = [(f"{k % 3}/{k}.png", 4, bytes(range(k, k + 36)), k % 5) for k in range(9)]
    table = spark.createDataFrame(rows, "path string, width int, bgr binary, filters int")
    assert files.write(table, f"file://{tmp_path}").agg(F.count("*"), F.min("length") > 0).first()[:] == (9, True)
    (tmp_path / "0" / "bad.png").write_bytes(b"\x89PNG nothing")
    (tmp_path / "0" / "note.txt").write_bytes(b"x")
    files.register(spark)
    read = spark.read.format("pictures").option("pattern", "*.png").option("bytesPerPartition", 250).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 2
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.width, r.height, bytes(r.bgr or b""), r.error) for r in read.collect()}
    assert got == {p: (w, 3, b, None) for p, w, b, _ in rows} | {"0/bad.png": (None, None, b"", "unknown format")}
    pixels = files.pixels(read)
    assert pixels.count() == 9 * 12 and pixels.where("path like '%/5.png' and y = 1 and x = 2").select("b", "g", "r").first()[:] == (23, 24, 25)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    again = files.decoded(content)
    assert again.where("error is null").count() == 9 and again.where("error is not null").count() == 2
    assert spark.read.format("pictures").option("pattern", "*.gif").load(str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        files.mounted("hdfs://somewhere")


def test_small_pictures_leave_together():
    """Five thousand pictures of 64 pixels are a few tables, a large one is several, and each pixel is in one."""
    sizes = [64] * 5000 + [250_000, 0, 10]
    held = list(files._stretches(sizes))
    assert len(held) < 8 and all(0 < sum(b - a for _, a, b in part) <= files.PIXELS_A_BATCH for part in held)
    runs = [run for part in held for run in part]
    assert runs == sorted(runs) and all([b for k, _, b in runs if k == i][-1:] == ([size] if size else []) for i, size in list(enumerate(sizes))[4990:])
    assert all(a == (0 if k != before[0] else before[2]) for before, (k, a, _) in zip([(-1, 0, 0), *runs], runs)) and sum(b - a for _, a, b in runs) == sum(sizes)


def test_pixels_with_unreadable_pictures(spark):
    rng = np.random.default_rng(3)
    pictures = {f"{k}.png": rng.integers(0, 256, (1 + k % 3, 1 + k % 4, 3)).astype(np.uint8) for k in range(40)} | {"large.png": rng.integers(0, 256, (500, 401, 3)).astype(np.uint8)}
    rows = [files.row_of(p, files.encode(v, k % 5)) for k, (p, v) in enumerate(pictures.items())]
    bad = [files.row_of("bad.png", b""), files.row_of("worse.png", b"GIF")]
    found = files.pixels(spark.createDataFrame([*bad, *rows], files.SCHEMA).coalesce(1), outer=True)
    assert found.columns == ["path", "height", "width", "error", "y", "x", "b", "g", "r"]
    sums = found.groupBy("path", "height", "width", "error").agg(F.count("x").alias("n"), *[F.sum(F.col(c) * (F.col("x") + 3 * F.col("y") + 1)).alias(c) for c in "bgr"]).collect()
    want = {("bad.png", None, None, "empty", 0, None, None, None), ("worse.png", None, None, "unknown format", 0, None, None, None)}
    for p, v in pictures.items():
        y, x = np.indices(v.shape[:2])
        want.add((p, *v.shape[:2], None, v.shape[0] * v.shape[1], *[int((v[..., c].astype(int) * (x + 3 * y + 1)).sum()) for c in range(3)]))
    assert {tuple(r) for r in sums} == want and len(sums) == 43
    assert files.pixels(spark.createDataFrame([*bad, *rows], files.SCHEMA)).columns == ["path", "y", "x", "b", "g", "r"]


def test_picture_files_are_written_by_one_job(spark, tmp_path, monkeypatch):
    """Six hundred vectors, one of them null, in one row group: files are written by several tasks at once and cut by those; they are read once."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 50)
    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.when(F.col("id") != 599, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: ((p * (F.col("id") + 3)) % 761).cast("float"))).alias("embedding"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sparkContext.setJobGroup("picture files", "")
    try:
        folder = files.mounted(stores._vectors_as_files(spark, str(tmp_path)))
        jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in spark.sparkContext.statusTracker().getJobIdsForGroup("picture files")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [spark.sparkContext.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds if spark.sparkContext.statusTracker().getStageInfo(s)]
    assert len(jobs) < 8 and max(tasks) == 12
    sizes = {int(p.stem): p.stat().st_size for p in pathlib.Path(folder).rglob("*.png")}
    assert sorted(sizes) == list(range(599))
    for k in (7, 57, 557):  # every fiftieth
        content = (pathlib.Path(folder) / f"{k % 10}" / f"{k}.png").read_bytes()
        with pytest.raises(files.Unreadable, match="ends early"):
            files.decode(content)
    query = stores.q_picture_files(spark, str(tmp_path))
    assert query._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    assert query.count() == 599 and query.where("failed").count() == query.where("n is null").count() == 12 and query.where("n = 64 and height = 8 and width = 8").count() == 587


def test_grey_values_find_extremes_once_a_vector(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for rows in (derived.levels(vectors), derived.pixels(spark, sf_dir)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("array_min(") == 1
    pixels = derived.pixels(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "g"))).alias("s")).select("image_id", F.col("s.g").alias("all"))
    got, want = {r.image_id: list(r["all"]) for r in derived.levels(vectors).collect()}, {}
    for r in vectors.collect():
        v = np.array(r.embedding, np.float64)
        want[r.vec_id] = np.floor((v - v.min()) / (v.max() - v.min()) * 255 + 0.5).astype(int).tolist()
    assert got == want == {r.image_id: list(r["all"]) for r in pixels.collect()}


def test_keyed_table(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, s string, v int, n long").schema
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store = keyed.KeyedTable.create(spark, f"file://{tmp_path}/t", schema, ["k"], "n", buckets=16)
    assert store.read().count() == 0
    with pytest.raises(keyed.Conflict):
        keyed.KeyedTable.create(spark, f"file://{tmp_path}/t", schema, ["k"], "n")
    first = store.upsert(rows(*[(k, "a", k, 1) for k in range(200)], (None, "no key", 0, 1)))
    assert first == {"version": 1, "buckets": 16}
    before = store.read()
    # one key: one bucket is written, the others stay where they are
    assert store.upsert(rows((5, "b", 50, 3), (5, "c", 51, 2), (5, "lower", 9, 0))) == {"version": 2, "buckets": 1}
    places = [store.state()[1]["places"], __import__("json").loads(store._text(f"file://{tmp_path}/t/versions/000000000001.json"))["places"]]
    assert sum(places[0][b] != places[1][b] for b in places[0]) == 1
    now = {r.k: (r.s, r.v, r.n) for r in store.read().collect()}
    assert now == {k: ("a", k, 1) for k in range(200)} | {5: ("b", 50, 3), None: ("no key", 0, 1)}
    # a lower version does not replace, a null key is a key, an empty upsert makes no version
    store.upsert(rows((5, "old", 1, 2), (None, "newer", 1, 2)))
    assert {r.k: r.s for r in store.read().where("k is null or k = 5").collect()} == {5: "b", None: "newer"} and store.upsert(rows()) == {"version": 3, "buckets": 0}
    # the reader of an older version still sees all of it, and nothing of the new
    assert {r.k: r.s for r in before.collect()} == {k: "a" for k in range(200)} | {None: "no key"} and store.read(1).count() == 201
    # a version that is not whole is not seen
    (tmp_path / "t" / "versions" / "000000000004.json").write_text('{"keys": ["k"')
    assert store.state()[0] == 3 and store.read().count() == 201
    with pytest.raises(keyed.Conflict):
        store.upsert(rows((7, "x", 1, 9)))
    (tmp_path / "t" / "versions" / "000000000004.json").unlink()
    assert store.vacuum() > 0 and store.read().count() == 201
    with pytest.raises(Exception, match="000000000001"):
        store.read(1)


def test_outcomes_over_batches(spark, tmp_path):
    batches = [[(1, "FRONT", 0), (2, "FRONT", 0), (4, "OTHER", 3)], [(1, "BACK", 5), (1, "BACK", 6)], [(2, "BACK", 31), (5, "BACK", 31), (5, "FRONT", 32)], [(3, "FRONT", 120)], [(3, "FRONT", 121)]]
    for k, v in sessions.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        got = streamed(spark, tmp_path, batches, sessions.outcomes)
    finally:
        for k in sessions.STATE_STORE:
            spark.conf.unset(k)
    at = lambda m: datetime.datetime(2020, 1, 1, 10) + datetime.timedelta(minutes=m)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "COMPLETED", "BACK,FRONT", at(5)), (2, "EXPIRED", "FRONT", at(30)), (4, "EXPIRED", "", at(33)), (5, "COMPLETED", "BACK,FRONT", at(32))]


def test_replacements_over_batches(spark, tmp_path):
    rows = [(1, "FRONT", 0, 10), (1, "FRONT", 0, 11)], [(1, "FRONT", 5, 12), (1, "BACK", 5, 13)], [(1, "FRONT", 1, 14)]
    for k, batch in enumerate(rows):
        own = [(i, s, datetime.datetime(2020, 1, 1, 10) + datetime.timedelta(minutes=m), n) for i, s, m, n in batch]
        spark.createDataFrame(own, "session_id long, side string, ts timestamp, capture_id long").coalesce(1).write.parquet(str(tmp_path / "events" / f"b{k}"))
    stream = spark.readStream.schema("session_id long, side string, ts timestamp, capture_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "events"))
    found = sessions.run_through(sessions.replaced(stream), f"file://{tmp_path}/out", "update")
    last = found.groupBy("session_id", "side").agg(F.max(F.struct("attempts", "capture_id")).alias("s")).select("side", "s.*").collect()
    assert sorted(tuple(r) for r in last) == [("BACK", 1, 13), ("FRONT", 4, 12)]
    assert all(spark.conf.get(k, None) != v for k, v in sessions.STATE_STORE.items())


def test_outcomes_call_python_once_a_group(spark, tmp_path):
    """Four hundred sessions in two groups over batches: each has its outcome once, and the calls are of groups."""
    batches = [[(i, "FRONT", i % 20) for i in range(400)], [(i, "BACK", 20 + i % 7) for i in range(0, 400, 2)], [(1000, "FRONT", 200)], [(1000, "OTHER", 201)]]
    got = streamed(spark, tmp_path, batches, lambda events: sessions.outcomes(events, buckets=2))
    rows = {r.session_id: (r.status, r.captured) for r in got.collect()}
    assert got.count() == 400 and rows == {i: ("EXPIRED", "FRONT") if i % 2 else ("COMPLETED", "BACK,FRONT") for i in range(400)}
