"""Pictures whose last vectors are missing: they are lower than the others, and every place in them follows from their own sides."""

import duckdb
import pytest

from passplane.operators import raster
from tests.test_queries import QUERIES, SQL, shown

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def low(tmp_path_factory):
    folder = tmp_path_factory.mktemp("low")
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' WHERE vec_id BETWEEN 20 AND 35) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["q_photo_colour", "q_photo_covered", "q_portrait_vector", "q_zone_error", "q_border_noise", "q_document_place"])
def test_low_picture_equals_sql(spark, low, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{low}/embeddings.parquet'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(shown(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in names) for r in QUERIES[name](spark, low).collect()) == want


def test_toner_of_blocks_at_the_limit(spark):
    """Blocks whose deviation is 50 but for the last digits: decided as by the SQL, however rows are dealt."""
    blocks = [
        [84, 204, 138, 195, 169, 54, 139, 200, 219, 93, 196, 219, 177, 128, 102, 171], [131, 147, 255, 139, 148, 241, 146, 100, 98, 70, 146, 191, 134, 99, 80, 155],
        [142, 44, 80, 108, 92, 241, 97, 138, 82, 146, 183, 117, 189, 83, 61, 117], [78, 178] * 8,
    ]
    rows = [(i, p // 4, p % 4, g) for i, own in enumerate(blocks) for p, g in enumerate(own)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pixels (image_id BIGINT, p INT, g INT)")
    con.executemany("INSERT INTO pixels VALUES (?, ?, ?)", [(i, y * 4 + x, g) for i, y, x, g in rows])
    want = dict(con.execute("SELECT image_id, (stddev_pop(g) > 50)::INT FROM (SELECT * FROM pixels ORDER BY image_id, p) GROUP BY 1").fetchall())
    for parts in (1, 7):
        dealt = spark.createDataFrame(rows, "image_id long, y int, x int, g int").repartition(parts)
        assert {r.image_id: r.blocks for r in raster.toner(dealt, 4, 1).collect()} == want


@pytest.fixture(scope="module")
def lacking(tmp_path_factory):
    """Scenes that lack their last, middle or first vectors, and a whole one."""
    folder = tmp_path_factory.mktemp("lacking")
    which = "vec_id BETWEEN 20 AND 21 OR vec_id BETWEEN 30 AND 35 OR vec_id BETWEEN 40 AND 49 AND vec_id % 10 <> 4 OR vec_id BETWEEN 53 AND 59 OR vec_id BETWEEN 60 AND 69 OR vec_id BETWEEN 470 AND 471"
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' WHERE {which}) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["q_background", "q_face_ring", "q_edges", "q_perspective"])
def test_scene_that_lacks_rows_equals_sql(spark, lacking, name):
    """A scene's frame is that of a whole one, and a gradient goes from a row to the next that is there."""
    test_low_picture_equals_sql(spark, lacking, name)
