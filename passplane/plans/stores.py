"""Queries that write and read: picture files, keyed tables, streams over events, and functions defined in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passplane.functions import sql
from passplane.operators import catalog
from passplane.plans import derived, texts, zones
from passplane.sources import keyed
from passplane.sources import pictures as files
from passplane.sources.folders import mounted, shared_folder
from passplane.sources.tables import spread, table
from passplane.streaming import sessions


def _vectors_as_files(spark: SparkSession, sf_dir: str) -> str:
    """Every vector as an 8 by 8 PNG of three colours, with a row filter by its number; every fiftieth is cut short. Gives the folder."""
    folder = shared_folder(spark, "pictures")
    root = mounted(folder)
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    rows = derived.levels(vectors.where(F.size("embedding") > 0)).select("image_id", F.flatten(F.transform("all", lambda p: F.array(p, (p + 40) % 256, (p + 90) % 256))).alias("t"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": [f"{i % 10}/{i}.png" for i in pdf.image_id], "width": 8, "bgr": [np.asarray(t, np.uint8).tobytes() for t in pdf.t], "filters": pdf.image_id % 5})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length in zip(pdf.path, pdf.length, strict=True):
                os.truncate(f"{root}/{path}", length - 20)
            yield pdf[["path"]]

    written = files.write(rows.mapInPandas(packed, "path string, width int, bgr binary, filters int"), folder)
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long")
    # one job writes every file, and a task cuts its own by the length that it wrote, so a repeated task gives the same files
    written.where(number % 50 == 7).mapInPandas(cut, "path string").write.format("noop").mode("overwrite").save()
    return folder


def q_picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as PNG files and read back through the data source: sums of each picture, or why it cannot be read."""
    folder = _vectors_as_files(spark, sf_dir)
    files.register(spark)
    read = spark.read.format("pictures").option("pattern", "*.png").option("bytesPerPartition", 64_000).load(folder)
    sums = [F.sum(F.col(c) * (F.col("x") + 1)).alias(c) for c in "bgr"]
    rows = files.pixels(read, outer=True).groupBy("path", "height", "width", "error").agg(F.count("x").alias("n"), *sums)
    failed = F.col("error").isNotNull()
    return rows.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "height", "width", failed.alias("failed"), F.when(~failed, F.col("n")).alias("n"), *"bgr")


def q_keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after three upserts: the last event of each user and kind, by its number."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    store = keyed.KeyedTable.create(spark, shared_folder(spark, "keyed"), events.schema, ["user_id", "event_type"], "event_id", buckets=8)
    for part in (F.col("event_id") % 3 == 1, F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 2):
        store.upsert(events.where(part))
    return store.read()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of captures: a session is a user's hour; clicks are fronts and views are backs."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    session = F.col("user_id") * 1_000_000 + F.floor(F.unix_timestamp("ts") / 7200) % 1_000_000
    side = F.when(F.col("event_type") == "click", "FRONT").when(F.col("event_type") == "view", "BACK").otherwise("OTHER")
    return rows.select(session.cast("long").alias("session_id"), side.alias("side"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("capture_id"))


def q_stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that completed or passed their deadline, by state and timers."""
    found = sessions.run_through(sessions.outcomes(_stream(spark, sf_dir)), shared_folder(spark, "outcomes"))
    return found.select("session_id", "status", "captured", F.date_format(F.date_trunc("second", "at"), "yyyy-MM-dd HH:mm:ss").alias("at_"))


def q_stream_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last capture of each session and side of a stream, with the number of attempts."""
    found = sessions.run_through(sessions.replaced(_stream(spark, sf_dir)), shared_folder(spark, "replacements"), "update")
    last = found.groupBy("session_id", "side").agg(F.max(F.struct("attempts", "capture_id")).alias("s"))
    return last.select("session_id", "side", "s.capture_id", "s.attempts")


def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures by ten minutes of those windows that the watermark has passed."""
    found = sessions.run_through(sessions.captures_per_window(_stream(spark, sf_dir)), shared_folder(spark, "windows"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "side", "n")


def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits by functions that the session's SQL defines."""
    sql.define(spark)
    rows = zones._people(spark, sf_dir).withColumn("number", F.expr(derived.pad(f"({derived.K} * 7919 % 1000000007)", 10)))
    return rows.selectExpr("c_custkey", "pp_zone_digit(doc) AS number_digit", "pp_zone_digit(birth) AS birth_digit", "number", "pp_ecuador_valid(number) AS valid")


def q_sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every document by a function of the session's SQL."""
    sql.define(spark)
    return texts._documents(spark, sf_dir).selectExpr("doc_id", "pp_document_type(text) AS code")


def q_sorted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document types in order of country and code, with their places, how many sessions have each, and what a lookup of each code finds."""
    types = catalog.catalog(spark)
    order = Window.orderBy("country", "code")  # fourteen rows
    own = table(spark, sf_dir, "customer").select(derived.type_of("c_custkey", 15).alias("code")).groupBy("code").agg(F.count("*").alias("sessions"))
    rows = types.withColumn("place", F.row_number().over(order)).join(own, "code", "full")
    return rows.select("code", "country", "place", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.col("country").isNotNull().alias("known"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q_picture_files, q_keyed_table, q_stream_outcomes, q_stream_replacements, q_stream_windows, q_sql_functions, q_sql_types, q_sorted_catalog)}

_EVENTS = "s AS (SELECT user_id * 1000000 + (epoch(date_trunc('second', ts))::BIGINT // 7200) % 1000000 AS session_id, CASE event_type WHEN 'click' THEN 'FRONT' WHEN 'view' THEN 'BACK' ELSE 'OTHER' END AS side, ts, event_id FROM events)"
_CUT = f"{derived.PIXELS}, cut AS (SELECT *, image_id % 50 = 7 AS failed FROM pixels)"

SQL = {
    "q_picture_files": f"WITH {_CUT} SELECT image_id, CASE WHEN NOT failed THEN 8 END AS height, CASE WHEN NOT failed THEN 8 END AS width, failed, CASE WHEN NOT failed THEN count(*) END AS n, " + ", ".join(f"(CASE WHEN NOT failed THEN sum((g + {k}) % 256 * (x + 1)) END)::BIGINT AS {c}" for c, k in zip("bgr", (0, 40, 90), strict=True)) + " FROM cut GROUP BY image_id, failed",
    "q_keyed_table": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "q_stream_outcomes": (
        f"WITH {_EVENTS}, f AS (SELECT session_id, date_trunc('millisecond', min(ts)) + INTERVAL 30 MINUTE AS deadline FROM s GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM s), "
        "t AS (SELECT session_id, min(ts) FILTER (side = 'FRONT' AND date_trunc('millisecond', ts) <= deadline) AS front, min(ts) FILTER (side = 'BACK' AND date_trunc('millisecond', ts) <= deadline) AS back, max(ts) AS last, any_value(deadline) AS deadline FROM s JOIN f USING (session_id) GROUP BY 1), "
        "o AS (SELECT session_id, CASE WHEN front IS NOT NULL AND back IS NOT NULL THEN 'COMPLETED' WHEN last > deadline OR deadline < mark THEN 'EXPIRED' END AS status, concat_ws(',', CASE WHEN back IS NOT NULL THEN 'BACK' END, CASE WHEN front IS NOT NULL THEN 'FRONT' END) AS captured, CASE WHEN front IS NOT NULL AND back IS NOT NULL THEN greatest(front, back) ELSE deadline END AS moment FROM t, w) "
        "SELECT session_id, status, captured, strftime(date_trunc('second', moment), '%Y-%m-%d %H:%M:%S') AS at_ FROM o WHERE status IS NOT NULL"
    ),
    "q_stream_replacements": f"WITH {_EVENTS} SELECT session_id, side, arg_max(event_id, (ts, event_id)) AS capture_id, count(*) AS attempts FROM s GROUP BY 1, 2",
    "q_stream_windows": f"WITH {_EVENTS}, w AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM s) SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, side, count(*) AS n FROM s GROUP BY time_bucket(INTERVAL 10 MINUTE, ts), side HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= (SELECT mark FROM w)",
    "q_sql_functions": f"SELECT c_custkey, number_digit, birth_digit, number, e.valid FROM ({zones.SQL['q_icao_check_digit']}) i JOIN ({zones.SQL['q_ecu_mod10']}) e USING (c_custkey)",
    "q_sql_types": f"SELECT doc_id, code FROM ({texts.SQL['q_classify_argmax']})",
    "q_sorted_catalog": f"WITH {derived.CATALOG}, p AS (SELECT code, country, row_number() OVER (ORDER BY country, code) AS place FROM catalog), s AS (SELECT coalesce(code, 'UNKNOWN_TYPE') AS code, count(*) AS sessions FROM customer LEFT JOIN catalog ON catalog.place = c_custkey % 15 GROUP BY 1) SELECT coalesce(p.code, s.code) AS code, country, p.place::INT AS place, coalesce(sessions, 0) AS sessions, country IS NOT NULL AS known FROM p FULL JOIN s ON s.code = p.code",
}
