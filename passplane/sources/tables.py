"""Readers of the input tables. Any path that Spark's readers can open works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of long derivations (parsed zones, fields by patterns) are dealt out by so many.
ROWS_A_TASK = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a unique key, about `ROWS_A_TASK` a task. By its bytes a table of short rows is one task's, whatever each row then costs."""
    # a number keeps the few bytes from being put together again
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() // ROWS_A_TASK)), key)
