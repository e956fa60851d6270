"""Rows that are much work each are dealt out, however few bytes their table has."""

import pytest
from pyspark.sql import functions as F

from passplane.plans import texts, zones
from passplane.sources import tables


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Twelve thousand customers in one file with one row group."""
    folder = str(tmp_path_factory.mktemp("customers"))
    rows = spark.range(12_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).toPandas().to_parquet(f"{folder}/customer.parquet")
    return folder


def shares(rows):
    """Rows of each task, and the sum of the keys."""
    found = rows.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("c_custkey")).collect()
    return [r[1] for r in found], sum(r[2] for r in found)


@pytest.mark.parametrize("source", [zones._td1, zones._td3, zones._texts])
def test_zones_are_many_tasks(spark, customers, monkeypatch, source):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 1_000)
    counts, keys = shares(source(spark, customers))
    assert len(counts) == 12 and max(counts) < 1_500
    assert sum(counts) == 12_000 and keys == 12_000 * 11_999 // 2


@pytest.mark.parametrize("code", ["COL_CC_OLD", "COL_PA", "COL_TI", "ECU_DNI_NEW", "ESP_DNI_NEW", "ESP_DNI_OLD", "PER_DNI_NEW"])
def test_texts_are_many_tasks(spark, customers, monkeypatch, code):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 1_000)
    counts, keys = shares(texts._texts(spark, customers, code))
    assert len(counts) == 12 and max(counts) < 1_500
    assert sum(counts) == 12_000 and keys == 12_000 * 11_999 // 2
