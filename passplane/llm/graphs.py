"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passplane.llm.base import deleted, finished, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node that has an edge. edges: a, b of type long.

    Each round joins every node's neighbours with the smallest of them, first the larger neighbours (on edges in both
    directions), then the smaller ones, until the edges are stars around the smallest nodes. Minima are pre-aggregated
    before their shuffle and no neighbour list is gathered; a hub's edges meet its one minimum in a join whose skewed
    partitions Spark splits at run time. Each round is written to the shared folder, and the round before it is deleted. Nulls and loops are ignored; no edge gives no row.
    """
    spark = edges.sparkSession
    now = finished(lambda: edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", spark)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("u", "v").alias("w"), "u", "v", "m")
        before = list(now.inputFiles())[:1]
        stars = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        now = written(stars, "edges")
        deleted(spark, [p.rsplit("/", 1)[0] for p in before])
