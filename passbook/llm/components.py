"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, low): for each end of an edge (a, b) the smallest id that it is connected with.

    Every round is written, so lineage stays short; a hub's edges meet in joins that Spark can split.
    """
    now = materialise(_oriented(edges.select("a", "b")), f"{name}-0")
    state, round_ = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state, round_ = mark, round_ + 1
        now = materialise(_small_star(_large_star(now)), f"{name}-{round_}")
    return now.select(F.col("a").alias("id"), F.col("b").alias("low")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("low")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _oriented(edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))))
