"""Connected components by alternating large-star and small-star steps on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftable.llm.common import scratch, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest reachable node.

    edges: columns u and v, long; loops, repeats and either direction are allowed. Each step is a table in the
    shared folder, so lineage stays short and a lost executor costs one step.
    """
    spark = edges.sparkSession
    with scratch(spark) as whole:
        edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = written(edges, "edges")
        state = _state(edges)
        while True:
            # every edge points from the larger node to the smaller one
            with scratch(spark) as step:
                edges = step.result(_small(written(_large(edges), "edges")), "edges")
            before, state = state, _state(edges)
            if state == before:
                return whole.result(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
