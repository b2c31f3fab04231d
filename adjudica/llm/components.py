"""Connected components by alternating large and small stars, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adjudica.sources.scratch import materialise


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.unionByName(_pairs(edges, "b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _pairs(both.where("b > a").join(low, "a"), "b", "m").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to itself and its other smaller neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _pairs(down.join(low, "a").where("b <> m"), "b", "m")
    return moved.unionByName(_pairs(low, "a", "m")).where("a <> b").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of its component, for every node of the edges (a, b).

    Edges may repeat and run in either direction; loops are dropped. Each round writes its edges to
    the shared folder, which cuts the lineage; about log(longest chain) rounds are needed.
    """
    current = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _state(current)
    while before[0]:
        current = materialise(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    low = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        low.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
