"""Connected components of an edge table by alternating star contractions.

Every round sends each larger neighbour to the smallest one (large star), then each smaller one
(small star); the edges end as one star per component after a number of rounds that grows with the
square of the logarithm of the component. Only edges travel, and each round is written to the shared
folder, so neither the plan nor the recovery of a lost executor grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("at"), F.least("at", "least").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    large = (
        pairs.join(_least_neighbour(pairs), F.col("x") == F.col("at"))
        .filter("y > x")
        .select(F.col("y").alias("x"), F.col("m").alias("y"))
        .distinct()
    )
    large = stored(large, "components-large")
    least = _least_neighbour(large)
    small = large.join(least, F.col("x") == F.col("at")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    heads = least.select(F.col("at").alias("u"), F.col("m").alias("v"))
    return stored(small.unionByName(heads).filter("u <> v").distinct(), "components")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the least node."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stored(ordered, "components")
    state = _state(current)
    while state[0]:
        current = _round(current)
        before, state = state, _state(current)
        if state == before:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
