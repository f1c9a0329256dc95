"""Connected components of an edge table by alternating large-star and small-star steps, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, join_unique, materialise


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of edges(u, v); label is the smallest node of its component.

    Each round is two aggregations with partial results before the shuffle and two joins; a node with very many
    neighbours is joined by broadcast, so that no task reads them all. Rounds grow with the logarithm of the longest path. Null ends and loops
    are ignored; repeated edges count once; an empty table gives an empty result.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = materialise(edges.where("u is not null and v is not null and u <> v").select(low.alias("u"), high.alias("v")).distinct(), "edges")
    state, before = edges, _print(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = materialise(large, "large-star")
        near = _with_least(large, "v", "u")
        small = near.select(F.col("m").alias("u"), "v").unionByName(near.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        small = materialise(small, "small-star")
        after = _print(small)
        delete(state)
        delete(large)
        state, same = small, after == before
        before = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _with_least(edges: DataFrame, by: str, other: str) -> DataFrame:
    """Adds m, the least of each node `by` and its neighbours."""
    return join_unique(edges, edges.groupBy(by).agg(F.least(F.min(other), F.col(by)).alias("m")), [by])
