"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

#: Rounds after which components() gives up; each round at least halves the depth of the trees.
MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; a component is named by its least node.

    Alternates the large-star and small-star steps, each a minimum per node and a join, so that no neighbourhood is gathered
    in one task and nothing goes to the driver but a count and a checksum. Loops, repeated edges and either direction are the same
    edges; edges with a null end are left out; an empty table gives no rows.
    """
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    nodes_alone = edges.filter(F.col("x") == F.col("y")).select(F.col("x").alias("node"))
    now = materialize(edges.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return nodes_alone.select("node", F.col("node").alias("component")).distinct()
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .unionByName(nodes_alone.select("node", F.col("node").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
