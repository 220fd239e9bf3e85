"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Labels each node that has an edge with the smallest node of its component: (node, label).

    Large-star and small-star rounds (Kiveris et al. 2014) on an edge table of
    longs. Each round is written to the shared folder, so lineage stays short.
    Loops, repeated edges and nulls are ignored. A node with very many edges
    only meets its minimum, a partial aggregate, in a join that can be split.
    """
    now = materialize(_tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = materialize(_tidy(_small_star(materialize(_tidy(_large_star(now)), "large"))), "edges")
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("label"))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node first."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    least = materialize(edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m")), "least")
    joined = edges.join(least, F.col("v") == F.col("n"))
    return joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("n").alias("v")))
