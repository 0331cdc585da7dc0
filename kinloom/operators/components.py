"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinloom.operators.recovery import checkpointed

#: A star step at least halves the depth of every tree, so this is never met.
MAX_ROUNDS = 60


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger end to the smaller one, no loops."""
    return (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src")
    return moved.select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges, to see whether a round changed them."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("digest"),
    ).first()
    return row["n"], row["digest"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``(id, component)`` for every node named by an edge.

    ``component`` is the smallest id reachable.  Ids are compared with ``<``,
    so any orderable type works; edges with a null end and loops are ignored,
    repeated edges count once, and no edges give no rows.  A hub with many
    neighbours is fine: minima are combined before the shuffle and the joins
    have a one-row-per-node side that skew handling may repeat.  Each round
    is checkpointed; rounds grow with the logarithm of the longest path.
    """
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    step = checkpointed(_directed(step))
    mark = _mark(step)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        step = checkpointed(_directed(_small_star(_directed(_large_star(step)))))
        mark, before = _mark(step), mark
        if mark == before:
            break
    roots = step.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return step.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
