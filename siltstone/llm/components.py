"""Connected components over edge tables, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: Rounds after which all edges must be contracted.
MOST_ROUNDS = 80


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Each round moves every node to its least neighbour's least neighbour and
    contracts the edges: those within a group vanish.  Odd rounds order nodes by
    id, which ends stars around least ids at once; even rounds order them by a
    hash, so that chains of rising ids shrink by a constant factor as well.
    Rounds are written tables; hubs are pre-aggregated by partial minima.
    """
    kept = edges.where("a != b").select("a", "b")
    pairs = stage.write(kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges-0")
    labels = None
    for step in range(1, MOST_ROUNDS + 1):
        if step % 2:
            least = pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        else:
            placed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
            first = pairs.groupBy("a").agg(F.min(placed("b")).alias("least"))
            least = first.select(F.col("a").alias("node"), F.least(placed("a"), "least")["id"].alias("to"))
        least = stage.write(least, f"{name}-least-{step}")
        further = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moves = stage.write(least.join(further, "to").select("node", F.col("further").alias("to")), f"{name}-moves-{step}")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:
            step_on = moves.select(F.col("node").alias("component"), "to")
            labels = stage.write(labels.join(step_on, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{name}-labels-{step}")
        ends = lambda end: moves.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        moved = pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        pairs = stage.write(moved.where("a != b").distinct(), f"{name}-edges-{step}")
        stage.drop(f"{name}-edges-{step - 1}", f"{name}-least-{step}")
        if not pairs.limit(1).count():
            if step == 1:
                return labels
            named = labels.groupBy("component").agg(F.min("node").alias("least"))
            return stage.write(labels.join(named, "component").select("node", F.col("least").alias("component")), f"{name}-named")
    raise RuntimeError("components did not settle")
