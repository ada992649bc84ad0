"""Consolidating pairwise matches into groups (problem 2).

Minimum labels are propagated across the edges of a graph that is contracted round by round, accelerated with pointer
jumping. Each round is written to the shared folder, until no edge is left to change a label.

Defined results: a row in which an id is null links nothing, but its other id is still a record; null and false labels link
nothing and unlink nothing; a record paired with itself is a group of its own unless linked otherwise; repeated rows count
once; columns other than the three named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Stages


def _jump(stages: Stages, parent: DataFrame) -> DataFrame:
    """Points every vertex at the root of its tree: each pass makes a pointer four times as long."""
    while True:
        one = parent.select("v", "p")
        two = one.alias("a").join(one.alias("b"), F.col("a.p") == F.col("b.v")).select(F.col("a.v").alias("v"), F.col("b.p").alias("p"), (F.col("a.p") != F.col("b.p")).alias("moved"))
        four = two.alias("a").join(two.alias("b"), F.col("a.p") == F.col("b.v")).select(F.col("a.v").alias("v"), F.col("b.p").alias("p"), (F.col("a.moved") | (F.col("a.p") != F.col("b.p"))).alias("moved"))
        done = stages.write(four)
        stages.drop(parent)
        parent = done
        if parent.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges(a, b): the smallest vertex that it is linked with, directly or through others.

    A round hooks every vertex on its smallest neighbour, jumps pointers to the trees' roots and replaces the edges by those
    between roots. Vertices that have a smaller neighbour vanish, so that the number of rounds is logarithmic even for long
    chains; a hub's edges are pre-aggregated before they are shuffled and its join is split by Spark where it is skewed.
    """
    stages = Stages(edges.sparkSession)
    graph = stages.write(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("v"), F.col("b").alias("n")).union(graph.select(F.col("b").alias("v"), F.col("a").alias("n")))
        hooked = both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("p"))
        tree = _jump(stages, stages.write(hooked.withColumn("moved", F.lit(True))))
        rounds.append(tree)
        left = graph.join(tree.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        ends = left.join(tree.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        done, graph = graph, stages.write(ends.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
        stages.drop(done)
    if not rounds:
        return graph.select(F.col("a").alias("v"), F.col("b").alias("label"))
    held, labels = rounds[-1], rounds[-1].select("v", F.col("p").alias("label"))
    for tree in reversed(rounds[:-1]):  # roots of an earlier round are vertices of the next, or stay
        known = labels.select(F.col("v").alias("p"), "label")
        labels = stages.write(tree.join(known, "p", "left").select("v", F.coalesce("label", "p").alias("label")))
        stages.drop(held)
        stages.drop(tree)
        held = labels
    return labels


def group_identifiers(pairs: DataFrame, left: str = "left_source_id", right: str = "right_source_id", linked: str = "is_duplicate") -> DataFrame:
    """(group_source_id, source_id) for every id that stands in either column."""
    ids = pairs.select(F.col(left).cast("string").alias("v")).union(pairs.select(F.col(right).cast("string").alias("v"))).where("v IS NOT NULL").distinct()
    labels = components(pairs.where(F.col(linked)).select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")))
    return ids.join(labels, "v", "left").select(F.coalesce("label", "v").alias("group_source_id"), F.col("v").alias("source_id"))
