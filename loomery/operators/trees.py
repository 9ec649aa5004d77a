"""Rollout trees as tables of (id, parent): roots, leaves, and what drafts earn from their descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_root(d: DataFrame, node: str, parent: str, depth: int) -> DataFrame:
    """d with `root`, each node's topmost ancestor, for trees of at most `depth` levels below the root.

    Pointers are doubled, so that the joins are as many as the logarithm of the depth; each is an equi-join on the node.
    """
    jump = d.select(F.col(node).alias("_n"), F.coalesce(parent, node).alias("_up"))
    for _ in range(max(1, (depth - 1).bit_length())):
        up = jump.select(F.col("_n").alias("_up"), F.col("_up").alias("_next"))
        jump = jump.join(up, "_up").select("_n", F.col("_next").alias("_up"))
    return d.join(jump.select(F.col("_n").alias(node), F.col("_up").alias("root")), node)


def leaves(d: DataFrame, node: str, parent: str) -> DataFrame:
    return d.join(d.select(F.col(parent).alias(node)).where(F.col(node).isNotNull()).distinct(), node, "left_anti")


def draft_rewards(d: DataFrame, node: str, parent: str, score: str, depth: int) -> DataFrame:
    """root, reward (mean score of its descendant leaves), delta (mean of leaf less root) and leaves."""
    low = leaves(with_root(d, node, parent, depth), node, parent)
    own = d.select(F.col(node).alias("root"), F.col(score).alias("_own"))
    g = low.groupBy("root").agg(F.avg(score).alias("reward"), F.count("*").alias("leaves"))
    return g.join(own, "root").select("root", "reward", (F.col("reward") - F.col("_own")).alias("delta"), "leaves")
