"""Trees of Spark's models as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_column(node, features: list[Column]) -> Column:
    """The share of label 1 in the leaf that the features lead to."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / max(sum(stats), 1e-9)))
    split = node.split()
    return F.when(features[split.featureIndex()] <= float(split.threshold()), tree_column(node.leftChild(), features)).otherwise(
        tree_column(node.rightChild(), features)
    )


def forest_column(model, features: list[Column]) -> Column:
    """The mean over a forest's trees."""
    trees = [tree_column(tree._call_java("rootNode"), features) for tree in model.trees]
    total = trees[0]
    for tree in trees[1:]:
        total = total + tree
    return total / len(trees)
