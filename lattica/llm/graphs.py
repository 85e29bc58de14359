"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Every round takes the smallest label among the neighbours and then the label of
    that label, so long paths shrink by half a round. Rounds are written tables.
    Hubs and large components are heavy keys of ``common.lookup``.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.write(both, f"{name}-edges")
    total = both.count()
    labels = scratch.write(both.groupBy("a").agg(F.count("*").alias("degree"), F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root", "degree"), f"{name}-0")
    k = 0
    while total:
        told = lookup(both.withColumnRenamed("a", "node"), labels, ["node"], "degree", total, ["b", "node"])
        heard = told.groupBy("b").agg(F.min("root").alias("heard")).withColumnRenamed("b", "node")
        nearer = labels.join(heard, "node").select("node", "degree", F.col("root").alias("was"), F.least("root", "heard").alias("mid"))
        nearer = scratch.write(nearer, f"{name}-near-{k}")
        sizes = nearer.groupBy("mid").agg(F.count("*").alias("size"))
        roots = sizes.join(nearer.select(F.col("node").alias("mid"), F.col("mid").alias("root")), "mid")
        jumped = lookup(nearer, roots, ["mid"], "size", nearer.count(), ["node"])
        k += 1
        labels = scratch.write(jumped.select("node", "root", "degree", "was"), f"{name}-{k}")
        changed = not labels.where("root <> was").isEmpty()
        scratch.drop(f"{name}-near-{k - 1}")
        scratch.drop(f"{name}-{k - 1}")
        labels = labels.drop("was")
        if not changed:
            break
    return labels.select("node", "root")
