"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of the links by a node of its component: columns node, label.

    Contraction: in each round every node points at the neighbour (or itself) of the smallest hash, then
    links are drawn between the targets, repeated ones and loops go, and the rest is the next round's
    input. Hashed order makes the expected number of rounds logarithmic for any shape, chains included.
    The targets are then followed back to the nodes. Hubs are harmless: minima are combined before each
    shuffle. All tables stay on the executors. Null ends are left out; no links give no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    steps: list[DataFrame] = []
    edges = keep(edges)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(7), c).alias("h"), c.alias("v"))
        step = keep(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(order(F.col("b"))).alias("near"))
            .select("node", F.least(order(F.col("node")), F.col("near"))["v"].alias("target"))
        )
        steps.append(step)
        one = step.select(F.col("node").alias("a"), F.col("target").alias("ta"))
        two = step.select(F.col("node").alias("b"), F.col("target").alias("tb"))
        edges = keep(
            edges.join(one, "a").join(two, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # A target is a node of the next round unless its component was done; then it is the label.
    labels = steps[-1].select("node", F.col("target").alias("label"))
    for step in reversed(steps[:-1]):
        later = labels.select(F.col("node").alias("target"), F.col("label").alias("later"))
        labels = keep(step.join(later, "target", "left").select("node", F.coalesce("later", "target").alias("label")))
    return labels
