"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut


def components(links: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """node, label (and `by`) for every node of the links; the label is the component's least node.

    The columns `by` tell graphs apart, each with nodes of its own. In each round every node first links its larger
    neighbours to the least one that it knows, then its smaller ones; what remains is a star around the least node.
    Links are combined before each shuffle, no task sees a component whole. Null ends and loops are left out; no links
    give no rows.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(pairs.select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())  # v < u
    key = [*by, "u"]
    while True:
        both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key).agg(F.min("v").alias("m")).select(*key, F.least("u", "m").alias("m"))
        larger = edges.select(*by, F.col("v").alias("u"), F.col("u").alias("w"))
        large = cut(larger.join(least, key).select(*by, F.col("w").alias("u"), F.col("m").alias("v")).distinct())  # used twice
        lowest = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(lowest, key).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(lowest.select(*key, F.col("m").alias("v"))).distinct())
        # Stars: no node has two smaller neighbours, and none that is one has a smaller one itself.
        done = new.groupBy(*key).count().where("count > 1").isEmpty() and new.join(new.select(*by, F.col("u").alias("v")), [*by, "v"], "left_semi").isEmpty()
        edges = new
        if done:
            break
    return edges.select(*by, F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(*by, F.col("v").alias("node"), F.col("v").alias("label")).distinct())
