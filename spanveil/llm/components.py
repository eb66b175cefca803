"""Connected components of a table of links, by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) of every node that has a link.

    Each round gives every node the least of its neighbours and itself as parent and contracts the
    links to the parents; a component of d nodes in a line takes about log d rounds.  The least node of a
    component always is its own parent, so it is what remains.
    """
    links = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "links")
    found = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        parents = cut(ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents")
        one = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        two = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        links = cut(links.join(one, "a").join(two, "b").filter("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "links")
        if found is None:
            found = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "found")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
