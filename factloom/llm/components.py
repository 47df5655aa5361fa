"""Connected components of a link table, as Spark joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _stars(links: DataFrame) -> bool:
    """Whether each node is linked to one smaller node that is linked to none smaller."""
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("dst", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.where("down > 1 OR down = 1 AND up = 1").agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, component for each node of a link table (src, dst): component is the smallest node reachable.

    Rounds of the two star operations: every node links its larger neighbours to its smallest
    one, then its smaller neighbours to the smallest of them, until all links are stars.  A hub is
    no hot group: smallest neighbours are combined before they are shuffled, and the join is
    on a key that Spark may split.  Each round's links go to the shared folder, so no lineage
    grows.  Null ends and links of a node with itself are left out.
    """
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    links = stage(links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    for _ in range(most_rounds):
        if _stars(links):
            break
        both = links.union(links.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").repartition("src")  # for both of the following
        down = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(down, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()
        before, links = links, stage(small, "links")
        drop(before)
    else:
        raise RuntimeError(f"links did not settle within {most_rounds} rounds")
    ends = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component").distinct())


def merged_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """``component`` (node, component) after further links (src, dst), whose nodes may be new: only links between components count."""
    one, two = (component.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")) for x in ("src", "dst"))
    between = edges.select("src", "dst").join(one, "src", "left").join(two, "dst", "left")
    between = stage(between.select(F.coalesce("src_in", "src").alias("src"), F.coalesce("dst_in", "dst").alias("dst")).where("src <> dst"), "between")
    if between.isEmpty():
        return component
    joined = connected_components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    all_ = component.union(joined.select("old", "old")).join(joined, F.col("component") == F.col("old"), "left")
    return stage(all_.select("node", F.coalesce("new", "component").alias("component")).distinct(), "components")
