"""Analysis of watch graphs given as link tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MostRoundsExceeded(RuntimeError):
    pass


def reachable(spark: SparkSession, links: DataFrame, *, depth: int | None = None, most_rounds: int = 10_000) -> DataFrame:
    """src, dst, steps: the fewest links from src to dst; a node reaches itself by a cycle only.

    A round for each step: only pairs that are new go on, and each round's are checkpointed, so
    lineage stays short.  MostRoundsExceeded if there are new pairs after ``most_rounds`` rounds;
    pairs further apart than ``depth``, if given, are left out.
    """
    links = links.select("src", "dst").distinct().checkpoint()
    front = known = links.withColumn("steps", F.lit(1))
    rounds = 1
    while depth is None or rounds < depth:
        walks = front.select("src", F.col("dst").alias("at")).join(links.withColumnRenamed("src", "at"), "at").select("src", "dst").distinct()
        new = walks.alias("w").join(known.alias("k"), F.col("w.src").eqNullSafe(F.col("k.src")) & F.col("w.dst").eqNullSafe(F.col("k.dst")), "left_anti")
        front = new.withColumn("steps", F.lit(rounds + 1)).checkpoint()
        if front.isEmpty():
            break
        if rounds >= most_rounds:
            raise MostRoundsExceeded(f"pairs are new after {most_rounds} rounds")
        rounds += 1
        known = known.union(front)
        if rounds % 8 == 0:  # so that the plan stays small
            known = known.checkpoint()
    return known


def on_cycles(spark: SparkSession, links: DataFrame, *, depth: int | None = None) -> DataFrame:
    """Nodes on a cycle, with the length of their shortest one."""
    return reachable(spark, links, depth=depth).where("src = dst").select(F.col("src").alias("node"), F.col("steps").alias("length"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of either graph only: change is 'removed' or 'added'."""
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))
