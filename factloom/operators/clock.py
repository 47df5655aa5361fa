"""Hybrid logical clocks: the timestamps that a node's sends and receives get."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def send(ticks: DataFrame, node: str = "node") -> DataFrame:
    """Timestamps of sends (node, seq, now): ``wall`` and ``logical``, as if each node took its rows by ``seq``.

    The wall is the largest ``now`` so far; the logical part counts the sends at one wall.
    """
    wall = F.max("now").over(Window.partitionBy(node).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    count = F.row_number().over(Window.partitionBy(node, "wall").orderBy("seq")) - 1
    return ticks.withColumn("wall", wall).withColumn("logical", count.cast("long"))


def send_after(ticks: DataFrame, seeds: DataFrame, node: str = "node") -> DataFrame:
    """``send`` for clocks restored from ``seeds`` (node, wall, logical): they never go back."""
    first = seeds.select(node, F.lit(-(2**62)).alias("seq"), F.col("wall").alias("now"), F.col("logical").alias("from"))
    rows = ticks.withColumn("from", F.lit(None).cast("long")).unionByName(first, allowMissingColumns=True)
    at_seed = F.max("from").over(Window.partitionBy(node, "wall"))
    return send(rows, node).withColumn("logical", F.col("logical") + F.coalesce(at_seed, F.lit(0))).where("from IS NULL").drop("from")


def receive(messages: DataFrame, node: str = "node") -> DataFrame:
    """Each node's clock after all its messages (node, seq, now, remote_wall, remote_logical), taken by ``seq``.

    The wall is the largest of all.  From the first message with it on, the logical part goes up by one with
    each message, or to one more than a remote's at this wall: it is the largest start of these plus the messages
    that follow.  So all is maxima over numbered messages, which Spark combines before the shuffle.
    """
    columns = ("now", "remote_wall", "remote_logical")
    rows = numbered(messages.select(node, "seq", *(F.col(c).cast("long").alias(c) for c in columns)), node, "seq", *columns, name="__n", start=1)
    highest = F.greatest("now", "remote_wall")
    found = rows.groupBy(node).agg(
        F.max(F.struct(highest.alias("wall"), (-F.col("__n")).alias("before"), "remote_wall")).alias("top"),
        F.max(F.struct("remote_wall", (F.col("remote_logical") + 1 - F.col("__n")).alias("start"))).alias("remote"),
        F.min("__n").alias("first"),
        F.max("__n").alias("last"),
    )
    wall = F.greatest(F.col("top.wall"), F.lit(0).cast("long"))
    start = F.greatest(
        F.when(F.col("remote.remote_wall") == wall, F.col("remote.start")),
        F.when(wall == 0, 1 - F.col("first")).when(~F.col("top.remote_wall").eqNullSafe(wall), F.col("top.before")),
    )
    return found.select(node, wall.alias("wall"), (F.col("last") + start).alias("logical"))


def received(messages: DataFrame, node: str = "node") -> DataFrame:
    """Each message (node, seq, now, remote_wall, remote_logical) with the stamp (wall, logical) that its receipt gets.

    The wall is the largest so far.  In a run of one wall the logical part goes up by one with
    each message, or to one more than a remote's at that wall, so it is the largest of all starts
    so far plus the messages since.  A node's messages are sorted by one task, which spills; it
    holds no array of them.
    """
    order = Window.partitionBy(node).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("wall", F.greatest(F.max(F.greatest("now", "remote_wall")).over(order), F.lit(0)).cast("long"))
    run = Window.partitionBy(node, "wall").orderBy("seq")
    rows = rows.withColumn("__k", F.row_number().over(run))
    same = F.col("remote_wall") == F.col("wall")
    start = F.when(same, F.col("remote_logical") + 1).when(F.col("__k") == 1, F.when(F.col("wall") == 0, 1).otherwise(0))
    most = F.max(start - F.col("__k")).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("logical", (most + F.col("__k")).cast("long")).drop("__k")
