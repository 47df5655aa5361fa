"""Positions in a total order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *order: str, name: str = "row_id", start: int = 0) -> DataFrame:
    """``rows`` with consecutive numbers in the order of the columns ``order``.

    Spark range-partitions and sorts; the counts of partitions (as many rows as partitions) give
    each its first number.  The sorted rows are checkpointed, as splitters are sampled and a
    second evaluation could cut elsewhere.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ordered = ordered.checkpoint().withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__first"))  # one row for each partition
    return ordered.join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + F.col("__at") + start).drop("__part", "__at", "__first")


def ordered_map(changes: DataFrame, key: str = "key") -> DataFrame:
    """The entries of an ordered map after upserts and deletes (key, op, value, seq), sorted by key."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'set'").select(key, "last.value").orderBy(key)
