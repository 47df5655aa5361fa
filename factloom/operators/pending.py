"""Work that waits: ids, counts, acknowledgement, and the bounded queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lww import accepted
from .ordering import numbered


def pending_ids(log: DataFrame) -> DataFrame:
    """Accepted mutations, numbered from 1 in the order of arrival."""
    return numbered(accepted(log).where("accepted").drop("accepted"), "seq", name="id", start=1)


def acknowledge(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """Pending rows without those whose id is acknowledged; unknown ids do no harm."""
    return pending.join(acks.select("id").distinct(), "id", "left_anti")


def following(pending: DataFrame) -> DataFrame:
    """The next row of each namespace: that with the lowest id."""
    return pending.groupBy("namespace").agg(F.min_by(F.struct(*pending.columns), "id").alias("next")).select("next.*")


def queue_fold(ops: DataFrame, capacity: int, key: str = "entity") -> DataFrame:
    """Size of each key's queue after its pushes and pops by ``seq``, and how often it was full or empty.

    What some operations in a row do to a queue of size x is five numbers: they refuse
    ``refused`` + max(0, x - high) pushes, find it empty ``empty`` - min(x, low) times, and the rest of
    ``net`` is added.  Operations are joined by at most 4,096, then what they gave by as many, and so on,
    so no array grows with a key's operations.
    """

    def after(first, then):
        size = first["net"] - first["refused"] + first["empty"]  # of a queue that was empty
        shift = size - first["low"]
        return F.struct(
            (first["net"] + then["net"]).alias("net"),
            (first["refused"] + then["refused"] + F.greatest(F.lit(0), size - then["high"])).cast("long").alias("refused"),
            (first["empty"] + then["empty"] - F.least(size, then["low"])).cast("long").alias("empty"),
            *(F.greatest(first["low"], F.least(first["high"], then[c] - shift)).cast("long").alias(c) for c in ("low", "high")),
        )

    def whole(values: dict):
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("long").alias(c) for c, v in values.items()))

    nothing = {"net": 0, "refused": 0, "empty": 0, "low": 0, "high": capacity}
    some, none = min(capacity, 1), int(capacity == 0)
    push = whole({"net": 1, "refused": none, "empty": 0, "low": 0, "high": capacity - some})
    pop = whole({"net": -1, "refused": 0, "empty": 1, "low": some, "high": capacity})
    rows = numbered(ops.select(key, "seq", "op"), key, "seq", "op", name="__n")
    rows = rows.select(key, "__n", F.when(F.col("op") == "push", push).otherwise(pop).alias("__q"))
    for level in range(5):
        at = F.shiftright("__n", 12) if level < 4 else F.lit(0).cast("long")  # at the last a key has one or two rows
        ordered = F.array_sort(F.collect_list(F.struct("__n", "__q")))
        rows = rows.groupBy(key, at.alias("__at")).agg(F.aggregate(ordered, whole(nothing), lambda q, r: after(q, r["__q"])).alias("__q")).withColumnRenamed("__at", "__n")
    return rows.select(key, (F.col("__q.net") - F.col("__q.refused") + F.col("__q.empty")).alias("size"), "__q.refused", "__q.empty")


def remove_last(queue: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """The queue without the latest entry of each key in ``removals``."""
    last = queue.join(removals.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.max("seq").alias("seq"))
    return queue.join(last, [*keys, "seq"], "left_anti")
