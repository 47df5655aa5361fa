"""Last-write-wins facts: one value for each key, that of the greatest timestamp; of equal ones the first to arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS


def _rank() -> Column:
    return F.struct("hlc", (-F.col("seq")).alias("earlier"))


def latest(log: DataFrame, keys: list[str] = KEYS, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Current facts of a mutation log.  Combined before the shuffle, so hot keys cost a row for each task."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values, "hlc"), _rank()).alias("fact")).select(*keys, "fact.*")


def accepted(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The log with ``accepted``: whether a mutation's timestamp is above all that arrived before it for its key."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("hlc").over(before)
    return log.withColumn("accepted", seen.isNull() | (F.col("hlc") > seen))


def merge(local: DataFrame, remote: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Facts of two replicas together; at equal timestamps the local one stays."""
    both = local.withColumn("seq", F.lit(0)).unionByName(remote.withColumn("seq", F.lit(1)))
    return latest(both, keys)


def undo(log: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accepted mutations with the value that each replaced (null for a key's first)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    return accepted(log, keys).where("accepted").withColumn("previous", F.lag("value").over(order))


def latest_timestamp(facts: DataFrame) -> DataFrame:
    """The greatest timestamp of the current facts of each namespace."""
    return facts.groupBy("namespace").agg(F.max("hlc").alias("hlc"))


def as_of(log: DataFrame, hlc: Column, keys: list[str] = KEYS) -> DataFrame:
    """Facts as they were at a timestamp."""
    return latest(log.where(F.col("hlc") <= hlc), keys)


def read_through(cache: DataFrame, durable: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Facts of the cache, and of the durable store where the cache has none."""
    stored = durable.select(*keys, F.col("value").alias("stored"))
    return cache.select(*keys, "value").join(stored, keys, "full").select(*keys, F.coalesce("value", "stored").alias("value"))


def lookup(facts: DataFrame, keys: DataFrame, on: list[str] = KEYS) -> DataFrame:
    """The facts of the given keys; null values where there is none."""
    return keys.select(*on).distinct().join(facts, on, "left")


def side_by_side(log: DataFrame, components: list[str], entity: str = "entity") -> DataFrame:
    """A row for each entity with the current value of each of its ``components``, as a rule reads them."""
    def last(c: str) -> Column:
        own = F.col("component") == c
        return F.max_by(F.when(own, F.col("value")), F.when(own, _rank())).alias(f"{c}_value")

    return log.groupBy(entity).agg(*map(last, components))
