"""A key/value store for each module: the state after a log of set and delete operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["namespace", "module", "key"]


def state(ops: DataFrame) -> DataFrame:
    """Key and value of what is there after all ``ops`` (namespace, module, key, op, value, seq)."""
    last = ops.groupBy(*KEYS).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'set'").select(*KEYS, "last.value")


def deletions(ops: DataFrame) -> DataFrame:
    """Each delete with ``existed``: whether it found the key."""
    before = F.lag("op").over(Window.partitionBy(*KEYS).orderBy("seq"))
    return ops.withColumn("existed", F.coalesce(before == "set", F.lit(False))).where("op = 'delete'")


def get(state_: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (namespace, module, key) with status 0, value and length, or status 1 if the key is missing or empty text."""
    bad = F.coalesce(F.col("key") == "", F.lit(True))
    found = requests.join(state_.withColumn("there", F.lit(True)), KEYS, "left")
    status = F.when(bad | F.col("there").isNull(), 1).otherwise(0)
    return found.select(*requests.columns, status.alias("status"), F.when(status == 0, F.col("value")).alias("value"), F.when(status == 0, F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))).alias("length"))
