"""Schemas of the engine and the mutation log that the driver's ``events`` stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HLC = "struct<wall:bigint,logical:bigint,node_id:bigint>"
CAUSE = "struct<cause:bigint,entity:bigint,node:string>"
MUTATION = f"namespace string, entity bigint, component string, value string, hlc {HLC}, cause {CAUSE}, seq bigint"
KEYS = ["namespace", "entity", "component"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own; on a cluster it
    has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str = "ts") -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, cut off, not rounded."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def hlc(wall: Column | str, logical: Column | str, node: Column | str) -> Column:
    """A hybrid logical timestamp; Spark compares such structs by wall, then logical, then node."""
    return F.struct(*(F.col(c).alias(n) if isinstance(c, str) else c.cast("long").alias(n) for c, n in ((wall, "wall"), (logical, "logical"), (node, "node_id"))))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a mutation log that arrives out of order (``seq``)."""
    events = read(spark, sf_dir, "events")
    arrival = (F.col("event_id") * 7919 % 10007) * 1099511627776 + F.col("event_id")
    return events.select(
        F.lit("default").alias("namespace"), F.col("user_id").alias("entity"), F.col("event_type").alias("component"), "value",
        hlc(millis(), F.col("event_id"), F.lit(1)).alias("hlc"), arrival.alias("seq"), "event_id",
    )
