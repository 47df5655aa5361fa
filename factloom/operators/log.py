"""The durable mutation log: append, replay, acknowledge, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEYS
from .lww import accepted, latest


def append(batch: DataFrame, path: str) -> None:
    """Add mutations (or, with kind = 'ack', acknowledgements) to the log; a failed job leaves nothing behind."""
    batch.write.mode("append").partitionBy("namespace").parquet(path)


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and pending mutations of a log with rows of kind 'put' and 'ack' (``acks`` names the put's seq)."""
    puts = log.where("kind = 'put'")
    acks = log.where("kind = 'ack'").select(F.col("acks").alias("seq")).distinct()
    waiting = accepted(puts).where("accepted").join(acks, "seq", "left_anti")
    return latest(puts), waiting


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write to ``target`` a log that replaces that of ``path``: ``replay`` gives the same of both.

    It has the puts of the current facts, with an acknowledgement if they do not wait, and the puts that wait.
    """
    log = spark.read.parquet(path)
    puts = log.where("kind = 'put'")
    waiting = replay(log)[1].select(*log.columns)
    current = latest(puts, KEYS, tuple(c for c in log.columns if c not in (*KEYS, "hlc"))).select(*log.columns)
    settled = current.join(waiting.select("seq"), "seq", "left_anti").select(*log.columns)
    acks = settled.withColumns({"kind": F.lit("ack"), "acks": F.col("seq")})
    waiting.unionByName(settled).unionByName(acks).write.mode("errorifexists").partitionBy("namespace").parquet(target)


def within_limits(log: DataFrame, *, record: int = 16 << 20, field: int = 8 << 20, batch: str | None = None, mutations: int = 1 << 20) -> DataFrame:
    """Rows of which no field is empty or too large and no record is too large.

    With ``batch``, a column that names the record which mutations are written together in,
    records of more than ``mutations`` are left out as a whole.
    """
    size = sum((F.octet_length(F.col(c).cast("string")) for c in ("namespace", "value")), F.lit(64))
    good = log.where((size <= record) & (F.octet_length(F.col("value").cast("string")) <= field) & (F.octet_length("namespace") > 0))
    if batch is None:
        return good
    many = log.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > mutations).select(batch)
    return good.join(many, batch, "left_anti").select(*log.columns)


def of_namespace(log: DataFrame, namespace: str | None) -> DataFrame:
    """The rows of one namespace (a folder of the log, so no other is read), or of all."""
    return log if namespace is None else log.where(F.col("namespace") == namespace)
