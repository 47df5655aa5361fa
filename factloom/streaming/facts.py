"""LWW facts of a stream, cascades in micro-batches, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.lww import latest


def facts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Current facts of an unbounded log, in complete or update mode.

    The same expression as for a table.  State never expires: a late mutation is compared, not dropped.
    """
    return latest(stream, keys)


class LwwProcessor(StatefulProcessor):
    """Keyed state for rules that read and write facts: gives each mutation that is accepted.

    Input rows have value, wall, logical, seq; rows of a batch are taken by seq.
    """

    def init(self, handle) -> None:
        self.fact = handle.getValueState("fact", "value double, wall bigint, logical bigint")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("seq")
        held = self.fact.get() if self.fact.exists() else None
        best = (held[1], held[2]) if held else None
        out = []
        for row in batch.itertuples(index=False):
            if best is None or (row.wall, row.logical) > best:
                best = (int(row.wall), int(row.logical))
                held = (float(row.value), *best)
                out.append((*key, *held))
        if out:
            self.fact.update(held)
            yield pd.DataFrame(out, columns=["entity", "component", "value", "wall", "logical"])

    def close(self) -> None:
        pass


def accepted_stream(stream: DataFrame) -> DataFrame:
    """Accepted mutations of a stream (entity, component, value, wall, logical, seq), by keyed state."""
    return stream.groupBy("entity", "component").transformWithStateInPandas(LwwProcessor(), "entity bigint, component string, value double, wall bigint, logical bigint", "Append", "None")


def commit_batches(stream: DataFrame, checkpoint: str, target: str, derive: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Write what each micro-batch derives, exactly once.

    A batch has its own folder, overwritten when the batch is run again after a failure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facts_at_end(stream: DataFrame, keys: list[str], where: str) -> DataFrame:
    """Current facts of a log read as a stream to its end: the folder that the last batch has written under ``where``.

    Every batch writes all facts, from the executors; the driver only learns the batch's number.
    """
    batches = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/facts/batch={batch_id}")
        batches.append(batch_id)

    current = facts(stream, keys)
    current.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(current.schema).parquet(f"{where}/facts/batch={batches[-1]}") if batches else spark.createDataFrame([], current.schema)


def post_alerts(alerts: DataFrame, send: Callable[[str, str], int], key: str = "alert_id") -> DataFrame:
    """Hand each alert to ``send(idempotency key, JSON)``, a client run on the executors; its status, 0 if it failed."""

    def run(batches):
        for pdf in batches:
            status = []
            for k, text in zip(pdf[key], pdf["json"], strict=True):
                try:
                    status.append(int(send(str(k), text)))
                except OSError:
                    status.append(0)
            yield pdf[[key]].assign(status=status)

    rows = alerts.select(F.col(key).cast("string").alias(key), F.to_json(F.struct(*alerts.columns)).alias("json"))
    return rows.mapInPandas(run, f"{key} string, status int")
