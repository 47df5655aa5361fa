"""Text frames that web sockets and webhooks have put into a folder, as a stream.

One JSON line for each frame, ``{"route", "body"}``, in files on any file system that Spark reads.
Files are tracked by the query's checkpoint, so each is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The answers of a webhook endpoint.
RECEIVED, EMPTY, UNKNOWN = 200, 400, 404


def frames(spark: SparkSession, path: str, routes: list[str] | None = None, *, files_a_batch: int = 1000) -> DataFrame:
    """route (without leading slash), body, frame (file and digest of the line), status, of each line.

    The status says whether a frame is received, has an empty body (or is no JSON object), or a
    route that is not among ``routes``.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.jsonl").text(path)
    parsed = F.from_json("value", "route string, body string")
    route, body = F.ltrim(F.coalesce(parsed["route"], F.lit("")), F.lit("/")), F.coalesce(parsed["body"], F.lit(""))
    known = F.lit(True) if not routes else route.isin([r.lstrip("/") for r in routes])
    status = F.when(body == "", EMPTY).when(~known, UNKNOWN).otherwise(RECEIVED)
    name = F.concat_ws(":", F.col("_metadata.file_name"), F.hex(F.xxhash64("value")))
    return lines.select(route.alias("route"), body.alias("body"), name.alias("frame"), status.alias("status"))


def received(stream: DataFrame) -> DataFrame:
    """The frames to be mapped."""
    return stream.where(F.col("status") == RECEIVED).drop("status")
