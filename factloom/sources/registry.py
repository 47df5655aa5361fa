"""Sources by name, and what may happen to their payloads before they are mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's format for each kind of source, and the options that it cannot do without.
FORMATS = {"parquet": ("parquet", []), "json": ("json", []), "csv": ("csv", []), "orc": ("orc", []), "text": ("text", []), "tcp": ("socket", ["host", "port"]), "kafka": ("kafka", ["kafka.bootstrap.servers"]), "rate": ("rate", [])}


class UnknownSource(ValueError):
    pass


def options_for(kind: str, options: dict[str, str]) -> tuple[str, dict[str, str]]:
    if kind not in FORMATS:
        raise UnknownSource(kind)
    name, needed = FORMATS[kind]
    if missing := [o for o in needed if o not in options]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    return name, options


def stream(spark: SparkSession, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    name, options = options_for(kind, options)
    reader = spark.readStream.format(name).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def route(path: str, default: str) -> str:
    """A source's path without its leading slash; its name if there is none."""
    return path.lstrip("/") or default


def conflate(payloads: DataFrame, window: str, by: list[str], order: str) -> DataFrame:
    """Only the last payload of each source and poll window: a slot that newer payloads overwrite."""
    slot = F.window(F.col(window).cast("timestamp"), "1 minute")["start"]
    last = payloads.groupBy(*by, slot.alias("__slot")).agg(F.max_by(F.struct(*payloads.columns), order).alias("__row"))
    return last.select("__row.*")
