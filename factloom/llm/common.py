"""Helpers that the text operators share: where tables are staged, how text is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stage`` wrote, when what was made of them has been written."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        base = shared_dir(spark)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if base.rpartition(":")[2].rstrip("/") in folder:  # nothing but what lies in the shared folder
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones where ``df`` has such a column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while any(t.startswith(name) for t in taken):
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand texts to Python in batches of at most ``rows`` rows (its default of 10,000 is meant for numbers)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows or int(spark.conf.get(name, "10000")) <= 0:
        spark.conf.set(name, str(rows))


def body(column: str | Column = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text only, so that no other column of the input can clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body("text").alias("text"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; never null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
