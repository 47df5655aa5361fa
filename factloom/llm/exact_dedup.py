"""Exact duplicates by content sort, in DataFrame operations only.

Texts are range-partitioned by their leading characters and a content hash (Spark samples the
splitters; only these short keys are sampled, never whole texts), sorted externally by whole
text within each range, and neighbouring rows are compared in full by the window operator.

A text that very many rows share would fill one range.  Such hot texts are found by a count of
content hashes, which is combined before it is shuffled; their rows get a salt from the id, so
that a hot text is several sorted runs, whose totals are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, id_and_text, stage, unused


def exact_dedup(docs: DataFrame, *, keep: str = "largest", salts: int = 64, hot_texts: int = 2000, least_hot: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the largest (or, with ``keep="smallest"``, the
    smallest) doc_id stays.  Null text counts as empty.  Rows repeated with the same doc_id are
    rows of the group like any others; exactly one row of each group has kept = true.  A null
    doc_id loses against any other; a group with nulls only keeps one of them and its keep_id
    is null.  Very long texts are sorted and compared whole.  An empty table gives no rows; other
    columns are ignored.

    A text is hot with more than max(least_hot, rows / hot_texts) rows, so there are at most
    ``hot_texts`` hot texts and ``hot_texts * salts`` runs of them: that bounds both broadcasts.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    best, merge = (F.desc_nulls_last("doc_id"), F.max) if keep == "largest" else (F.asc_nulls_last("doc_id"), F.min)
    rows = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    hot = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(least_hot, docs.count() // hot_texts)).select("h", F.lit(True).alias("hot"))
    keyed = rows.join(F.broadcast(hot), "h", "left").select(
        "doc_id", "text", "h", F.coalesce("hot", F.lit(False)).alias("hot"), F.substring("text", 1, 64).alias("head"),
        F.when(F.col("hot"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(salts))).otherwise(0).cast("int").alias("salt"),
    )
    run = ["head", "h", "salt", "text"]
    whole = Window.partitionBy(*run)
    runs = keyed.repartitionByRange("head", "h", "salt").select(
        "doc_id", "h", "salt", "hot",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(whole.orderBy(best)).alias("place"),
        merge("doc_id").over(whole).alias("run_id"),
        F.count(F.lit(1)).over(whole).alias("run_n"),
        F.when(F.col("hot"), F.col("text")).alias("hot_text"),
    ).withColumn("hot_text", F.when(F.col("place") == 1, F.col("hot_text")))
    runs = stage(runs, "content-runs")  # one whole text for each run of a hot text, none else
    group = Window.partitionBy("h", "hot_text")
    totals = runs.where(F.col("hot_text").isNotNull()).select(
        "h", "salt", "text_sha256", merge("run_id").over(group).alias("all_id"), F.sum("run_n").over(group).alias("all_n"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("run_id") if keep == "largest" else F.asc_nulls_last("run_id"), "salt")) == 1).alias("first_run"),
    )
    return runs.join(F.broadcast(totals), ["h", "salt", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("run_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("run_n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | F.coalesce("first_run", F.lit(False)))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, *, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of equal texts only one: see ``exact_dedup``.

    Rows are told apart by doc_id and text.  Of rows that repeat both, one stays, by a hash of
    all columns, so the same one at every run.
    """
    own, sha, place = unused(docs, "row_id", "row_sha", "place")
    kept = exact_dedup(docs, keep=keep).where("kept").select(F.col("keep_id").alias(f"{own}2"), F.col("text_sha256").alias(f"{sha}2"))
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), sha: F.sha2(body("text").cast("binary"), 256)})
    found = rows.join(kept, F.col(own).eqNullSafe(F.col(f"{own}2")) & (F.col(sha) == F.col(f"{sha}2")), "left_semi")
    alone = F.row_number().over(Window.partitionBy(own, sha).orderBy(F.xxhash64(*docs.columns)))
    return found.withColumn(place, alone).where(F.col(place) == 1).select(*docs.columns)
