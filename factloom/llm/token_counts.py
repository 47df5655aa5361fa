"""Token counts by a digest cache.

Each text's digest, with the digest of the tokenizer file, is looked up in a stored table of
counts.  Only distinct texts that are not stored are encoded; their counts are appended.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .chunks import Memo, kind_of, spaced, words
from .common import id_and_text

_CACHE = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """sha256 of the tokenizer's file: its version in the cache."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """tokenizer, digest, n_tokens; one row for each pair.  A missing cache is an empty one."""
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], _CACHE)
    return stored.groupBy("tokenizer", "digest").agg(F.min("n_tokens").alias("n_tokens"))


_READY: dict[str, object] = {}


def _counter(version: str, spec, kind: str):
    """The counting function of this worker, made once."""
    if version not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _READY.clear()
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=spec.value)
            _READY[version] = lambda text: len(model.encode(text))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(spec.value.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            memo = Memo(lambda parts: [len(e.ids) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            cut = {"byte": spaced, "word": words}.get(kind)
            _READY[version] = (lambda text: sum(memo(cut(text)))) if cut else (lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids))
    return _READY[version]


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, digest.

    ``tokenizer`` is a file of the tokenizers library (.json) or of sentencepiece (.model),
    ``cache`` the folder of the stored counts, shared by all executors; it is appended to.
    Null text counts as empty.  Null ids and repeated rows pass through (equal texts are encoded
    and stored once, whatever their ids), very long texts are counted whole, an empty table gives
    no rows, other columns are ignored.  Counts are of plain text: no special tokens are added,
    nothing is cut off or padded.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        content = file.read()
    version, kind = hashlib.sha256(content).hexdigest(), kind_of(tokenizer, content)
    spec = spark.sparkContext.broadcast(content)
    rows = id_and_text(docs).select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    # the first row of each digest: each task leaves one of its own before anything is shuffled
    place = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    one = rows.withColumn("place", place).where("place = 1").select("digest", "text")
    missing = one.join(stored, "digest", "left_anti")

    def run(batches):
        count = _counter(version, spec, kind)
        for batch in batches:
            counts = [count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    new = missing.mapInArrow(run, "digest string, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    sizes = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
