"""Language identification by the nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3 letters, words
apart).  Each language has several centroids, found by spherical k-means; a text gets the
language of the centroid with the largest cosine.  It is rejected when even that cosine is
further off than nearly all of the learning texts of that language were.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

SIZE = 2048
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or 0 for what is no letter."""
    if not _LETTERS:
        low = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low[k] = ord(x) if len(x := c.lower()) == 1 else k
        _LETTERS.append(low)
    return _LETTERS[0]


def counts(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text; all zero without a letter."""
    points = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    a = np.concatenate(([0], points, [0])).astype(np.uint32)
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]  # one mark between words
    if len(a) < 3:
        return np.zeros(SIZE, np.int64)
    one = a * np.uint32(2654435761)
    two = (one[:-1] ^ (a[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (a[2:] * np.uint32(668265263))) * np.uint32(374761393)
    grams = np.concatenate((one[a != 0], two, three[a[1:-1] != 0]))
    return np.bincount((grams >> np.uint32(9)) % np.uint32(SIZE), minlength=SIZE)


class Model(NamedTuple):
    languages: list[str]
    centroids: np.ndarray  # a row for each
    language_of: np.ndarray  # of each centroid
    least: np.ndarray  # of each language: the smallest accepted cosine
    idf: np.ndarray


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def _clusters(v: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    centres = v[draw.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(12):
        of = (v @ centres.T).argmax(1)
        centres = np.stack([v[of == j].mean(0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, learn: Column, *, each: int = 1000, clusters: int = 4, reject: float = 0.002) -> Model:
    """Learn from text and lang of the rows of ``docs`` for which ``learn`` holds; null langs are left out.

    Document frequencies are counted over all of these rows and whole texts.  Every language is
    learned, its centroids by one task from at most ``each`` of its rows (those with the smallest
    hash of doc_id and text; repeated rows count once).  The model has ``clusters`` rows of 2,048
    numbers for each language, however many documents there are.  Null ids are learned from too.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def presence(batches):
        seen = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[:SIZE] += counts(text) > 0
                seen[SIZE] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(seen)], ["gram", "n"])

    frequency = np.zeros(SIZE + 1)
    for gram, n in known.select("text").mapInArrow(presence, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        frequency[gram] = n
    idf = np.log((1 + frequency[SIZE]) / (1 + frequency[:SIZE])) + 1

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    known = known.withColumn("hash", F.xxhash64("doc_id", "text")).drop("doc_id")
    hashed = known.select("lang", "hash")
    # a bound on the hash that keeps a few times ``each`` rows of a language, before any is ranked
    spans = hashed.groupBy("lang").agg((F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(3.0 * each) / F.count(F.lit(1)))).alias("below"))
    near = hashed.join(spans, "lang").where(F.col("hash").cast("double") <= F.col("below")).select("lang", "hash").distinct()
    chosen = near.withColumn("place", rank).where(F.col("place") <= each).drop("place")

    def sparse(batches):
        for batch in batches:
            rows = [counts(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(r).astype(np.int16) for r in rows]
            values = [r[i].astype(np.int32) for r, i in zip(rows, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array([x.tobytes() for x in at]), pa.array([x.tobytes() for x in values])], ["lang", "hash", "at", "values"])

    def learned(rows):
        """One language's centroids, and the cosine below which a text is rejected."""
        rows = rows.sort_values("hash", ignore_index=True)
        tf = np.zeros((len(rows), SIZE), np.float32)
        for i, (at, values) in enumerate(zip(rows["at"], rows["values"], strict=True)):
            tf[i, np.frombuffer(at, np.int16)] = np.frombuffer(values, np.int32)
        v = _vectors(tf, idf)
        v = v[v.any(1)] if v.any() else v
        centres = _clusters(v, clusters, np.random.default_rng(5))
        return pd.DataFrame({"lang": [rows["lang"][0]], "centres": [centres.astype("<f4").tobytes()], "least": [float(np.quantile((v @ centres.T).max(1), reject))]})

    rows = known.join(chosen, ["lang", "hash"]).select("lang", "hash", "text").mapInArrow(sparse, "lang string, hash long, at binary, values binary").dropDuplicates(["lang", "hash"])
    found = sorted(rows.groupBy("lang").applyInPandas(learned, "lang string, centres binary, least double").collect())
    centroids = [np.frombuffer(centres, "<f4").reshape(-1, SIZE) for _, centres, _ in found]
    language_of = [j for j, c in enumerate(centroids) for _ in c]
    return Model([lang for lang, _, _ in found], np.concatenate(centroids) if found else np.zeros((0, SIZE)), np.array(language_of, int), np.array([x for _, _, x in found]), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the cosine, 0 to 1), rejected.

    ``lang_pred`` is ``und`` for a null text or one without a letter, and for all texts when the
    model has no language; then score is 0 and rejected is true.  Nothing is shuffled; very long
    texts are read whole; null ids and repeated rows pass through; of equal cosines the language
    first in the alphabet wins; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                tf = np.stack([counts(t) for t in texts[i : i + 256]])
                some = tf.any(1) & bool(len(model.languages))
                cosine = _vectors(tf, model.idf) @ model.centroids.T if len(model.languages) else np.zeros((len(tf), 1))
                best = cosine.argmax(1)
                score = np.where(some, np.clip(cosine.max(1).astype(float), 0, 1), 0.0)
                of = model.language_of[best] if len(model.languages) else best
                lang = [model.languages[k] if ok else "und" for k, ok in zip(of, some, strict=True)]
                far = [not ok or s < model.least[k] for k, ok, s in zip(of, some, score, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), pa.array(lang, pa.string()), pa.array(score), pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
