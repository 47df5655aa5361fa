"""Labelled rows, all or a bounded sample, for the classifiers of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stage


def _known(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    return chosen.groupBy("doc_id").agg(F.max("label").alias("label"))


def _with_text(docs: DataFrame, known: DataFrame) -> DataFrame:
    found = id_and_text(docs).join(known, "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("row"))
    return stage(one.select("row.label", "row.text"), "labelled")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """label, text of all labelled rows for which ``learn`` holds, written once.

    Null labels and ids are left out, repeated labels count once, and of documents that share an
    id one counts (the smallest hash of the text).
    """
    return _with_text(docs, _known(labels, label, learn))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """``most`` rows of ``labelled`` at most: the ones with the smallest hash of doc_id, the same at every run.

    ``most`` bounds the broadcast and the result.
    """
    return _with_text(docs, F.broadcast(_known(labels, label, learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, by Newton's method; ``y`` may be probabilities."""
    weight = np.ones(len(x)) if weight is None else weight
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
