"""The pipeline's stages on a small table, against plain Python, and its odd inputs."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from factloom.llm import latent_leaks
from factloom.llm.common import fresh_path
from tests.llm.test_near import brute_components

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    """documents with copies, near copies, benchmark passages and insults; labels; benchmark."""
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(2000)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [say(30) for _ in range(8)]
    rows, kind = [], {}

    def add(text, what, of=None):
        rows.append((len(rows), text, "en", "s", len(text or "")))
        kind[len(rows) - 1] = (what, of)

    for k in range(60):
        add(say(80), "clean")
        if k % 6 == 0:
            add(rows[-1][1], "copy", len(rows) - 1)
        if k % 6 == 1:
            words = rows[-1][1].split()
            words[40] = "changed"
            add(" ".join(words), "near", len(rows) - 1)
        if k % 6 == 2:
            add(say(40) + " " + items[k % 8] + " " + say(30), "leak")
        if k % 3 == 0:
            add(say(30) + " idiot " + say(10) + " pathetic moron " + say(10), "toxic")
    add(None, "clean")
    add("", "copy", len(rows) - 1)
    rows.append((None, say(50), None, None, None))
    rows.append(rows[0])
    path = fresh_path(spark, "t-pipeline")
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k[0] == "toxic")) for i, k in kind.items() if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, kind


def test_stages(spark, tables):
    path, rows, kind = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = {"toxicity": "toxic", "exact_dedup": "copy", "near_dedup": "near", "decontamination": "leak"}
    left = dict(kind)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString()
        where = fresh_path(spark, "t-stage")
        out.write.parquet(where)
        docs = spark.read.parquet(where)
        left = {i: k for i, k in left.items() if k[0] != gone[name]}
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        assert sorted(i for i in set(got) if i is not None) == sorted(left), name
        if name != "toxicity":  # a row that was there twice is there once
            assert len(got) == len(left) + 1 and None in got
        if name == "near_dedup":
            texts = [r.text for r in docs.collect()]
            assert [c for _, c in brute_components(texts, 5, 80)] == list(range(len(texts)))
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert final.count() == len(left) + 1 and final.where(F.col("n_tokens") > 0).count() == len(left)


def test_run_does_all_stages(spark, tables):
    path, _, kind = tables
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i for i, k in kind.items() if k[0] == "clean"} | {None}


def test_empty_table(spark, tables):
    empty = spark.createDataFrame([], DDL)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, tables[0]).count() == 0


def test_decontamination_is_fitted_on_all_documents(spark, tmp_path, monkeypatch):
    """Of 1,200 documents with a word of the benchmark none is left out of the latent space."""
    fitted, plain = [], latent_leaks.fit
    monkeypatch.setattr(latent_leaks, "fit", lambda items, counts, sketch, **rest: fitted.append((counts.n, sketch.passages)) or plain(items, counts, sketch, **rest))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"number {k} alpha and no more" for k in range(1200)] + ["so alpha beta gamma delta epsilon zeta eta theta it is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 1200
    assert fitted == [(1201, 1201)]
