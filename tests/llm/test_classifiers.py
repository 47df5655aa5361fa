"""The learned operators against plain, slow versions, and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import centroid_language, labelled, pairwise_quality, weak_toxicity

DDL = "doc_id long, text string, label int, score string, votes string, x string, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "s", "v", "x", "h") for i, t in rows], DDL)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_a_sample_is_bounded(spark):
    """An id that 3,000 rows share gives one row, the same one at every run."""
    docs = table(spark, [(1, f"text {k}") for k in range(3000)] + [(k, "other") for k in range(2, 40)] + [(None, "no id")])
    known = labels(spark, [(k, 1, 0) for k in range(40)] + [(None, 1, 1), (3, None, None)])
    got = [sorted((r.label, r.text) for r in labelled.sample(docs, known, "quality", F.lit(True), 10).collect()) for _ in range(2)]
    assert got[0] == got[1] and 0 < len(got[0]) <= 10
    assert len(labelled.sample(docs, known, "quality", F.lit(True), 1000).collect()) == 39


def rude_texts(seed=1, n=900):
    """A lexicon of 30 rude words, each in about 1 in 15 toxic rows, among 2,000 others."""
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(k))
    rude, plain = [f"zq{word(3)}" for _ in range(30)], [word(4) for _ in range(2000)]
    rows = []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(30)]
        if toxic := i % 3 == 0:
            words[5] = rude[i // 3 % len(rude)]
            words[9] = draw.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    return rude, rows


def test_mined_entries_are_those_of_a_plain_count(spark):
    rude, rows = rude_texts()
    docs, known = table(spark, [(i, t) for i, t, _ in rows]), labels(spark, [(i, 1, y) for i, _, y in rows])
    found, sure = weak_toxicity.mine(labelled.sample(docs, known, "toxic", F.lit(True), 20_000))
    seen = {0: Counter(), 1: Counter()}
    for _, text, y in rows:
        seen[y].update(set(weak_toxicity.entries(text)))
    n = Counter(y for _, _, y in rows)
    want = set()
    for e, yes in seen[1].items():
        no, share = seen[0][e], n[1] / len(rows)
        ratio = math.log((yes + 0.5) / (n[1] + 1)) - math.log((no + 0.5) / (n[0] + 1))
        surprise = 2 * (yes * math.log(yes / ((yes + no) * share)) + (no * math.log(no / ((yes + no) * (1 - share))) if no else 0))
        if ratio >= 3 and surprise >= 30:
            want.add(e)
    assert set(found) == want and set(rude) <= want
    assert sure == {e for e in want if seen[1][e] >= 0.99 * (seen[0][e] + seen[1][e])}


def test_toxicity_scores_of_a_plain_sum_and_held_out(spark):
    rude, rows = rude_texts(2)
    docs, known = table(spark, [(i, t) for i, t, _ in rows]), labels(spark, [(i, 1, y) for i, _, y in rows])
    model = weak_toxicity.fit(docs, known, F.col("doc_id") % 4 != 0)
    odd = table(spark, [(None, rows[0][1]), (None, None), (7, ""), (7, rude[0] + " " + rude[1]), (7, "x " * 50_000 + rude[2])])
    got = {(r.doc_id, r.score, r.predicted) for r in weak_toxicity.score(docs.union(odd), model).collect()}
    texts = [(i, t) for i, t, _ in rows] + [(None, rows[0][1]), (None, None), (7, ""), (7, rude[0] + " " + rude[1]), (7, "x " * 50_000 + rude[2])]
    want = set()
    lexicon = {**{(w, len(w)): v for w, v in model.lexicon.words.items()}, **{(s, -len(s)): v for s, v in model.lexicon.stems.items()}}
    for i, text in texts:
        words = weak_toxicity._WORD.findall((text or "").lower())
        fired, hits = set(), 0
        for w in words:
            own = {v for (e, k), v in lexicon.items() if (w == e if k > 0 else len(w) > -k and w.startswith(e))}
            fired |= own
            hits += bool(own & model.lexicon.sure)
        patterns = [bool(fired & model.lexicon.sure), hits > 1, hits > 0 and 20 * hits >= len(words)]
        z = sum(model.weights[v] for v in fired) + sum(model.weights[model.lexicon.size + k] for k, on in enumerate(patterns) if on) + model.weights[-1]
        want.add((i, round(1 / (1 + math.exp(-z)), 9), int(z >= 0)))
    assert {(i, round(s, 9), p) for i, s, p in got} == want
    by = {i: p for i, _, p in got}
    held = [(by[i], y) for i, _, y in rows if i % 4 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    left = weak_toxicity.without_toxic(odd, model)
    assert left.columns == odd.columns and left.where("text IS NULL OR text = ''").count() == 2 and left.count() == 2
    assert weak_toxicity.score(table(spark, []), model).count() == 0


def test_label_model_counts_copies_of_a_voter_once():
    """Ten copies of one voter say little more than the voter; an independent second one says more."""
    draw = np.random.default_rng(3)
    truth = draw.random(4000) < 0.3
    a, b = (np.where(truth, draw.random(4000) < 0.7, draw.random(4000) < 0.1) for _ in range(2))
    lists = [[*range(10)] * int(x) + [10] * int(y) for x, y in zip(a, b, strict=True)]
    p, accuracy = weak_toxicity.label_model(weak_toxicity.Votes.of(lists, 11), truth.astype(float))
    only_a, only_b, both = (p[m].mean() for m in (a & ~b, b & ~a, a & b))
    assert abs(only_a - only_b) < 0.15 and both > max(only_a, only_b) + 0.05
    assert np.allclose(accuracy[10], [0.7, 0.1], atol=0.12)


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Of 21,000 labelled rows none is left out: a word that only the last 50 by hash of the id have is learned."""
    last = {r.id for r in spark.range(21_000).orderBy(F.xxhash64("id").desc()).limit(50).collect()}
    toxic = lambda i: i in last or i % 10 == 0
    texts = [(i, f"plain text {'zqlate' if i in last else 'zqusual' if toxic(i) else 'harmless'} it is") for i in range(21_000)]
    model = weak_toxicity.fit(table(spark, texts), labels(spark, [(i, 1, int(toxic(i))) for i in range(21_000)]), F.lit(True))
    assert model.score("so zqlate again") >= 0.5 and model.score("so zqusual again") >= 0.5 and model.score("so harmless again") < 0.5


def test_a_table_of_votes_is_as_good_as_the_rows(spark):
    """Rows with the same votes are counted together in Spark: label model and classifier are those of all rows in memory."""
    draw = random.Random(5)
    lists, known = [], []
    for _ in range(3000):
        y = int(draw.random() < 0.3)
        own = {v for v in range(6) if draw.random() < (0.5 if y else 0.05)}
        lists.append(sorted(own | {6 for v in own if v == 0 and draw.random() < 0.9}))
        known.append(y)
    votes = weak_toxicity.Votes.of(lists, 7)._replace(known=np.array(known, float))
    counted = [(list(v), y, n) for (v, y), n in Counter((tuple(v), y) for v, y in zip(lists, known, strict=True)).items()]
    seen = weak_toxicity.VotesTable(spark.createDataFrame(counted, "votes array<int>, label int, n long").repartition(3), 7)
    want, got = weak_toxicity._label_model(votes, 15), weak_toxicity._label_model(seen, 15)
    assert (want[0].parent == got[0].parent).all() and {want[0].parent[0], want[0].parent[6]} & {0, 6}
    assert all(np.allclose(a, b) for a, b in ((want[0].weight, got[0].weight), (want[1], got[1]), (want[2], got[2])))
    weights = weak_toxicity.linear(votes, want[0], want[2])
    assert np.allclose(weights, weak_toxicity.linear(seen, got[0], got[2]), atol=1e-4)
    slope = weak_toxicity._loss(votes, weights, want[0])[1:] + 0.3 * np.append(weights[:-1], 0)
    assert np.abs(slope).max() < 0.01


def test_quality_weights_are_those_of_the_pairs(spark):
    """The gradient of the penalised loss over the same pairs, summed plainly, is zero; scores follow from the weights."""
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["one", "Two", "three!", "4", "five,"]) for _ in range(draw.randint(1, 40))) + (" #$!" * draw.randint(0, 3) if i % 3 == 0 else "")) for i in range(120)]
    docs, known = table(spark, rows), labels(spark, [(i, int(i % 3 != 0), 0) for i, _ in rows])
    model = pairwise_quality.fit(docs, known, F.lit(True), pairs_each=2)
    x = np.array([pairwise_quality.features(t) for _, t in rows], float)
    y = np.array([int(i % 3 != 0) for i, _ in rows])
    order = np.lexsort((*x.T, y))
    z, y = np.clip((x[order] - model.mean) / model.spread, -6, 6), y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draws, size = np.random.default_rng(7), 2 * max(len(good), len(bad))
    left, right = (draws.permutation(np.resize(side, size)) for side in (good, bad))
    gradient = -model.weights
    for g, b in zip(left, right, strict=True):
        d = z[g] - z[b]
        gradient = gradient + d / (1 + math.exp(float(d @ model.weights)))
    assert np.abs(gradient).max() < 1e-3
    odd = table(spark, [(None, rows[0][1]), (None, None), (5, ""), (5, rows[1][1]), (5, "word " * 60_000)])
    texts = {(r.doc_id, round(r.score, 9)) for r in pairwise_quality.score(odd, model).collect()}
    want = set()
    for i, t in [(None, rows[0][1]), (None, ""), (5, ""), (5, rows[1][1]), (5, "word " * 60_000)]:
        raw = float(np.clip((np.array(pairwise_quality.features(t), float) - model.mean) / model.spread, -6, 6) @ model.weights)
        want.add((i, round(1 / (1 + math.exp(-min(35, max(-35, model.slope * (raw - model.threshold))))), 9)))
    assert texts == want


def plain_counts(text):
    """The n-grams of a text by plain loops: words of letters between marks, one to three in a row."""
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""]
    marks = [0]
    for c in [*low, 0]:
        if c or marks[-1]:
            marks.append(c)
    if len(marks) < 3:
        return Counter()
    u = 2**32
    out = Counter()
    for k, c in enumerate(marks):
        one = c * 2654435761 % u
        if c:
            out[(one >> 9) % centroid_language.SIZE] += 1
        if k + 1 < len(marks):
            two = (one ^ marks[k + 1] * 2246822519 % u) * 3266489917 % u
            out[(two >> 9) % centroid_language.SIZE] += 1
            if k + 2 < len(marks) and marks[k + 1]:
                three = (two ^ marks[k + 2] * 668265263 % u) * 374761393 % u
                out[(three >> 9) % centroid_language.SIZE] += 1
    return out


def test_languages_by_plain_cosines(spark):
    draw = random.Random(3)
    kinds = {f"l{k:02d}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäöüéè") for _ in range(5)) for _ in range(6)] for k in range(70)}
    rows = [(k, " ".join(draw.choice(words) for _ in range(15)), lang) for k, (lang, words) in enumerate(list(kinds.items()) * 6)]
    odd = [(None, rows[0][1], "l00"), (None, rows[0][1], "l00"), (3, None, "l01"), (3, "123 !!", None), (4, chr(0x32100) * 4, None), (5, "x" * 100_000, None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    model = centroid_language.fit(docs, F.col("doc_id").isNull() | (F.col("doc_id") % 6 != 1), each=4, clusters=2)
    assert model.languages == sorted(kinds)  # more than 64
    idf = model.idf
    got = {}
    for r in centroid_language.predict(docs, model).collect():
        got.setdefault((r.doc_id, round(r.score, 5)), set()).add(r.lang_pred)
    for i, text, _ in [*rows[:100], *odd]:
        found = plain_counts(text)
        v = {g: math.log1p(n) * idf[g] for g, n in found.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if not norm:
            assert "und" in got[i, 0.0]
            continue
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosines))
        assert any(abs(s - min(1, max(0, cosines[best]))) < 2e-5 and model.languages[model.language_of[best]] in langs for (d, s), langs in got.items() if d == i)
    held = [(i, lang) for i, _, lang in rows if i % 6 == 1]
    by = {d: langs for (d, _), langs in got.items()}
    assert sum(lang in by[i] for i, lang in held) >= 0.95 * len(held)
    assert centroid_language.predict(docs.limit(0), model).count() == 0
