"""Edge cases of the text operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import bpe, centroid_language, chunks, exact_dedup, latent_leaks, pairwise_quality, rans_tokens, token_counts, weak_toxicity
from factloom.llm.common import fresh_path, id_and_text

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "Hello world, it's 2024!", "", None, "Hello world, it's 2024!", "a" * 5000 + " tail", "  two  spaces \n\n and\ttabs ", "Ünïcödé ÇA Straße",
    "special <|endoftext|> inside", "數學 한국어 \U0001f600", "x\x1cy\x85z", "ΣΑΣ İ", "Hello world, it's 2024!", "only-one",
]
DDL = "doc_id long, text string, digest string, n_tokens string, h int, salt int, hot string, ids string, score string, mark int, node int"


def table(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "d", "n", 1, 2, "hot", "i", "s", 3, 4) for i, t in zip(ids, texts)], DDL)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def test_pieces_give_the_library_ids(word, byte):
    draw = random.Random(2)
    pool = [*"aeéßçñÉ ΣİK'!#$%0123²½456789\t\n\r\x0b\x1c\x1d\x85\xa0", " ", "́", "한", "中", "<|", "|>", "<|endoftext|>", "'s", "'ll", "the", "  ", "ING"]
    own = bpe.WordBpe(bpe.read_spec(WORD))
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        ids = word.encode(text, add_special_tokens=False).ids
        assert [i for c in chunks.words(text) for i in own.encode(c)] == ids == own.encode(text)
        assert own.decode(ids) == word.decode(ids, skip_special_tokens=False)
        assert [i for c in chunks.words(text) for i in word.encode(c, add_special_tokens=False).ids] == ids
        assert sum(len(byte.encode(c, add_special_tokens=False).ids) for c in chunks.spaced(text)) == len(byte.encode(text, add_special_tokens=False).ids)


def test_chunks_give_the_library_ids(word):
    draw = random.Random(5)
    pool = [*"aeéßç'#$%012²\t\n\x85\xa0", " ", " ", "한", "<|endoftext|>", "the", "ING", "x" * 60]
    ids = lambda t: word.encode(t, add_special_tokens=False).ids
    memo = chunks.Chunks(lambda pieces: list(map(ids, pieces)), ids, lambda parts: [i for p in parts for i in p], most=50)
    for _ in range(1500):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 20)))
        assert [i for p in memo(text) for i in p] == ids(text)


def test_memo_forgets_and_still_answers():
    memo = chunks.Memo(lambda found: [c.upper() for c in found], most=3, longest=4)
    for k in range(20):
        words = [f"w{k}", f"w{k + 1}", "a", "long-one"]
        assert memo(words) == [w.upper() for w in words]
        assert "long-one" not in memo.known and len(memo.known) <= 3 + 4


def test_token_counts(spark, byte):
    cache = fresh_path(spark, "t-cache")
    docs = table(spark, ids=[None, *range(1, len(TEXTS))])
    for _ in range(2):  # the second time all counts are stored
        got = sorted(token_counts.count_tokens(docs, BYTE, cache, limit=5).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        assert len(got) == len(TEXTS)
        for row, text in zip(got, TEXTS, strict=True):
            n = len(byte.encode(text or "", add_special_tokens=False).ids)
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 5)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})  # each distinct text once
    assert token_counts.count_tokens(table(spark, []), BYTE, cache).count() == 0


def test_repeated_rows_are_encoded_once(spark):
    cache = fresh_path(spark, "t-cache")
    docs = table(spark, ["one text", "another"] * 50, [None] * 50 + [7] * 50)
    assert token_counts.count_tokens(docs, BYTE, cache).count() == 100
    assert spark.read.parquet(cache).count() == 2


def test_other_added_tokens_are_not_cut(spark, tmp_path):
    other = Tokenizer.from_file(BYTE)
    other.add_special_tokens(["[IN ST]"])
    other.save(str(tmp_path / "other.json"))
    texts = ["a [IN ST] b", "plain text"]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, texts), str(tmp_path / "other.json"), fresh_path(spark, "c")).collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_of_other_kinds(spark, word):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", "", "Straße  x"]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, texts), path, fresh_path(spark, "c")).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark), WORD, fresh_path(spark, "c")).collect()}
    assert got == {i: len(word.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_bpe_table(spark, word):
    got = {r.doc_id: r for r in bpe.encode_table(table(spark), WORD, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = word.encode(text or "", add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        row = got[i]
        assert (row.ids, row.n_tokens, row.decoded) == (ids, len(ids), decoded)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_table(table(spark, []), WORD).count() == 0


def test_rans_files(spark, word):
    ids = [7, 3, 3, 11, None, 40, 41, 42, 43, 44, 45, 46, 100]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans_tokens.round_trip(table(spark, ids=ids), WORD, end_id=2).collect())
    at, seen = 0, []
    for start, doc, n, crc in got:
        assert start == at
        at += n
        seen.append((doc, n, crc))
    order = [d for d, _, _ in seen]
    assert order == [None, *sorted(i for i in ids if i is not None)]
    coded = [[*word.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    assert sorted(map(str, seen)) == sorted(str((i, len(c), zlib.crc32(np.array(c, "<u4").tobytes()))) for i, c in zip(ids, coded))
    assert rans_tokens.round_trip(table(spark, []), WORD, end_id=2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 270_001])
def test_rans_block(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 40_000).astype(np.uint16)
    counts = np.bincount(ids, minlength=65536)
    one = rans_tokens.Table(counts)
    lengths = [n // 3, n - n // 3]
    data = rans_tokens.encode_block([5, -6], lengths, ids, one)
    block = rans_tokens.Block(data, one)
    back = list(block.texts())
    assert [d for d, _ in back] == [5, -6] and np.array_equal(np.concatenate([x for _, x in back]), ids)
    if block.parts > 1:  # a later part alone
        assert np.array_equal(block.decode(1), ids[rans_tokens.LANES * rans_tokens.STRIDE :])
        assert len(data) < 2 * n
    for spoilt in (data[:-5], data[:60] + bytes([data[60] ^ 1]) + data[61:]):
        with pytest.raises(ValueError):
            rans_tokens.Block(spoilt, one)


def test_rans_table_with_many_rare_symbols():
    counts = np.zeros(65536, np.int64)
    counts[:60_000] = 1
    counts[0] = 10**12
    one = rans_tokens.Table(counts)
    assert int(one.freq.sum()) == 1 << rans_tokens.BITS and one.freq[:60_000].all() and not one.freq[60_000:].any()
    ids = np.arange(60_000).astype(np.uint16)
    assert np.array_equal(next(rans_tokens.Block(rans_tokens.encode_block([1], [60_000], ids, one), one).texts())[1], ids)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    texts = ["same"] * 300 + ["", None, "other", "Other", "x" * 20_000, "x" * 20_000, "lone"] + ["same"] * 10
    ids = [*range(300), 300, 301, 302, 303, 304, 305, None, *range(10)]  # repeated rows, a null id
    got = exact_dedup.exact_dedup(table(spark, texts, ids), keep=keep, salts=8, least_hot=100).collect()
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(t or "", []).append(i)
    best = max if keep == "largest" else min
    want = sorted(str((i, best([x for x in g if x is not None], default=None), len(g), hashlib.sha256(t.encode()).hexdigest())) for t, g in groups.items() for i in g)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_common_subsequence():
    draw = random.Random(4)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert latent_leaks.common_subsequence(a, b) == best[-1][-1]


def test_latent_leaks_find_paraphrases(spark):
    draw = random.Random(9)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, say(draw.randint(15, 60))) for k in range(30)]
    texts, want = [None, "", say(20_000)], set()
    for k, item in items:
        words = item.split()
        for j in range(0, len(words), 8):
            words[j] = draw.choice(vocabulary)
        texts += [say(200) + " " + item.upper() + ". " + say(100), say(50) + "\n" + " ".join(words), say(300), " ".join(words[: len(words) // 3]) + " " + say(30)]
        want |= {(len(texts) - 4, k), (len(texts) - 3, k)}
    bench = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "..."), items[0]], "item_id long, text string")
    got = latent_leaks.find_leaks(table(spark, texts), bench)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == want
    assert latent_leaks.find_leaks(table(spark, []), bench).count() == 0
    assert latent_leaks.find_leaks(table(spark, texts), bench.limit(0)).count() == 0


def test_latent_leaks_find_long_items(spark):
    """A third of the words changed, in items of up to 1,000 words."""
    draw = random.Random(10)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(20_000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate((20, 60, 100, 150, 200, 300, 400, 500, 700, 1000))]
    texts, want = [" ".join(say(3000)), "short"], set()
    for k, item in items:
        for shift in (0, 7, 150):
            changed = [draw.choice(vocabulary) if j % 3 == 1 else w for j, w in enumerate(item)]
            want.add((len(texts), k))
            texts += [" ".join(say(shift) + changed + say(100)), " ".join(say(5))]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in latent_leaks.find_leaks(table(spark, texts), bench).collect()} == want


def brute_leaks(texts, items, share=0.6, answer=0.5):
    """All texts that hold an item by the word check, looked for around every word."""
    split = lambda t: latent_leaks.words([t or ""])[0].tolist()
    out = set()
    for d, text in enumerate(texts):
        w = split(text)
        for k, item in items:
            x = split(item)
            last = x[-max(3, len(x) // 4) :]
            for a in range(max(1, len(w) - len(x) + 1)):
                near = w[max(0, a - len(x)) : a + 2 * len(x)]
                if latent_leaks.common_subsequence(x, near) >= share * len(x) and latent_leaks.common_subsequence(last, near) >= answer * len(last):
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize("clean", [0, 2, 4, 20])
def test_latent_leaks_in_most_documents(spark, clean):
    """An item that most documents hold, and one of stop words only, with 10 to 40 in 100 words changed."""
    draw = random.Random(clean)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    stops = ["the", "of", "and", "to", "in", "it", "is", "be", "not", "or"]
    items = [(1, say(30)), (2, [draw.choice(stops) for _ in range(24)])]
    texts = []
    for changed in (0, 10, 20, 30, 40):
        for _, item in items:
            w = list(item)
            for j in draw.sample(range(len(w)), len(w) * changed // 100):
                w[j] = draw.choice(vocabulary)
            texts.append(" ".join([*say(50), *w, *say(40)]))
    for _ in range(clean):
        texts.append(" ".join(x for w in say(80) for x in (w, draw.choice(stops))))
    bench = [(k, " ".join(w)) for k, w in items]
    planted = {(d, 1 + d % 2) for d in range(10)}
    want = brute_leaks(texts, bench) & planted  # the words of an answer may all be changed
    assert len(want) >= 8
    got = {(r.doc_id, r.item_id) for r in latent_leaks.find_leaks(table(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(d, k) for d, k in got if k == 1} <= planted  # stop words in order may be found in any text full of them


def test_leaks_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (1, "quite other words for the very same item"), (None, "x y z"), (2, None), (3, "..."), (4, "one")], "item_id long, text string")
    hit = "and alpha beta gamma delta epsilon zeta eta end"
    docs = table(spark, [hit, hit, "quite other words for the very same item", None, "", "z " * 100_000 + hit, "clean words only here"], [5, 5, None, None, 5, 9, 5])
    got = sorted((str(r.doc_id), r.item_id) for r in latent_leaks.find_leaks(docs, bench).collect())
    assert got == [("5", 1), ("5", 1), ("9", 1), ("None", 1)]
    left = latent_leaks.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.text) for r in left.collect()) == ["", "None", "clean words only here"]
    assert latent_leaks.find_leaks(table(spark, []), bench).count() == 0
    assert latent_leaks.find_leaks(docs, bench.where("item_id > 9")).count() == 0
    assert latent_leaks.without_leaks(docs, bench.where("item_id > 9")).count() == 7


def test_latent_leaks_of_a_full_block(spark):
    """512 items and a rank of 320, so the space of the items is cut."""
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, say(draw.randint(15, 60))) for k in range(512)]
    texts, want = [], set()
    for k, item in items:
        changed = [draw.choice(vocabulary) if j % 5 == 1 else w for j, w in enumerate(item)]
        want.add((len(texts), k))
        texts += [" ".join(say(draw.randrange(80)) + changed + say(60)), " ".join(say(100))]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in latent_leaks.find_leaks(table(spark, texts), bench).collect()}
    print("recall", len(found & want) / len(want), "others", len(found - want))
    assert len(found & want) >= 0.98 * len(want) and found <= want


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t) for i, q, t in rows], "doc_id long, quality int, toxic int")


def test_classifiers_without_labels(spark):
    from pyspark.sql import functions as F

    docs, none = table(spark), labels(spark, [(1, None, None), (None, 1, 1)])
    got = pairwise_quality.score(docs, pairwise_quality.fit(docs, none, F.lit(True))).collect()
    assert {r.score for r in got} == {0.5} and len(got) == len(TEXTS)
    got = weak_toxicity.score(docs.union(table(spark, ["you pathetic idiot"], [77])), weak_toxicity.fit(docs, none, F.lit(True), always=("idiot",))).collect()
    assert {r.doc_id for r in got if r.predicted} == {77}
    model = centroid_language.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"), F.lit(True))
    assert {(r.lang_pred, r.score, r.rejected) for r in centroid_language.predict(docs, model).collect()} == {("und", 0.0, True)}
    for f, m in ((pairwise_quality, pairwise_quality.fit(docs, none, F.lit(True))), (centroid_language, model)):
        assert (f.score if f is pairwise_quality else f.predict)(table(spark, []), m).count() == 0


def test_classifiers_learn(spark):
    from pyspark.sql import functions as F

    draw = random.Random(3)
    words = ["the", "small", "green", "river", "runs", "over", "stones"]
    texts, rows = [], []
    for i in range(240):
        w = [draw.choice(words) for _ in range(30)]
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            w[3:3] = ["zorkish" + draw.choice(["", "en", "ly"]), "idiot"][: 1 + i % 2]
        texts.append(" ".join(w))
        rows.append((i, int(not bad), int(rude)))
    docs, known = table(spark, texts), labels(spark, rows + rows[:3])
    learn, held = F.col("doc_id") % 3 != 0, [r for r in rows if r[0] % 3 == 0]
    got = {r.doc_id: r.predicted for r in pairwise_quality.score(docs, pairwise_quality.fit(docs, known, learn)).collect()}
    assert all(got[i] == q for i, q, _ in held)
    got = {r.doc_id: r.predicted for r in weak_toxicity.score(docs, weak_toxicity.fit(docs, known, learn)).collect()}
    assert sum(got[i] == t for i, _, t in held) >= 0.95 * len(held)


def test_languages(spark):
    from pyspark.sql import functions as F

    draw = random.Random(3)
    kinds = {"xa": ["loma", "kira", "mola", "rika"], "yb": ["stürn", "gröft", "klüsch", "stumpf"]}
    rows = [(i, " ".join(draw.choice(kinds[lang]) for _ in range(12)), lang) for i, lang in enumerate(["xa", "yb"] * 40)]
    docs = spark.createDataFrame([*rows, (500, None, "xa"), (501, "123 !!", None), (502, "кот собака", None)], "doc_id long, text string, lang string")
    model = centroid_language.fit(docs, F.col("doc_id") % 2 == F.floor(F.col("doc_id") / 2) % 2, each=20, clusters=2)
    got = {r.doc_id: r for r in centroid_language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and not 0.5 > got[i].score for i, _, lang in rows)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].rejected


def test_latent_space_is_of_all_documents(spark):
    """Each of 1,500 documents has one term of its own, so each must have left its mark in the sketch, however rows are dealt."""
    texts = [" ".join(f"own{k}" if j == k % 100 else f"x{k}y{j}" for j in range(100)) for k in range(1500)] + [None, ""]
    items = [(i, " ".join(f"own{k}" for k in range(30 * i, 30 * i + 30))) for i in range(50)]
    terms = np.unique(latent_leaks.words([t for _, t in items])[0])
    found = [latent_leaks.scan(id_and_text(table(spark, texts)).repartition(n), terms) for n in (2, 7)]
    for counts, sketch in found:
        assert counts.n == 1502 and sketch.passages == 1500 and (np.abs(sketch.sums).sum(0) == 1).all()
        assert len(np.flatnonzero(sketch.sums.any(1))) > 400  # 1,500 passages over 512 sums
    assert (found[0][1].sums == found[1][1].sums).all() and (found[0][0].seen == found[1][0].seen).all()
    again, later = latent_leaks.scan(id_and_text(table(spark, texts)), terms[:9], found[0][0])
    assert again is found[0][0] and later.sums.shape == (512, 9) and (np.abs(later.sums).sum(0) == 1).all()


def test_directions_are_leading_singular_vectors():
    rows = np.random.default_rng(3).standard_normal((40, 90)).astype(np.float32) * np.float32(0.8) ** np.arange(90, dtype=np.float32)
    got, (_, s, want) = latent_leaks._directions(rows, 12), np.linalg.svd(rows.astype(np.float64))
    assert got.shape == (90, 12) and np.allclose(np.linalg.norm(rows @ got, axis=0), s[:12], rtol=1e-3) and np.allclose(np.abs(np.sum(got * want[:12].T, axis=0)), 1, atol=1e-2)
