"""Benchmark passages in documents, by latent semantic retrieval.

Document passages and benchmark items are TF-IDF vectors.  A randomised singular value
decomposition gives a latent space of the terms: every passage of every document goes, with a
random sign, into one of some hundred sums that Spark's tasks add up (the sketch), and the sums
and the items are decomposed.  Windows of each document are compared with all items by cosine
there.  Candidates are checked word by word: the
longest common subsequence of item and surroundings, over the item and over its last part (the
answer).  So passages with some words changed, left out or put in are found too.

No term is left out, however common.  A cosine says little about an item whose words are all
much commoner than other words are (stop words only, or a passage that most documents hold):
for those items runs of three of their words give candidates too, before the same check.

Words are letters and digits between white space, lower-cased, as 64-bit hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, id_and_text
from .shingles import runs, word_hashes

_BITS = 20  # of the document frequencies' slots
SLOTS, _ROW = 1 << _BITS, 1 << 10
_ODD_SPACE, _ODD_SIGN = re.compile(r"[^\S\x00-\x7f]"), re.compile(r"[^\w\x00-\x7f]")
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())
_SPACES = bytes(32 if 28 <= b <= 31 else b for b in range(256))
_SPAN, _BUCKETS, _MOST = 32, 512, 1 << 24  # words of a passage; sums of the sketch, and its numbers at most
_RUN = 3  # words that candidates of items of common words have in a row


def _folded(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _ODD_SIGN.sub("", _ODD_SPACE.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_SPACES, _SIGNS)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of whole texts, one after the other, as hashes; and how many each text has."""
    folded = [_folded(t) for t in texts]
    h, begin = word_hashes(b" ".join(folded))
    ends = np.cumsum([len(t) + 1 for t in folded])
    return h, np.diff(np.searchsorted(begin, ends), prepend=0)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _some(texts: list[str], most: int = 250_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` letters."""
    a, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most or k == len(texts) - 1:
            yield a, k + 1
            a, size = k + 1, 0


def _deflate(data: bytes) -> bytes:
    return zlib.compress(data, 1)


_inflate = zlib.decompress


class Model(NamedTuple):
    items: list[tuple[int, np.ndarray]]  # item_id, words
    idf: np.ndarray  # of each slot
    terms: np.ndarray  # the items' words, sorted
    parts: np.ndarray  # of each term in the cosine with each item: idf x latent directions x the item's latent vector
    usual: float  # mean square of idf, over all words of all documents


class _Lookup:
    """Hash -> its row in a sorted table, or -1."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.maybe = terms, np.zeros(SLOTS, bool)
        self.maybe[_slot(terms)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[_slot(h)])
        row = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[row] == h[at]
        out[at[same]] = row[same]
        return out


class Counts(NamedTuple):
    seen: np.ndarray  # in how many documents words of each slot occur
    n: int  # documents
    share: np.ndarray  # of each slot in all words


class Sketch(NamedTuple):
    sums: np.ndarray  # buckets x terms: how often each term occurs in passages, added up with random signs
    passages: int  # that have a term


def _packed(cells: np.ndarray) -> bytes:
    """A row of whole numbers in the smallest type that holds them, deflated; its first byte names the type."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or np.abs(cells).max(initial=0) < 1 << (8 * s - 1))
    return bytes([size]) + _deflate(cells.astype(f"<i{size}").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_inflate(data[1:]), f"<i{data[0]}")


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _add_passages(sums: np.ndarray, find: _Lookup, ids: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> int:
    """Add the passages of documents (words h, sizes of them in each) to a task's sketch; how many have a term.

    Sum and sign of a passage follow from the document's id, the passage's place and its first word.
    """
    at = find(h)
    hit = np.flatnonzero(at >= 0)
    begins, counts = np.cumsum(sizes) - sizes, -(-sizes // _SPAN)
    first = np.cumsum(counts) - counts
    of_passage = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(of_passage)) - first[of_passage]
    key = _mixed(_mixed(ids[of_passage].astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ h[begins[of_passage] + _SPAN * place])
    bucket, sign = ((key >> np.uint64(1)) % np.uint64(len(sums))).astype(np.int64), (key & np.uint64(1)).astype(np.int32) * 2 - 1
    of_hit = np.repeat(np.arange(len(sizes)), sizes)[hit]
    passage = first[of_hit] + (hit - begins[of_hit]) // _SPAN
    np.add.at(sums.reshape(-1), bucket[passage] * sums.shape[1] + at[hit], sign[passage])
    return int(np.count_nonzero(np.bincount(passage, minlength=1)))


def scan(docs: DataFrame, terms: np.ndarray, counts: Counts | None = None) -> tuple[Counts, Sketch]:
    """Counts of words and the sketch of the passages by ``terms`` (sorted), over all whole texts of ``docs`` (doc_id, text).

    Each task adds up 2**20 counters and 2**24 numbers of the sketch at most, and sends rows of
    them.  Counts that are known are not taken again.
    """
    buckets, counting = max(16, min(_BUCKETS, _MOST // len(terms))), counts is None

    def run(batches):
        seen, used, n = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint32), 0
        find, sums, passages = _Lookup(terms), np.zeros((buckets, len(terms)), np.int32), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                texts, ids = batch.column("text").slice(k, 512).to_pylist(), batch.column("doc_id").slice(k, 512).fill_null(-1).to_numpy()
                for a, b in _some(texts):
                    h, sizes = words(texts[a:b])
                    passages += _add_passages(sums, find, ids[a:b], h, sizes)
                    if counting:
                        slot = _slot(h)
                        np.add.at(used, slot, 1)
                        key = np.sort(np.repeat(np.arange(b - a), sizes) << _BITS | slot)
                        own = key[np.diff(key, prepend=-1) != 0] & (SLOTS - 1)
                        np.add.at(seen, own, 1)
                n += len(texts)
        both = np.stack((seen, used)).reshape(2, -1, _ROW)
        for rows, of, base in ((np.flatnonzero(both.any((0, 2))), lambda r: both[:, r].reshape(-1).astype(np.int64), 0), (np.flatnonzero(sums.any(1)), lambda r: sums[r], SLOTS // _ROW)):
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                zeros = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part + base, pa.int32()), pa.array([_packed(of(r)) for r in part], pa.binary()), zeros, zeros], names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([n], pa.int64()), pa.array([passages], pa.int64())], names)

    def added(batches):
        total, n, passages = {}, 0, 0
        for batch in batches:
            for row, cells, k, m in zip(batch.column("row").to_pylist(), batch.column("cells"), batch.column("n").to_pylist(), batch.column("passages").to_pylist(), strict=True):
                n, passages = n + k, passages + m
                if row >= 0:
                    total[row] = total.get(row, 0) + _unpacked(cells.as_buffer().to_pybytes()).astype(np.int64)
        zeros = [0] * len(total)
        columns = [[*total, -1], [*map(_packed, total.values()), b""], [*zeros, n], [*zeros, passages]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)

    names, ddl = ["row", "cells", "n", "passages"], "row int, cells binary, n long, passages long"
    parts = docs.select("doc_id", "text").mapInArrow(run, ddl).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = parts.repartition("row", "part").select(*names).mapInArrow(added, ddl)
    seen, used, n = np.zeros((SLOTS // _ROW, _ROW)), np.zeros((SLOTS // _ROW, _ROW)), 0
    sums, passages = np.zeros((buckets, len(terms)), np.float32), 0
    for row, cells, k, m in once.repartition("row").mapInArrow(added, ddl).collect():  # 8 MB and the sketch at most, whatever the input
        n, passages = n + k, passages + m
        if row >= SLOTS // _ROW:
            sums[row - SLOTS // _ROW] = _unpacked(bytes(cells))
        elif row >= 0:
            seen[row], used[row] = _unpacked(bytes(cells)).reshape(2, _ROW)
    if counting:
        used = used.reshape(-1)
        counts = Counts(seen.reshape(-1), n, used / max(used.sum(), 1))
    return counts, Sketch(sums, passages)


def _directions(rows: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors (columns) of a matrix of not many rows."""
    values, left = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    values, left = values[::-1][:rank], left[:, ::-1][:, :rank]
    some = values > 1e-6 * max(values[0], 1e-30)
    return rows.T @ (left[:, some] / np.sqrt(values[some])).astype(np.float32)


def fit(items: list[tuple[int, str]], counts: Counts, sketch: Sketch, *, rank: int = 320, as_many: int = 1000, item_weight: float = 20.0) -> Model:
    """The latent space for ``items`` (a block of the benchmark); ``sketch`` is by their distinct words.

    All passages of all documents are in the sketch.  Together they count as those of
    ``as_many`` documents would, else many documents would leave no directions for the items,
    which count ``item_weight`` times.  Terms are those of the items.
    """
    h, sizes = words([t for _, t in items])
    known = [(i, w) for (i, _), w in zip(items, np.split(h, np.cumsum(sizes)[:-1]), strict=True)]
    idf = np.log((1 + counts.n) / (1 + counts.seen)) + 0.05
    usual = float((counts.share * idf**2).sum())
    terms = np.unique(h)
    weight = idf[_slot(terms)].astype(np.float32)
    matrix = np.zeros((len(known), len(terms)), np.float32)
    for k, (_, w) in enumerate(known):
        np.add.at(matrix[k], np.searchsorted(terms, w), 1)
    matrix *= weight
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    passages = sketch.sums * weight  # the sum of weighted passages is the weighted sum of passages
    square = sum(float(np.vdot(row, row)) for row in passages)
    passages *= np.float32(np.sqrt(sketch.passages * min(1, as_many / max(counts.n, 1)) / square) if square else 0)
    directions = _directions(np.concatenate((passages, np.float32(item_weight) * matrix)), min(rank, len(terms)))
    latent = matrix @ directions
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Model(known, idf.astype(np.float32), terms, ((weight[:, None] * directions) @ latent.T).astype(np.float32), usual)


def common_subsequence(item: list, others: list) -> int:
    """Length of the longest common subsequence of words, by bits of one integer for the item's words."""
    places: dict = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = state = (1 << len(item)) - 1
    for w in others:
        if m := places.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(item) - state.bit_count()


class Finder:
    """What a worker needs to look through documents."""

    def __init__(self, model: Model, cosine: float, share: float, answer_share: float):
        self.model, self.cosine, self.share, self.answer_share = model, cosine, share, answer_share
        self.row, self.square = _Lookup(model.terms), model.idf**2
        self.items = [w.tolist() for _, w in model.items]
        self.answers = [w[-max(3, len(w) // 4) :] for w in self.items]
        # an item is looked for by windows of about its own size
        self.spans = [16 << max(0, int(np.log2(max(len(w), 12) / 12))) for w in self.items]
        self.kinds = []
        for span in sorted(set(self.spans)):
            which = np.flatnonzero(np.array(self.spans) == span)
            own = np.zeros(len(model.terms), bool)
            own[np.searchsorted(model.terms, np.concatenate([model.items[k][1] for k in which]))] = True
            self.kinds.append((span, which, np.ascontiguousarray(model.parts[:, which]), own))
        # with 4 in 10 words changed, the cosine of such an item need not reach the bound
        poor = [k for k, (_, w) in enumerate(model.items) if len(w) and self.square[_slot(w)].mean() < 0.5 * model.usual]
        found = [(r, k) for k in poor for r in set(runs(model.items[k][1], min(_RUN, len(self.items[k]))).tolist())]
        self.runs = np.array(sorted({r for r, _ in found}), np.uint64)
        self.run_items: dict[int, list[int]] = {}
        for r, k in found:
            self.run_items.setdefault(r, []).append(k)
        self.sizes = sorted({min(_RUN, len(self.items[k])) for k in poor})
        self.run_row = _Lookup(self.runs)

    def candidates(self, h: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """document, item, first place of a window, cosine: of all windows that are near enough to an item.

        ``h`` are the words of documents of ``sizes`` words, one after the other.
        """
        at, squares = self.row(h), self.square[_slot(h)]
        begins = np.cumsum(sizes) - sizes
        of_doc = np.repeat(np.arange(len(sizes)), sizes)
        for span, which, parts, own_terms in self.kinds:
            hit = np.flatnonzero((at >= 0) & own_terms[at])
            if not len(hit):
                continue
            step = span // 2
            own_blocks = -(-sizes // step) + 1  # the last one is empty, so no window has words of two documents
            first_block = np.cumsum(own_blocks) - own_blocks
            count = int(own_blocks.sum())
            block = (np.arange(len(h)) - begins[of_doc]) // step + first_block[of_doc]
            square = np.bincount(block, squares, minlength=count + 1)
            of_hits = np.bincount(block[hit], squares[hit], minlength=count + 1)
            square, of_hits = square[:-1] + square[1:], of_hits[:-1] + of_hits[1:]
            of_hits[first_block + own_blocks - 1] = 0  # these begin after a document's end
            # no cosine is larger than the terms' share of the window's length
            windows = np.flatnonzero((of_hits > 0) & (of_hits >= self.cosine**2 * square))
            for k in range(0, len(windows), 1024):
                part = windows[k : k + 1024]
                needed = np.zeros(count + 1, bool)
                needed[part] = needed[part + 1] = True
                place = np.cumsum(needed) - 1
                own = hit[np.searchsorted(block[hit], part[0]) : np.searchsorted(block[hit], part[-1] + 1, "right")]
                own = own[needed[block[own]]]
                of = place[block[own]]
                first = np.flatnonzero(np.diff(of, prepend=-1) != 0)
                blocks = np.zeros((place[-1] + 1, parts.shape[1]), np.float32)
                blocks[of[first]] = np.add.reduceat(parts[at[own]], first, axis=0)
                near = blocks[place[part]] + blocks[place[part + 1]]
                near /= np.sqrt(square[part])[:, None]
                for i, j in zip(*np.nonzero(near >= self.cosine), strict=True):
                    d = int(np.searchsorted(first_block, part[i], "right")) - 1
                    yield d, int(which[j]), int(part[i] - first_block[d]) * step, float(near[i, j])
        for size in self.sizes:
            if len(h) >= size:
                r = runs(h, size)
                for p in np.flatnonzero(self.run_row(r) >= 0).tolist():
                    d = int(of_doc[p])
                    for k in self.run_items[int(r[p])]:
                        yield d, k, max(0, p - int(begins[d]) - self.spans[k] // 2), 0.0

    def __call__(self, texts: list[str]) -> list[list[tuple[int, float, float, int]]]:
        """item_id, cosine, share of the item's words found in order, first word looked at: of each item found in each whole text."""
        h, sizes = words(texts)
        begins = np.cumsum(sizes) - sizes
        found: list[dict[int, tuple[float, float, int]]] = [{} for _ in texts]
        looked: dict[tuple[int, int], int] = {}
        for d, k, a, cosine in self.candidates(h, sizes):
            span, item = self.spans[k], self.items[k]
            b = a + span
            if looked.get((d, k), -1) >= b:
                continue
            low = max(0, a - len(item))
            near = h[begins[d] + low : begins[d] + min(int(sizes[d]), b + len(item))].tolist()
            looked[d, k] = b + min(len(item), span) // 2  # windows up to there lie within what is looked at now
            share, item_id = common_subsequence(item, near) / len(item), self.model.items[k][0]
            if share >= self.share and common_subsequence(self.answers[k], near) >= self.answer_share * len(self.answers[k]) and share > found[d].get(item_id, (0, 0, 0))[1]:
                found[d][item_id] = (cosine, share, low)
        return [[(i, *rest) for i, rest in sorted(f.items())] for f in found]


def _models(docs: DataFrame, benchmark: DataFrame, block: int, rank: int) -> Iterator[Model]:
    """A model for each block of the benchmark's distinct (item_id, text), which come to the driver block by block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), body("text").alias("text")).where("item_id IS NOT NULL").distinct().orderBy("item_id", "text")
    counts, held = None, []
    for r in chain(items.toLocalIterator(), [None]):
        if r is not None and len(words([r["text"]])[0]):
            held.append((r["item_id"], r["text"]))
        if held and (r is None or len(held) == block):
            counts, sketch = scan(docs, np.unique(words([t for _, t in held])[0]), counts)
            yield fit(held, counts, sketch, rank=rank)
            held = []


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.32, share: float = 0.6, answer_share: float = 0.5, block: int = 512, rank: int = 320) -> DataFrame:
    """doc_id, item_id, cosine, share, at_word: a row for each document and item of which a passage is in it.

    ``share`` is the least part of an item's words that occurs in order near the candidate,
    ``answer_share`` the same for its last quarter.  ``benchmark`` (item_id, text) is the stated
    query set, taken in blocks of ``block`` items, each against all documents (the documents'
    counts are taken once, the sketch for each block).  Items and documents that are null or without a word match nothing;
    repeated documents give their rows each; null ids pass through; of an item_id with several
    texts each is looked for, the best counts; very long texts are read whole; empty tables give
    no rows; other columns are ignored.
    """
    docs = id_and_text(docs)
    ddl, kinds = "doc_id long, item_id long, cosine double, share double, at_word long", (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    out = None
    for model in _models(docs, benchmark, block, rank):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            find = Finder(shared.value, cosine, share, answer_share)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    ids, texts = (batch.column(c).slice(k, 512).to_pylist() for c in ("doc_id", "text"))
                    rows = [(d, *hit) for a, b in _some(texts) for d, hits in zip(ids[a:b], find(texts[a:b]), strict=True) for hit in hits]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "share", "at_word"])

        found = docs.mapInArrow(run, ddl)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, cosine: float = 0.32, share: float = 0.6, answer_share: float = 0.5, block: int = 512, rank: int = 320) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no passage of the benchmark is found; nothing is shuffled.

    Each row is judged by its own text, so ids may be null or repeated.  Null and empty texts stay.
    """
    out = docs  # id_and_text bounds the batches
    for model in _models(id_and_text(docs), benchmark, block, rank):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            find = Finder(shared.value, cosine, share, answer_share)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    keep = [not hits for a, b in _some(texts) for hits in find(texts[a:b])]
                    yield part.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
