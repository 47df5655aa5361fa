"""Token ids in a compressed file format: a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, is shared by all blocks.  A block
holds the ids of consecutive documents and is decoded by itself.  Inside, ``LANES`` coder states
take turns (id k goes to lane k mod LANES), so numpy works on all lanes at once; every
``STRIDE`` turns the states and the place in the stream are stored as a checkpoint with a
checksum of the ids up to the next, so that parts of a block can be decoded in parallel too.

Block layout, little-endian: magic ``RNS1``; u32 lanes, stride, documents, checkpoints; u64 ids,
words; u32 checksum of the frequency table; then per document i64 doc_id and u32 length, per
checkpoint u32 word offset and u32 crc32 of its ids, per checkpoint and lane u64 state; u32
words of the stream; u32 crc32 of all before.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .chunks import Chunks, kind_of
from .common import fresh_path, id_and_text, stage

LANES, STRIDE, BITS = 1024, 256, 20
BLOCK_IDS = 1 << 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s4I2QI")


class Table:
    """Frequencies scaled to sum to 2**BITS; every symbol counted at least once keeps at least one part."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        total, size = counts.sum(), 1 << BITS
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / max(total, 1)))), 0).astype(np.int64)
        if (counts > 0).sum() > size:
            raise ValueError("more symbols than parts")
        while (excess := int(freq.sum()) - size) and total:
            order = np.argsort(-freq, kind="stable")
            if excess < 0:
                freq[order[0]] -= excess
            else:
                take = np.minimum(freq[order] - 1, -(-excess // max(1, int((freq > 1).sum()))))
                take = np.where(np.cumsum(take) - take < excess, np.minimum(take, np.maximum(0, excess - (np.cumsum(take) - take))), 0)
                freq[order] -= np.maximum(take, 0)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.check = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray, table: Table) -> bytes:
    n, turns = len(ids), -(-len(ids) // LANES)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id that the frequency table has not")
    x, out, at, emitted = np.full(LANES, _LOW, np.uint64), [], [], 0
    limit, shift, low32 = np.uint64(63 - BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    bits = np.uint64(BITS)
    for turn in range(turns - 1, -1, -1):
        a = turn * LANES
        f, c = freq[a : a + LANES], start[a : a + LANES]
        y = x[: len(f)]
        full = y >= f << limit
        if full.any():
            out.append((y[full] & low32).astype("<u4"))
            emitted += len(out[-1])
            y = np.where(full, y >> shift, y)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + c
        if turn % STRIDE == 0:
            at.append((emitted, x.copy()))
    at.reverse()
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    raw = ids.astype("<u4")
    span = LANES * STRIDE
    places = np.array([[emitted - e, zlib.crc32(raw[k * span : (k + 1) * span].tobytes())] for k, (e, _) in enumerate(at)], "<u4")
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("n", "<u4")])
    docs["id"], docs["n"] = doc_ids, lengths
    body = b"".join((
        _HEAD.pack(b"RNS1", LANES, STRIDE, len(doc_ids), len(at), n, len(stream), table.check),
        docs.tobytes(), places.tobytes(), *(s.astype("<u8").tobytes() for _, s in at), stream.tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block as read; checks its checksum and that it belongs to ``table``."""

    def __init__(self, data: bytes, table: Table):
        if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("corrupt block: checksum")
        magic, self.lanes, self.stride, docs, marks, self.n, size, check = _HEAD.unpack_from(data)
        if magic != b"RNS1" or check != table.check:
            raise ValueError("no block of this table")
        at = _HEAD.size
        self.table = table
        self.docs = np.frombuffer(data, [("id", "<i8"), ("n", "<u4")], docs, at)
        at += self.docs.nbytes
        self.places = np.frombuffer(data, "<u4", 2 * marks, at).reshape(-1, 2)
        at += self.places.nbytes
        self.states = np.frombuffer(data, "<u8", marks * self.lanes, at).reshape(-1, self.lanes)
        at += self.states.nbytes
        self.stream = np.frombuffer(data, "<u4", size, at)

    @property
    def parts(self) -> int:
        return len(self.places)

    def decode(self, part: int) -> np.ndarray:
        """The ids from one checkpoint to the next, without those before."""
        span = self.lanes * self.stride
        n = min(span, self.n - part * span)
        out, x, at = np.empty(n, np.uint32), self.states[part].astype(np.uint64), int(self.places[part, 0])
        freq, start, symbols, stream = self.table.freq, self.table.start, self.table.symbols, self.stream
        bits, mask, shift = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(32)
        for a in range(0, n, self.lanes):
            y = x[: min(self.lanes, n - a)]
            slot = y & mask
            s = symbols[slot]
            out[a : a + len(y)] = s
            y = freq[s] * (y >> bits) + slot - start[s]
            need = np.flatnonzero(y < _LOW)
            if len(need):
                y[need] = (y[need] << shift) | stream[at : at + len(need)]
                at += len(need)
            x[: len(y)] = y
        if zlib.crc32(out.astype("<u4").tobytes()) != self.places[part, 1]:
            raise ValueError(f"corrupt part {part}: checksum")
        return out

    def texts(self) -> Iterator[tuple[int, np.ndarray]]:
        """doc_id and ids of each document; holds a part and one document at a time."""
        rest, part = np.zeros(0, np.uint32), 0
        for doc, n in self.docs:
            pieces, have = [rest], len(rest)
            while have < n:
                pieces.append(self.decode(part))
                have += len(pieces[-1])
                part += 1
            ids = np.concatenate(pieces)
            rest = ids[n:]
            yield int(doc), ids[:n]


_READY: dict[str, object] = {}


def _encoder(version: str, spec, kind: str):
    """Text -> its ids as bytes, made once for a worker.

    Words that are not remembered go to the library's model, in its byte letters; what the
    patterns of chunks.py do not cover goes to the library as it is.
    """
    if version not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model, letters = tokenizer.model, str.maketrans(dict(enumerate(byte_letters())))

        def encode(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

        def encode_all(pieces: list[str]) -> list[bytes]:
            lettered = [p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in pieces]
            return [array("H", [t.id for t in model.tokenize(p)]).tobytes() for p in lettered]

        memo = Chunks(encode_all, encode, b"".join)
        _READY.clear()
        _READY[version] = (lambda text: b"".join(memo(text))) if kind == "word" else encode
    return _READY[version]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian u16), of every whole text, ``end_id`` last; for vocabularies below 65,536."""
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    version, spec = hashlib.sha256(content.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(content)
    end, kind = struct.pack("<H", end_id), kind_of(tokenizer, content.encode())

    def run(batches):
        encode = _encoder(version, spec, kind)
        for batch in batches:
            ids = [encode(t) + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents: at most ``vocabulary`` numbers come to the driver."""

    def run(batches):
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = b"".join(batch.column("ids").to_pylist())  # counted together: a bincount has the vocabulary's length
            seen += np.bincount(np.frombuffer(ids, "<u2"), minlength=vocabulary)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for k, n in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[k] = n
    return counts


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int, vocabulary: int = 65536) -> None:
    """Write the ids of all documents, in ascending doc_id order, as blocks under ``path``.

    ``path/blocks`` has rows (part, block, n_ids, payload) and ``path/table`` the shared counts
    (id, n).  Parts are consecutive ranges of doc_id.  Null text counts as empty and has only
    the end id; null doc_ids count as the smallest long and come first; repeated rows are all
    written, rows of one id in the order of a hash of their ids; a very long text is one document
    of one block, which then is as long; an empty table gives no block; other columns are ignored.
    """
    tokens = stage(tokenize(docs, tokenizer, end_id).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "ids"), "token-ids")
    counts = frequencies(tokens, vocabulary)
    spark = docs.sparkSession
    at = np.flatnonzero(counts)
    spark.createDataFrame([(int(k), int(counts[k])) for k in at], "id long, n long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        table, docs_in, lengths, held, n, part, block = Table(shared.value), [], [], [], 0, None, 0

        def done():
            payload = encode_block(docs_in, lengths, np.concatenate(held), table)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "n_ids", "payload"])

        for batch in batches:
            for doc, ids, p in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("part").to_pylist(), strict=True):
                ids, part = np.frombuffer(ids.as_buffer(), "<u2"), p
                docs_in.append(doc)
                lengths.append(len(ids))
                held.append(ids)
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield done()
                    docs_in, lengths, held, n, block = [], [], [], 0, block + 1
        if docs_in:
            yield done()

    # many rows without an id, or with the same one, are told apart by a hash and fill several ranges
    keyed = tokens.withColumn("tie", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(run, "part int, block int, n_ids long, payload binary").write.parquet(f"{path}/blocks")


def read(spark, path: str, vocabulary: int = 65536) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files alone.

    The blocks' sizes are summed in order by Spark; only the running sums of parts (a number for
    each written file) are windowed as one, blocks within their part.
    """
    counts = np.zeros(vocabulary, np.int64)
    for k, n in spark.read.parquet(f"{path}/table").collect():
        counts[k] = n
    shared = spark.sparkContext.broadcast(counts)
    blocks = spark.read.schema("part int, block int, n_ids long, payload binary").parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()  # a row for each written range
    before, base = 0, {}
    for part, n, _ in sorted(parts):
        base[part], before = before, before + n
    inner = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "block", "inner")

    def run(batches):
        table = Table(shared.value)
        for batch in batches:
            for part, payload, inside in zip(batch.column("part").to_pylist(), batch.column("payload"), batch.column("inner").to_pylist(), strict=True):
                at, rows = base[part] + inside, []
                for doc, ids in Block(payload.as_buffer().to_pybytes(), table).texts():
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    few = sum(p["blocks"] for p in parts) <= 100_000  # 2 MB; beyond that a shuffled join
    found = blocks.join(F.broadcast(inner) if few else inner, ["part", "block"])
    out = found.select("part", "inner", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int) -> DataFrame:
    """Write all documents' ids to fresh files in the shared folder and read those back."""
    path = fresh_path(docs.sparkSession, "rans")
    write(docs, tokenizer, path, end_id=end_id)
    return read(docs.sparkSession, path)
