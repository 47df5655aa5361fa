"""Byte-pair encoding and decoding of whole texts.

Each piece is a doubly linked list of symbols; a priority queue holds the possible merges by
rank (ties: the leftmost).  An entry whose symbols have changed since it was pushed is stale and
skipped when popped.  Decoding puts the vocabulary's strings together.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .chunks import Memo, words
from .common import id_and_text

_POSITION = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(others)) for b in range(256)]


class WordBpe:
    """The BPE of a tokenizer file: lower-cased words, byte-level letters, an end-of-word suffix."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, vocab = data["model"], data["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pattern)
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.rank, self.merged = {}, []
        for left, right in model["merges"]:
            self.rank[vocab[left] << 20 | vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols of one piece after all merges."""
        rank_of, n = self.rank.get, len(symbols)
        queue = []
        for i in range(n - 1):
            if (rank := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None:
                queue.append(rank << 32 | i)
        if not queue:
            return symbols
        heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            top = heappop(queue)
            i, rank = top & _POSITION, top >> 32
            if symbols[i] < 0 or (j := after[i]) < 0 or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue  # stale
            symbols[i], symbols[j] = self.merged[rank], -1
            after[i] = j = after[j]
            if j >= 0:
                before[j] = i
                if (rank := rank_of(symbols[i] << 20 | symbols[j])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] << 20 | symbols[i])) is not None:
                heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str, ids: list[int]) -> None:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))  # letter by letter: no final sigma
        inner, final = self.inner, self.final
        for piece in self.piece.findall(text):
            raw = piece.encode()
            symbols = [inner[b] for b in raw]
            symbols[-1] = final[raw[-1]]
            ids += self.merge(symbols)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.at_special is None or "<" not in text:
            self._plain(text, ids)
            return ids
        for k, part in enumerate(self.at_special.split(text)):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                self._plain(part, ids)
        return ids

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        """The vocabulary's strings, put together with a space between, as a tokenizer without a decoder does."""
        left_out = set(self.special.values()) if skip_special_tokens else ()
        return " ".join(self.strings[i] for i in ids if i in self.strings and i not in left_out)


_READY: dict[str, tuple[WordBpe, Memo]] = {}


def _worker(version: str, spec: Broadcast) -> tuple[WordBpe, Memo]:
    if version not in _READY:
        _READY.clear()
        bpe = WordBpe(spec.value)

        def encode_all(chunks: list[str]) -> list[tuple[int, str, str]]:
            coded = map(bpe.encode, chunks)
            return [(len(ids), " ".join(map(str, ids)), bpe.decode(ids)) for ids in coded]

        _READY[version] = bpe, Memo(encode_all)
    return _READY[version]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:  # a parameter of the driver; workers get it broadcast
        return file.read()


def encode_table(docs: DataFrame, tokenizer: str, *, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per row of ``docs``, in any order, nothing shuffled.

    ``tokenizer`` is the path of a word-level BPE file (about 2 MB; it is broadcast).  Gives
    doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids (array) and
    decoded (text).  Null text counts as empty and has no ids; an empty table gives no rows;
    null ids and repeated rows pass through; other columns are ignored.
    """
    content = read_spec(tokenizer)
    version, spec = hashlib.sha256(content.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(content)
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches):
        _, memo = _worker(version, spec)
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                coded = [c for c in memo(words(text)) if c[0]]
                ids, decoded = " ".join([c[1] for c in coded]), " ".join([c[2] for c in coded])
                row = (sum([c[0] for c in coded]), sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest())
                rows.append((*row, list(map(int, ids.split())), decoded) if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [()] * (5 if with_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names[: len(arrays)]])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
