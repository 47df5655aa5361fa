"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once by numpy.

Words are what stands between ASCII white space, A-Z lower-cased.  A word's hash is a
polynomial in its bytes' random values, taken from prefix sums over all bytes of a chunk of
texts, so no word is looked up or remembered: a worker's memory is bounded by the chunk (or by
the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: What each byte counts as: white space (0x20, 0x09-0x0D) becomes 0x20, A-Z become a-z.
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=5) | 1 for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_A, _B = np.uint64(_BASE), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18  # bytes of text that are hashed together
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 .. n - 1 modulo 2**64, and their inverses."""
    size = len(_POWERS.get("up", ()))
    if size < n or size > n + 8 * _CHUNK:  # what one very long text needed is not kept for ever
        n = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ``data`` (UTF-8) and the place where it begins."""
    raw = np.frombuffer(data.translate(_FOLD), np.uint8)
    up, down = _powers(len(raw) + 1)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw != 32
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _B
    h ^= h >> np.uint64(32)
    return h * _A, begin


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = (x * _A) ^ h[i : i + n]
        x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _sets(h: np.ndarray, counts: list[int], k: int) -> Iterator[np.ndarray]:
    """The set of each of the consecutive texts of so many words."""
    all_runs = runs(h, k) if len(h) >= k else h[:0]
    at = 0
    for n in counts:
        yield _distinct(all_runs[at : at + n - k + 1].copy() if n >= k else runs(h[at : at + n], n) if n else h[:0].copy())
        at += n


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For each whole text its distinct shingles of k words (the whole sequence if there are fewer), sorted; empty without a word."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > _CHUNK:
            yield from _of(held, k)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from _of(held, k)


def _of(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    h, begin = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    yield from _sets(h, counts.tolist(), k)
