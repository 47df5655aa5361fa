"""Encoding whole texts piece by piece, with a memo of pieces already encoded.

A byte-pair tokenizer encodes each piece of its pre-tokenizer by itself, so a worker encodes
each distinct piece once.  Texts with letters beyond Latin Extended-A, or with a tokenizer's
special strings, are cut at white space only, and the tokenizer does the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any

# Fixed value: the word pattern as tokenizer files have it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The pre-tokenizer patterns of the two kinds of byte-pair vocabulary, with their
# letter, number and space classes written out for code points below U+0180
# and the commonest alternative first (it excludes the others).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", " \t\n\r\x0b\x0c\x85\xa0"
_WORD = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_FAR = re.compile("[\x1c-\x1f\u0130\u0180-\U0010ffff]")
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
_LONE = re.compile(r"(?<=\S) (?=\S)")


def words(text: str) -> list[str]:
    """Pieces of a text for tokenizers that lower-case and drop white space."""
    if "<|" in text or _FAR.search(text):
        return [w for w in _SPACES.split(text) if w]
    return _WORD.findall(text.lower())


def spaced(text: str) -> list[str]:
    """Pieces of a text for byte-level tokenizers, of which a piece takes at most one leading space."""
    if "<|" in text or _FAR.search(text):
        first, *others = _LONE.split(text)
        return [first, *(" " + p for p in others)]
    return _BYTE.findall(text)


def kind_of(path: str, spec: bytes) -> str:
    """How texts may be cut for this tokenizer: by the pre-tokenizers that this module knows, else not at all."""
    if path.endswith(".model"):
        return "model"
    data = json.loads(spec)
    if any("<|" not in t["content"] for t in data.get("added_tokens") or []):
        return "whole"  # this module leaves only texts with that sign uncut
    pre = data.get("pre_tokenizer") or {}
    if pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True} and not data["normalizer"]:
        return "byte"
    split = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
    return "word" if split and split["pattern"].get("Regex") == WORD_PATTERN and data["model"].get("end_of_word_suffix") else "whole"


class Memo:
    """Piece -> what ``encode_all`` gives for it; the last ``most`` to twice ``most`` short pieces are kept."""

    def __init__(self, encode_all: Callable[[list[str]], Iterable[Any]], most: int = 250_000, longest: int = 48):
        self.encode_all, self.most, self.longest = encode_all, most, longest
        self.known: dict[str, Any] = {}
        self.before: dict[str, Any] = {}

    def __call__(self, pieces: list[str]) -> list[Any]:
        known = self.known
        out = list(map(known.get, pieces))
        if None not in out:
            return out
        missing = {p for p, v in zip(pieces, out, strict=True) if v is None}
        if len(known) > self.most:
            self.before, self.known = known, (known := {})
            missing = set(pieces)
        if before := self.before:
            known.update([(p, before[p]) for p in missing if p in before])
        new = [p for p in missing if p not in known]
        known.update(zip(new, self.encode_all(new), strict=True))
        out = [known[p] for p in pieces]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        return out


class Chunks:
    """Text -> the values of its chunks (what stands between white space), for tokenizers that lower-case and drop white space.

    A chunk's value is ``join`` of those of its pieces; ``encode_all`` gives the pieces' values,
    each piece being one word of the pre-tokenizer.  Chunks of texts that this module's pattern
    does not cover go to ``encode_whole``, one by one.
    """

    def __init__(self, encode_all: Callable[[list[str]], Iterable[Any]], encode_whole: Callable[[str], Any], join: Callable[[list[Any]], Any], most: int = 800_000):
        self.pieces, self.join = Memo(encode_all, most), join
        self.chunks = Memo(self._chunks, most // 2)
        self.others = Memo(lambda chunks: map(encode_whole, chunks), most // 8)

    def _chunks(self, chunks: list[str]) -> Iterable[Any]:
        cut = list(map(_WORD.findall, chunks))
        values, a, join = self.pieces([p for pieces in cut for p in pieces]), 0, self.join
        for pieces in cut:
            n = len(pieces)
            yield values[a] if n == 1 else join(values[a : a + n])
            a += n

    def __call__(self, text: str) -> list[Any]:
        if "<|" in text or _FAR.search(text):
            return self.others([w for w in _SPACES.split(text) if w])
        return self.chunks(text.lower().split())
