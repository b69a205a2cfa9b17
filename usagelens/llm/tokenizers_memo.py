"""Whole-text encoding with the ``tokenizers`` library, which sees each distinct word once.

Byte-pair encoding works inside pre-tokens, so each distinct pre-token goes to the
library's model once for each worker, and its ids are remembered. Two layouts
are known, and any other tokenizer encodes whole texts:

* *word ends*: lower case, white space dropped;
* *byte level*: pre-tokens may start with a space.

Where the tokenizer spells bytes, the model is given the character that stands for each byte.

Texts with characters for which Unicode tables or normal forms could differ between
libraries go to the tokenizer as a whole, and so do texts that spell a special token.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

# The pre-token patterns of the two public tokenizers (fixed values), by which their files are known.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Pre-tokens known at once; beyond it a memory starts anew.
MEMORY = 800_000
# Anything but Latin, Cyrillic, general punctuation, kana and unified ideographs.
UNSURE = re.compile("[^\\0-\u024f\u0400-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
# The same patterns for the standard ``re``: {L}, {N} and {S} are the letters, numbers and white space
# among the characters that get this far. Alternatives that begin alike keep their order.
FAST_WORD = "[{L}]+|'(?:[stmd]|re|ve|ll)|[{N}]|[^{S}{L}{N}]+"
FAST_BYTE = " ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ENCODERS: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """The encoder of this worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _ranges(kind: str, among: list[str]) -> str:
    """The characters of a class of ``regex``, as ranges."""
    found = [ord(c) for c in among if regex.match(kind, c)]
    starts = [c for p, c in zip([-2, *found], found) if c != p + 1]
    ends = [p for p, c in zip(found, [*found[1:], -2]) if c != p + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def fast(pattern: str) -> re.Pattern:
    sure = {chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not UNSURE.match(chr(c))}
    among = sorted(sure | {c for known in sure for c in known.lower()})
    for name, kind in (("{L}", r"\p{L}"), ("{N}", r"\p{N}"), ("{S}", r"\s")):
        pattern = pattern.replace(name, _ranges(kind, among))
    return re.compile(pattern)


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level models (a fixed value): itself where it can be seen."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [byte for byte in range(256) if byte not in seen]
    return {byte: chr(byte) for byte in seen} | {byte: chr(256 + at) for at, byte in enumerate(unseen)}


BYTE_CHARACTERS = _byte_characters()


class _Known(dict):
    """Ids of pre-tokens as bytes; a new one is asked of the library's model."""

    def __init__(self, tokenizer: Tokenizer, byte_level: bool):
        self.tokenize, self.byte_level = tokenizer.model.tokenize, byte_level

    def __missing__(self, part: str) -> bytes:
        spelled = part.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS) if self.byte_level else part
        ids = [token.id for token in self.tokenize(spelled)]
        self[part] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def _splits_words(spec: dict | None) -> tuple[bool, bool]:
    """Whether a pre-tokenizer does nothing but cut by the word pattern, and whether it spells bytes after that."""
    steps = (spec or {}).get("pretokenizers") or [spec or {}]
    cut, after = steps[0], steps[1:]
    words = cut.get("type") == "Split" and cut.get("pattern") == {"Regex": WORD_PATTERN} and cut.get("behavior") == "Removed" and cut.get("invert")
    plain = lambda step: step["type"] == "ByteLevel" and not step["add_prefix_space"] and not step["use_regex"]
    return bool(words and len(after) < 2 and all(map(plain, after))), bool(after)


class TextEncoder:
    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.memory = memory
        self.whole = Tokenizer.from_file(path)
        words, byte_level = _splits_words(spec.get("pre_tokenizer"))
        suffix = spec["model"].get("end_of_word_suffix")
        self.kind = "other"
        if spec["model"]["type"] == "BPE" and suffix and words:
            self.kind, self.pattern = "word ends", fast(FAST_WORD)
        elif spec["model"]["type"] == "BPE" and not suffix and spec.get("normalizer") is None \
                and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" \
                and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"]["use_regex"]:
            self.kind, self.pattern, byte_level = "byte level", fast(FAST_BYTE), True
        self.special = [token["content"] for token in spec.get("added_tokens", [])]
        self.parts = _Known(self.whole, byte_level)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        found, id_of = [], self.parts.__getitem__
        for text in texts:
            words = self._pretokens(text)
            if words is None:
                found.append(self._bytes(self.whole.encode(text, add_special_tokens=False).ids))
                continue
            found.append(b"".join(map(id_of, words)))
            if len(self.parts) > self.memory:
                self.parts.clear()
        return found

    def _pretokens(self, text: str) -> list[str] | None:
        if self.kind == "other" or UNSURE.search(text) or any(token in text for token in self.special):
            return None
        return self.pattern.findall(text.lower() if self.kind == "word ends" else text)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()
