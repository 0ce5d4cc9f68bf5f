"""Encoding whole texts with a public tokenizer file, with the ids of repeated units kept."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

_SPACE = re.compile(r"\s")


class _Units(dict):
    """Bytes of a unit's ids. Two generations bound it: when the young one is full the old one goes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            out = self.encode(unit, self)
        if len(unit) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = out
        return out


#: Latin letters (not the dotted capital I, whose lower case ends in a mark), then anything that starts with ASCII punctuation: no token spans that place
_LETTERS = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+\Z")
_TAIL = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~].*)\Z", re.S)


def _byte_signs() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TextEncoder:
    """``ids(text)``: the little-endian unsigned 32-bit ids of ``tokenizer.encode(text, add_special_tokens=False)``.

    The result always equals that call's. Two pre-tokenizers never form a token across the place before a space
    that follows a non-space, so there the text is cut at such spaces and the ids of its units are looked up first:

    * byte-level with the usual expression (a space belongs to the next token),
    * a split that drops white space.

    A unit that is not held is cut again, at single line feeds between other characters and between a letter and ASCII
    punctuation, where no token of the two expressions can span either. What is then a run of Latin letters is one word to
    both expressions and goes to the library's model as it is, in the byte-level alphabet. Other tokenizers, texts with white space next to a space, and texts that contain an added token's string are
    encoded in one piece. ``keep`` bounds the units held per generation.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.mode = _mode(spec)
        self.first = _Units(lambda w, held: self.cut(w, held, ""), keep // 3)
        lead = " " if self.mode == "keep" else ""
        self.next = _Units(lambda w, held: self.cut(w, held, lead), keep)
        self.line = self.whole("\n")
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        # any white space that stands before a space, in Python's wide sense
        self.unsafe = re.compile(r"\s ")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, unit: str, held: _Units, lead: str) -> bytes:
        if "\n" in unit:
            lines = unit.split("\n")
            if all(lines) and not any(_SPACE.search(x) for x in lines):
                return held[lines[0]] + b"".join(self.line + self.first[x] for x in lines[1:])
        elif (m := _TAIL.match(unit)) and not _SPACE.search(unit):
            return held[m[1]] + self.first[m[2]]
        elif _LETTERS.match(unit):
            word = unit.lower() if self.mode == "drop" else lead + unit
            if lead or not word.isascii():
                word = "".join([self.signs[b] for b in word.encode()])
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return self.whole(lead + unit)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.mode or any(t in text for t in self.added) or self.unsafe.search(text):
            return self.whole(text)
        units = text.split(" ")
        return self.first[units[0]] + b"".join(map(self.next.__getitem__, units[1:]))


def _mode(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "keep"
    parts = pre.get("pretokenizers") or []
    names = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    if (
        len(parts) == 2
        and parts[0].get("type") == "Split"
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert")
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex", True)
        and names <= {"NFC", "Replace", "Lowercase"}
        and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
    ):
        return "drop"
    return ""


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(path)
