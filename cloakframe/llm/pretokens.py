"""Splitting texts as the tokenizers library does, and its stand-ins for bytes."""

from __future__ import annotations

from functools import cache

import regex
from tokenizers import Regex, pre_tokenizers

#: Characters that the library is asked about at a time: it holds more than 100 bytes for each.
_ASKED = 1 << 12


def byte_symbols() -> dict[int, str]:
    """The usual printable stand-in for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


@cache
def strange_characters() -> dict[int, str]:
    """Characters that the library's patterns class otherwise than ``regex`` does, with stand-ins of their class.

    The library itself is asked: its tables are those of another Unicode version.
    """
    out: dict[int, str] = {}
    for kind, inside in ((r"\p{L}", "x"), (r"\p{N}", "1"), (r"\s", " ")):
        splitter = pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True)
        for start in range(0, 0x110000, _ASKED):
            some = "".join(chr(c) for c in range(start, start + _ASKED) if not 0xD800 <= c < 0xE000)
            mine = set("".join(regex.findall(kind + "+", some)))
            theirs = set("".join(part for part, _ in splitter.pre_tokenize_str(some)))
            out |= {ord(c): "\u2603" for c in mine - theirs if ord(c) not in out}
            out |= {ord(c): inside for c in theirs - mine}
    return out


def split_words(pattern: regex.Pattern, text: str) -> list[str]:
    """Matches of a pattern without groups, with the library's character classes."""
    if text.isascii() or strange_characters().keys().isdisjoint(map(ord, set(text))):
        return pattern.findall(text)
    return [text[slice(*m.span())] for m in pattern.finditer(text.translate(strange_characters()))]
