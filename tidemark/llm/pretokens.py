"""Splitting text into pre-tokens with Python's own re, and saying which characters that does not suit."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: White space as the tokenizers' patterns have it.
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")

#: Alternatives whose first characters differ commute; the most frequent one stands first.
SPACED_WORDS = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
BARE_WORDS = re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+")


def _exact_class(c: str) -> str:
    if c in WHITE_SPACE:
        return "space"
    category = unicodedata.category(c)
    return {"L": "letter", "N": "number"}.get(category[0], "other")


def _re_class(c: str) -> str:
    if c.isspace():
        return "space"
    if c.isdecimal():
        return "number"
    return "letter" if c.isalnum() else "other"


@lru_cache(maxsize=200_000)
def plain(c: str) -> bool:
    """True if re's classes give c the class that the Unicode categories give it, and lower-casing c needs no context."""
    return unicodedata.category(c) != "Cn" and c not in "Σİ" and _exact_class(c) == _re_class(c)


def all_plain(text: str) -> bool:
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or all(map(plain, set(text)))
