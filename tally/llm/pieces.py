"""Cutting texts into pieces at places where a byte-level tokenizer's word
pattern always cuts.

Of the public pattern ``'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
every match that holds a space followed by other than white space begins with
that space.  So a text may be cut before each such space; pieces repeat much
more than texts and are cut into words, or tokenized, once each."""

from __future__ import annotations

import re

#: a space that is followed by white space or the end; texts that hold one are cut by the pattern
BOUNDARY = re.compile(r" (?=\s|\Z)")
SUPPORTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def safe_pieces(text: str) -> list[str] | None:
    """The pieces of a text, or None if it has to be cut by the pattern itself."""
    if BOUNDARY.search(text):
        return None
    parts = text.split(" ")
    out = [" " + p for p in parts]
    out[0] = parts[0]
    if not parts[0]:
        del out[0]
    return out


class Words:
    """``pieces``: a text's pieces; ``words``: a piece's words."""

    def __init__(self, pattern: str) -> None:
        import regex

        # white space as Unicode defines it; the separators 1C to 1F are none
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cut = safe_pieces if pattern == SUPPORTED else lambda text: None

    def pieces(self, text: str) -> list[str]:
        found = self.cut(text)
        return self.find(text) if found is None else found

    def words(self, piece: str) -> list[str]:
        return self.find(piece)


_COMPILED: dict[str, Words] = {}


def compile_words(pattern: str) -> Words:
    if pattern not in _COMPILED:
        _COMPILED[pattern] = Words(pattern)
    return _COMPILED[pattern]
