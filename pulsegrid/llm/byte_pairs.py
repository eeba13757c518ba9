"""Byte-pair vocabularies in the public JSON format, and the pieces of text that merges never cross."""

from __future__ import annotations

import json
from functools import lru_cache

import regex

#: How the two public byte-pair vocabularies split text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that the format writes for each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BYTE_OF_LETTER = _byte_letters()


class Vocabulary:
    """A merge table: symbols are numbers, 0 to n - 1, in order of their identifiers.

    rank[pair(a, b)] is the merge's rank, made[rank] the symbol it makes, parts[symbol]
    the two symbols it came from. `raw` spells a symbol in bytes, as Latin-1 text.
    """

    SHIFT = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.id_of = model["vocab"]
        self.text_of = {i: t for t, i in self.id_of.items()} | {i: t for t, i in self.special.items()}
        self.rank, self.made, self.parts = {}, [], {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.rank[a << self.SHIFT | b] = rank
            self.made.append(c)
            self.parts[c] = (a, b, rank)
        plain = {byte: self.id_of[letter] for letter, byte in BYTE_OF_LETTER.items()}
        self.of_byte = [plain[b] for b in range(256)]
        self.of_last_byte = [self.id_of[letter + self.suffix] for letter, _ in sorted(BYTE_OF_LETTER.items(), key=lambda x: x[1])]

    def split_special(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn, beginning and ending with ordinary text."""
        if self.special_pattern is None or "<|" not in text:
            return [text]
        return self.special_pattern.split(text)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)
