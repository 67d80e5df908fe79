"""Ids of whole texts through their distinct pre-tokens.

Byte-level BPE merges within a pre-token only, so a text's ids are those of its pre-tokens in a row. A Lexicon holds each
distinct pre-token's ids once, in flat arrays; a text is then a gather over them. The lexicon starts anew when it holds
`most` pre-tokens, which bounds its memory for any input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import regex

# A fixed value, the split pattern for texts of the first 256 code points: white space, letters and digits as the full pattern has them there.
SPACE, LETTER, DIGIT = r" \t\n\r\f\v\x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+""")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text by the pattern that has \\s, \\p{L} and \\p{N}; White_Space is spelled out, as \\s differs between libraries."""
    whole = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return whole.findall(text)
        return LATIN.findall(text)

    return split


class Slots(dict):
    """Numbers new keys as they are asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Lexicon:
    """encode: ids of many pre-tokens at once. Call as lexicon(texts): a uint32 array per text."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], most: int = 500_000):
        self.split, self.encode, self.most = split, encode, most
        self._clear()

    def _clear(self) -> None:
        self.slots, self.known = Slots(), 0
        self.starts, self.sizes, self.flat = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _learn(self) -> None:
        if self.known == len(self.slots):
            return
        new = list(islice(reversed(self.slots), len(self.slots) - self.known))[::-1]
        ids = self.encode(new)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.known = len(self.slots)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. Pre-tokens are learned for several texts at once."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            parts = self.split(text)
            held.append(np.fromiter(map(self.slots.__getitem__, parts), np.int32, len(parts)))
            size += len(parts)
            if size >= 1 << 20 or len(self.slots) >= self.most:
                yield from self._ids(held)
                held, size = [], 0
                if len(self.slots) >= self.most:
                    self._clear()
        yield from self._ids(held)

    def _ids(self, held: list[np.ndarray]) -> Iterator[np.ndarray]:
        self._learn()
        for codes in held:
            sizes = self.sizes[codes]
            ends = np.cumsum(sizes, dtype=np.int32)
            if not len(ends):
                yield np.empty(0, np.uint32)
                continue
            at = np.repeat(self.starts[codes] - ends + sizes, sizes)
            at += np.arange(ends[-1], dtype=np.int32)
            yield self.flat[at]
