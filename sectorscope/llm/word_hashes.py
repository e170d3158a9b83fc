"""Hashes of all words of many texts at once, in numpy.

Texts are normalised to words joined by one blank and laid end to end in one
buffer; a word's hash is a polynomial of its bytes modulo 2**64, read off a
running sum. Equal words have equal hashes; whoever needs certainty compares
the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLANKS = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18
#: Bytes of text laid in one buffer (a longer text has a buffer of its own).
_BUFFER = 1 << 21


def normal(raw: bytes | None) -> bytes:
    """The words of a text joined by one blank."""
    if not raw:
        return b""
    text = raw.translate(_BLANKS)
    if b"  " in text or text[0] == 32 or text[-1] == 32:
        return b" ".join(text.split())
    return text


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                have = getattr(self, name)
                setattr(self, name, np.concatenate((have, have * np.uint64(pow(base, k, 1 << 64)))))


_POWERS = _Powers()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of ``data``; the ranges are in order and do not overlap."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + _PIECE, side="right")))
        hi = int(end[to - 1])
        _POWERS.to(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi] + np.uint64(1)) * _POWERS.up[:hi - lo], out=total[1:])
        first = start[at:to] - lo
        out[at:to] = (total[end[at:to] - lo] - total[first]) * _POWERS.down[first]
        at = to
    return out ^ (out >> np.uint64(31))


class WordBuffer:
    """The words of some texts: ``text``, and per word ``start``, ``end`` (bytes), ``doc`` (number) and ``hash``."""

    def __init__(self, texts: list[bytes]):
        self.text = b" ".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        blank = np.concatenate(([True], data == 32, [True]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.hash = span_hashes(data, self.start, self.end)

    def words(self, first: int, last: int) -> bytes:
        """The words ``first`` up to ``last`` (not included), joined by one blank; they are of one text."""
        return self.text[self.start[first]:self.end[last - 1]]


def buffers(texts: list[bytes]) -> Iterator[tuple[int, WordBuffer]]:
    """The texts (normalised) in buffers of bounded size: number of the first text, and the buffer."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= _BUFFER):
            size += len(texts[to])
            to += 1
        yield at, WordBuffer(texts[at:to])
        at = to
