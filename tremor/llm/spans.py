"""Byte transducers over whole texts, and exact work with the word spans that they find, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Classes of bytes. A byte of UTF-8 that continues a character is one of its own; all others begin one.
SPACE, PLAIN, CAPITAL, SYMBOL, CONTINUES = range(5)
#: Spans of more bytes than this are hashed and compared one at a time.
LONG = 64
#: About so many bytes of text are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 21
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table_of(inside, capitals: bool = True, symbols: str = "") -> np.ndarray:
    """Byte -> class. `inside` tells which bytes words are made of; all others are SPACE."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x80 <= b < 0xC0:
            out[b] = CONTINUES if inside(b) else SPACE
        elif inside(b):
            out[b] = CAPITAL if capitals and 0x41 <= b <= 0x5A else SYMBOL if chr(b) in symbols and b < 0x80 else PLAIN
    return out


#: Words of anything but ASCII white space, with capitals and the given symbols told apart.
TEXT = table_of(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, symbols="#$%&*|")
#: Words of ASCII letters and non-ASCII bytes.
LETTERS = table_of(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A, capitals=False)
#: What the transducer writes in state s (0 between words, 1 in a word) at a byte of class c: 1 a word begins, 2 a word has ended, 0 nothing.
EMIT = np.array([[0, 1, 1, 1, 1], [2, 0, 0, 0, 0]], np.uint8)
#: The state after a byte of each class, whatever the state before: so the states of a whole text are one table lookup.
NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _K[1]
        x = (x ^ (x >> np.uint64(27))) * _K[2]
        return x ^ (x >> np.uint64(31))


class Spans:
    """The words of some texts: bytes `data`, and for each word its text's place `doc`, where it starts, its length and a hash.

    A text's words are found by the transducer of `classes` in one pass of table lookups: the class of each byte, the state
    before it, what is written there. Each text is followed by a byte of class SPACE, so that the state is 0 where
    the next one begins.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, classes: np.ndarray, lower: bool = False):
        # texts lie at [ends[i - 1] + 1, ends[i]) of data, with a white space byte at ends[i]
        self.data, self.ends = (LOWER[data] if lower else data), ends
        self.kinds = classes[data]
        before = np.zeros(len(data), np.uint8)
        before[1:] = NEXT[self.kinds[:-1]]
        written = EMIT[before, self.kinds]
        self.start = np.flatnonzero(written == 1)
        self.length = np.flatnonzero(written == 2) - self.start
        self.doc = np.searchsorted(ends, self.start)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        self.hash = self._hashes()

    def _eight(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next up to 8 bytes from `start` on, of `left` bytes, as a number."""
        bits = (np.minimum(left, 8) * 8).astype(np.uint64)
        mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        return self._eights[start] & mask

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def _hashes(self) -> np.ndarray:
        h = mix(self._eight(self.start, self.length) + _K[0] * self.length.astype(np.uint64))
        at, rest = 8, np.flatnonzero((self.length > 8) & (self.length <= LONG))
        while len(rest):
            h[rest] = mix(h[rest] * np.uint64(31) + self._eight(self.start[rest] + at, self.length[rest] - at))
            at += 8
            rest = rest[self.length[rest] > at]
        for i in np.flatnonzero(self.length > LONG):
            h[i] = xxhash.xxh64_intdigest(self.word(i))
        return h

    def same(self, a: np.ndarray, other: Spans, b: np.ndarray) -> np.ndarray:
        """Whether word a[i] here has the bytes of word b[i] there."""
        out = self.length[a] == other.length[b]
        at, rest = 0, np.flatnonzero(out & (self.length[a] <= LONG))
        while len(rest):
            left = self.length[a[rest]] - at
            equal = self._eight(self.start[a[rest]] + at, left) == other._eight(other.start[b[rest]] + at, left)
            out[rest[~equal]] = False
            at += 8
            rest = rest[equal & (left > 8)]
        for i in np.flatnonzero(out & (self.length[a] > LONG)):
            out[i] = self.word(a[i]) == other.word(b[i])
        return out

    def distinct(self) -> np.ndarray:
        """For each text, the number of its different words: each is put into an open-addressed table, at the first place from
        its hash on that is free or holds the same word of the same text, which is verified byte by byte."""
        n = len(self.start)
        size = 1 << max(4, (2 * n).bit_length())
        holder = np.full(size, -1, np.int64)
        place = (mix(self.hash + _K[0] * self.doc.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
        counts = np.zeros(len(self.ends), np.int64)
        left = np.arange(n)
        while len(left):
            free = left[holder[place[left]] < 0]
            holder[place[free]] = free  # of several words the last stays
            there = holder[place[left]]
            own = there == left
            counts += np.bincount(self.doc[left[own]], minlength=len(counts))
            other = np.flatnonzero(~own)
            a, b = left[other], there[other]
            maybe = np.flatnonzero((self.doc[a] == self.doc[b]) & (self.hash[a] == self.hash[b]))
            known = np.zeros(len(a), bool)
            known[maybe] = self.same(a[maybe], self, b[maybe])
            left = a[~known]
            place[left] = (place[left] + 1) & (size - 1)
        return counts


def pieces(text: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, data, ends) for runs of texts of about `piece` bytes: the bytes of texts i to j - 1, each followed by a blank, and where the blanks are. Null is empty."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    length = np.diff(offsets)
    length[np.asarray(text.is_null())] = 0
    i = 0
    while i < len(text):
        size = np.cumsum(length[i : i + 100_000] + 1)
        j = i + max(1, int(np.searchsorted(size, piece, "right")))
        ends = size[: j - i] - 1
        data = np.full(size[j - i - 1], 0x20, np.uint8)
        if length[i:j].all():  # no gaps in the bytes
            keep = np.ones(len(data), bool)
            keep[ends] = False
            data[keep] = raw[offsets[i] : offsets[j]]
        else:
            for k in range(i, j):
                data[ends[k - i] - length[k] : ends[k - i]] = raw[offsets[k] : offsets[k] + length[k]]
        yield i, j, data, ends
        i = j
