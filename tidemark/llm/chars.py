"""Words of many texts as numpy arrays: places, hashes, and hashed character features.

Texts are lower-cased and joined; a word is a run of letters. All work is on arrays of
code points, so nothing runs once per word in Python. Texts come in groups of bounded
size; one that is larger than a group is cut at white space where there is any.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLAB = 1 << 20  # characters handled at a time
_BASE = np.uint64(0x110003)
_letter = np.zeros(0, dtype=bool)
_power = np.zeros(0, dtype=np.uint64)


def _letters() -> np.ndarray:
    global _letter
    if not _letter.size:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.full(max(n, 256), 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def groups(texts: list[str | None], overlap: int = 0) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about SLAB characters; a longer text has a list for each piece.

    A further piece of a text repeats the last `overlap` characters of the piece before.
    """
    now, held = [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        at = 0
        while len(text) - at > SLAB:
            space = max(text.rfind(" ", at, at + SLAB), text.rfind("\n", at, at + SLAB))
            end = space + 1 if space > at else at + SLAB
            if now:
                yield now
            yield [(row, text[at:end])]
            now, held, at = [], 0, end - overlap
        now.append((row, text[at:]))
        held += len(text) - at
        if held >= SLAB:
            yield now
            now, held = [], 0
    if now:
        yield now


class Words:
    """Words of one group: code array, starts, ends (exclusive), hashes, words per piece."""

    def __init__(self, pieces: list[str]) -> None:
        code = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.zeros(len(code) + 6, dtype=np.uint64)
        c[3:-3] = np.where(_letters()[code], code, 0)
        inside = c > 0
        self.code = c
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        size = self.end - self.start
        bounds = np.cumsum([0] + [len(p) + 1 for p in pieces]) + 3
        self.counts = np.diff(np.searchsorted(self.start, bounds))
        if not len(size):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        at = np.flatnonzero(inside)
        first = np.cumsum(size) - size
        place = np.arange(len(at)) - np.repeat(first, size)
        total = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(c[at] * _powers(int(size.max()))[place], out=total[1:])
        self.hash = mix(total[first + size] - total[first])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of the first of each distinct word, distinct word of each word)."""
        _, first, back = np.unique(self.hash, return_index=True, return_inverse=True)
        return first, back

    def features(self, chosen: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots, word of each) for the chosen words: pairs and triples of letters with the
        word's boundaries, prefixes and suffixes of one to three letters, the word itself."""
        c, s, e = self.code, self.start[chosen], self.end[chosen]
        size = e - s
        ids = np.arange(len(s))
        of = np.repeat(ids, size)
        at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = lambda kind, *letters: slot(sum_up(kind, letters), bits)

        def sum_up(kind: int, letters: tuple[np.ndarray, ...]) -> np.ndarray:
            h = np.full(letters[0].shape, kind, dtype=np.uint64)
            for x in letters:
                h = h * _BASE + x
            return h

        last = e - 1
        second = np.where(size > 1, c[s + 1], 0)
        third = np.where(size > 2, c[s + 2], 0)
        second_last = np.where(size > 1, c[last - 1], 0)
        third_last = np.where(size > 2, c[last - 2], 0)
        slots = [
            key(2, c[at - 1], c[at]),
            key(3, c[at - 1], c[at], c[at + 1]),
            key(4, c[s]),
            key(5, c[s], second),
            key(6, c[s], second, third),
            key(7, c[last]),
            key(8, second_last, c[last]),
            key(9, third_last, second_last, c[last]),
            slot(self.hash[chosen] + np.uint64(11), bits),
        ]
        return np.concatenate(slots), np.concatenate([of, of] + [ids] * 7)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class ByteWords:
    """Words of many UTF-8 texts: runs of bytes other than ASCII white space.

    start, end (exclusive) in `data`, hash, words per text, first byte of each text.
    """

    def __init__(self, texts: list[bytes], second: bool = False) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[1:] = ~_SPACE[self.data]
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        size = self.end - self.start
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.cumsum(sizes) - sizes
        self.counts = np.diff(np.append(np.searchsorted(self.start, self.text_start), len(self.start)))
        self.hash = self._hashes(size, np.uint64(1))
        self.other = self._hashes(size, np.uint64(0x5851F42D4C957F2D)) if second else None

    def _hashes(self, size: np.ndarray, salt: np.uint64) -> np.ndarray:
        """A hash of each word: its bytes, spread by a table, times powers of an odd number."""
        if not len(size):
            return np.zeros(0, dtype=np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = self.data[np.repeat(self.start, size) + place]
        spread = mix(np.arange(1, 257, dtype=np.uint64) * salt)
        total = np.zeros(len(place) + 1, dtype=np.uint64)
        np.cumsum(spread[byte] * _powers(int(size.max()))[place], out=total[1:])
        return mix(total[first + size] - total[first] + size.astype(np.uint64))


def byte_groups(texts: list[str | None], size: int = SLAB) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of about `size` bytes; a longer text is a group by itself."""
    now, held, first = [], 0, 0
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if now and held + len(data) > size:
            yield first, now
            now, held = [], 0
        if not now:
            first = row
        now.append(data)
        held += len(data)
    if now:
        yield first, now
