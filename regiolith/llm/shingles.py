"""Words and word n-grams as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose hashes are made at once; only a longer word takes more.
PART = 1 << 15
#: The base of the polynomial of a word.
BASE = 0xA0761D6478BD642F
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = bytes(int(b in WHITE) for b in range(256))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64"""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """64-bit hashes of the words of a text. Words stand between the characters 0x20 and 0x09 to 0x0D; A-Z count in
    lower case; bytes are those of UTF-8.

    A word's hash is a polynomial of its bytes, so the hashes of all words come from one running sum."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, PART + 1), powers(INVERSE, PART + 1)

    def __call__(self, text: str) -> np.ndarray:
        padded = b" %b " % text.encode("utf-8", "surrogatepass").lower()
        white = np.frombuffer(padded.translate(IS_WHITE), np.bool_)
        edges = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = edges[::2], edges[1::2]
        data = np.frombuffer(padded, np.uint8)[1:-1]
        if len(data) <= PART:
            return self.part(data, starts, ends)
        out, at = [], 0
        while at < len(starts):  # as many whole words as fit, one at least
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, side="right")))
            low, high = starts[at], ends[stop - 1]
            out.append(self.part(data[low:high], starts[at:stop] - low, ends[at:stop] - low))
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def part(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.up, self.down
        if len(data) >= len(up):
            up, down = powers(BASE, len(data) + 1), powers(INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], out=sums[1:])
        out = sums[ends]
        out -= sums[starts]
        out *= down[starts]
        out += up[ends - starts]  # so that bytes of 0 count
        return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each hash spread over all others, in place."""
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(33)
        h *= factor
    h ^= h >> np.uint64(33)
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; fewer words make one window of what there is."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * MULTIPLIER + h[i : len(h) - n + 1 + i]
    return mixed(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one occurrence, number of occurrences) of each distinct code."""
    order = np.argsort(codes)
    codes = codes[order]
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return order[new], np.diff(np.append(new, len(codes)))


def shingle_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """The distinct n-word shingles of a text, sorted by hash."""
    return distinct(grams(hashes(text), n))


class Lookup:
    """Numbers 0, 1, ... of known hashes (none of them 0), and -1 of all others; an open hash table in two arrays."""

    def __init__(self, known: np.ndarray):
        known = known.astype(np.uint64)
        self.mask = np.uint64((1 << max(4, (2 * len(known)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.numbers = np.full(int(self.mask) + 1, -1, np.int32)
        todo, at = np.arange(len(known)), known & self.mask
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = known[todo[free]]  # of several at one place the last one stays
            placed = self.keys[at] == known[todo]
            self.numbers[at[placed]] = todo[placed]
            todo, at = todo[~placed], (at[~placed] + np.uint64(1)) & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        found = self.keys[at]
        out = np.where(found == h, self.numbers[at], -1)
        todo = np.flatnonzero((found != h) & (found != 0))
        at = at[todo]
        while len(todo):
            at = (at + np.uint64(1)) & self.mask
            found = self.keys[at]
            hit = found == h[todo]
            out[todo[hit]] = self.numbers[at[hit]]
            more = ~hit & (found != 0)
            todo, at = todo[more], at[more]
        return out
