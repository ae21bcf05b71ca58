"""Vectorised words and hashes over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as in bytes.split().
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, STEP = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95
U = np.uint64
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n. Tables of up to CHUNK places are kept."""
    found = _POWERS.get(base)
    if found is None or len(found[0]) < n:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), U(b))
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        found = pair[0], pair[1]
        if n <= CHUNK:
            _POWERS[base] = found
    return found


class Words:
    """The words of several texts: bytes with one space between words, byte range and text of each word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.count = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths + 1) - lengths - 1
        space = SPACE[raw]
        inside = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(inside == -1), np.flatnonzero(inside == 1)
        keep = ~space
        keep[ends[ends < len(raw)]] = True
        at = np.cumsum(keep, dtype=np.int32 if len(raw) < 1 << 31 else np.int64) - 1
        self.data = np.where(space, np.uint8(0x20), LOWER[raw] if lower else raw)[keep]
        self.starts = at[starts].astype(np.int64) if len(starts) else starts
        self.ends = at[ends - 1].astype(np.int64) + 1 if len(ends) else ends
        #: words of text i are first[i] to first[i + 1]
        self.first = np.append(np.searchsorted(starts, begins), len(starts)).astype(np.int64)
        self.text = np.repeat(np.arange(self.count), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A polynomial hash of each word, from prefix sums."""
        return range_hashes(self.data, self.starts, self.ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte range, from prefix sums; starts ascending. Works on CHUNK bytes or one range at a time."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, low + CHUNK // 2)))
        own = ends[at:stop]
        if stop > at + 1 and own.max() > low + CHUNK:  # a long range among short ones goes alone
            stop = at + max(1, int(np.argmax(own > low + CHUNK)))
            own = ends[at:stop]
        part = data[low : int(own.max())]
        power, inverse = powers(BASE, len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * power[: len(part)], dtype=np.uint64)))
        out[at:stop] = mix((sums[own - low] - sums[starts[at:stop] - low]) * inverse[starts[at:stop] - low])
        at = stop
    return out


def windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of each window of `size` values inside one text, and where each starts."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = powers(STEP, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:n], dtype=np.uint64)))
    lengths = np.diff(first)
    room = np.repeat(first[1:], lengths) - np.arange(n) >= size
    at = np.flatnonzero(room)
    return mix((sums[at + size] - sums[at]) * inverse[at]), at


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """A mask of the n places covered by runs of `size` that start at `at`."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.subtract.at(marks, np.minimum(at + size, n), 1)
    return np.cumsum(marks[:-1]) > 0


P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, a column of ranges of one length at a time."""
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes, cuts = np.unique(lengths[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        rows = order[a:b]
        at = starts[rows]
        place = 0
        if size >= 32:
            lanes = [np.full(len(at), U((seed + k) % (1 << 64))) for k in (P1 + P2, P2, 0, -P1)]
            while place + 32 <= size:
                for k in range(4):
                    lanes[k] = _rotl(lanes[k] + eight[at + place] * U(P2), 31) * U(P1)
                    place += 8
            h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _rotl(lane * U(P2), 31) * U(P1)) * U(P1) + U(P4)
        else:
            h = np.full(len(at), U((seed + P5) % (1 << 64)))
        h = h + U(size)
        while place + 8 <= size:
            h = _rotl(h ^ _rotl(eight[at + place] * U(P2), 31) * U(P1), 27) * U(P1) + U(P4)
            place += 8
        if place + 4 <= size:
            h = _rotl(h ^ (eight[at + place] & U(0xFFFFFFFF)) * U(P1), 23) * U(P2) + U(P3)
            place += 4
        while place < size:
            h = _rotl(h ^ padded[at + place].astype(np.uint64) * U(P5), 11) * U(P1)
            place += 1
        h = (h ^ (h >> U(33))) * U(P2)
        h = (h ^ (h >> U(29))) * U(P3)
        out[rows] = h ^ (h >> U(32))
    return out
