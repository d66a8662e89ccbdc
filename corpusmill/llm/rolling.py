"""Hashes of words and of windows of words, over whole Arrow batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes that one step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20
ROWS_AT_ONCE = 256
#: Bytes whose words are hashed together.
HASH_BYTES = 1 << 17
U = np.uint64
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def constants(seed: int) -> tuple[np.ndarray, int, int]:
    """Random values of the 256 bytes, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64), base, pow(base, -1, 1 << 64)


CONSTANTS = [constants(11), constants(13)]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base; those of a block are kept, longer runs aren't."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, HASH_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= HASH_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' values times powers of the base, from prefix sums over a block of words at a time."""
    values, base, inverse = CONSTANTS[which]
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + HASH_BYTES, side="right")))  # a longer word is a block of its own
        part = data[begin : int(ends[last - 1])]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * powers(base, len(part)), out=sums[1:], dtype=np.uint64)
        s, e = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = (sums[e] - sums[s]) * powers(inverse, len(part) + 1)[s]
        first = last
    return mixed(out + U(which) + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` words in a row, by doubling: a window is two shorter ones, mixed in order."""
    if len(h) < width:
        return h[:0]
    pair = lambda a, b, k: mixed(a * U(0xC2B2AE3D27D4EB4F) + b * U(0x165667B19E3779F9) + U(k))
    out, done, piece, length = None, 0, h, 1
    rest = width
    while rest:
        if rest & 1:
            part = piece[done : len(piece)]
            out = piece if out is None else pair(out[: len(part)], part[: len(out)], length)
            done += length
        rest >>= 1
        if rest:
            piece, length = pair(piece[:-length], piece[length:], length), 2 * length
    return out[: len(h) - width + 1]


class Step:
    """Some rows of a batch: their words and windows."""

    def __init__(self, first: int, texts: list[bytes]) -> None:
        self.first, self.n = first, len(texts)
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        blank = SPACES[self.data]
        word = ~blank
        before = np.concatenate([[True], blank[:-1]])
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.rows = np.concatenate([[0], np.cumsum(lengths)])
        self.row_words = np.searchsorted(self.starts, self.rows)  # first word of each row, and the end
        self.n_words = np.diff(self.row_words)

    def hashes(self, which: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, which)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words (in the step) of the windows that lie in one row, and their rows."""
        counts = np.maximum(self.n_words - width + 1, 0)
        rows = np.repeat(np.arange(self.n), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.row_words[:-1][rows] + at, rows


def steps(texts) -> Iterator[Step]:
    """An Arrow array of texts in steps of about STEP_BYTES; a null text is empty."""
    first, run, size = 0, [], 0
    for at in range(0, len(texts), ROWS_AT_ONCE):  # few texts at a time are Python objects
        for i, t in enumerate(texts.slice(at, ROWS_AT_ONCE).to_pylist(), at):
            b = t.encode() if t else b""
            if run and size + len(b) > STEP_BYTES:
                yield Step(first, run)
                first, run, size = i, [], 0
            run.append(b)
            size += len(b) + 1
    if run:
        yield Step(first, run)
