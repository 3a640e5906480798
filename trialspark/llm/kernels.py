"""Vectorised helpers for Arrow batches of text: words, their hashes, window hashes.

All arithmetic is modulo 2^64. The hash of a run of values is a polynomial in a fixed odd base, so that the
hash of any span is a difference of two prefix sums. Functions here travel to executors by value.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text worked on at a time; a longer text is cut at white space for hashing words.
CHUNK = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate((one, np.full(self.size, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up, self.down


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums from which spans() reads hashes."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever the position."""
    _, down = powers.upto(len(sums))
    return (sums[end] - sums[start]) * down[start]


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    at = np.flatnonzero(padded[1:] != padded[:-1])
    return at[::2], at[1::2]


def word_table(spaces: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    out = np.ones(256, bool)
    out[list(spaces)] = False
    return out


def hashed_words(data: bytes, in_word: np.ndarray, powers: list[Powers], cut: int = 0) -> tuple[np.ndarray, ...]:
    """Start, end and one hash per base of every word of `data`; with `cut`, also of each word's first `cut` bytes."""
    buf, pieces, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        while end < len(buf):  # a chunk ends at white space
            back = np.flatnonzero(~in_word[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(end + CHUNK, len(buf))
        part = buf[at:end]
        start, stop = edges(in_word[part])
        got = [start + at, stop + at]
        wide = part.astype(np.uint64) + np.uint64(1)
        for p in powers:
            sums = prefix(wide, p)
            got.append(mix(spans(sums, start, stop, p) + (stop - start).astype(np.uint64)))
            if cut:
                got.append(mix(spans(sums, start, np.minimum(stop, start + cut), p)))
        pieces.append(got)
        at = end
    if not pieces:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (len(powers) * (2 if cut else 1)))
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def groups(texts: list[bytes], most: int = CHUNK):
    """Consecutive texts of about `most` bytes together: (first index, joined by a line feed, start of each, end of each)."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) < most):
            total += len(texts[last]) + 1
            last += 1
        own = texts[first:last]
        length = np.fromiter((len(t) for t in own), np.int64, len(own))
        end = np.cumsum(length + 1) - 1
        yield first, b"\n".join(own), end - length, end
        first = last


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
