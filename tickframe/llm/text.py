"""Words of many texts at once, as NumPy arrays over one byte buffer.

A word is a run of bytes other than space and 0x09-0x0D, as in
``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses these bytes inside a character.
Hashes are two polynomials over random values of the bytes, modulo the prime
2**31 - 1 and with different random bases, finished by a mixing step, so any
run of words is hashed from prefix sums. Two different runs of n bytes agree
with a probability of (n / 2**31)**2, whatever they hold: a prime modulus has
no strings that collide for every base, as a power of two has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space, control and punctuation bytes of ASCII: all but letters, digits and what is beyond ASCII.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_PRIME = np.uint64(2**31 - 1)
_BASES = (1_290_845_327, 834_106_259)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, not fully reduced: under 2**33, and under 2**31 + 4 if x is under 2**33."""
    out = x >> np.uint64(31)
    out += x & _PRIME
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    def run(base: int) -> np.ndarray:
        out = np.ones(n, np.uint32)
        have, step = 1, base
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more].astype(np.uint64) * np.uint64(step) % _PRIME
            have, step = have + more, step * step % int(_PRIME)
        return out

    return [(run(b), run(pow(b, -1, int(_PRIME)))) for b in _BASES]


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and those of its inverse, at least n of each."""
    return _powers(1 << max(20, int(n + 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefix:
    """Prefix sums of values, from which any run of them is hashed."""

    def __init__(self, values: np.ndarray):
        n, self.powers, self.sums = len(values), powers(len(values)), []
        for side, (up, _) in enumerate(self.powers):
            part = values >> np.uint64(33) if side else values & _PRIME
            part *= up[:n]
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_folded(part), out=sums[1:])
            self.sums.append(sums)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[start:end] for each pair of bounds."""
        halves = []
        for sums, (_, down) in zip(self.sums, self.powers):
            half = _folded(_folded(sums[end] - sums[start]))
            half = _folded(_folded(half * down[start]))
            halves.append(np.where(half >= _PRIME, half - _PRIME, half))
        return mixed((halves[0] << np.uint64(33)) ^ halves[1] ^ mixed((end - start).astype(np.uint64)))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Prefix(values).hashes(start, end)


@dataclass
class Words:
    """Words of consecutive documents: byte bounds and the document's row."""

    data: np.ndarray
    bounds: np.ndarray  # byte bounds of the documents
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each document, the index of its first word; one more at the end

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(_BYTE[LOWER[self.data] if lower else self.data], self.start, self.end)

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indices) and hashes of all runs of k words within a document."""
        at = np.arange(max(0, len(hashes) - k + 1))
        at = at[self.row[at] == self.row[at + k - 1]] if len(at) else at
        return at, span_hashes(hashes, at, at + k)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and their bounds; nulls are empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, gaps: np.ndarray = SPACE) -> Words:
    """Words of the texts; gaps marks the bytes that belong to none."""
    data, bounds = buffers(texts)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(gaps[data], out=inside[1:-1])
    rise, fall = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = bounds[1:-1]  # a document's bound also ends a word
    cut = cut[inside[cut] & inside[cut + 1]]
    rise[cut] = True
    fall[cut] = True
    start, end = np.flatnonzero(rise), np.flatnonzero(fall)
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, row, first)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about so many bytes of text, one row at least."""
    for batch in batches:
        _, bounds = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
