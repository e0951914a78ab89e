"""Hashes of words, shingles and minima over whole Arrow batches of text, without a Python object per word.

A batch is cut into slices of about one megabyte, so memory follows the slice and not the batch; a text
longer than a slice is hashed in pieces cut at white space and is still seen whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_rng = np.random.Generator(np.random.PCG64(20_240_917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as long as the longest slice so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                run = np.full(size, np.uint64(base))
                run[0] = 1
                setattr(cls, name, np.cumprod(run, dtype=np.uint64))
        return cls.up, cls.down


@dataclass
class Words:
    """Hash, first byte and unit of every word; ``counts`` has the words of each unit."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def _piece_words(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[raw]
    inside = ~SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    first[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * up[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _STEP), starts, ends


def words_of(raw: np.ndarray, edges: np.ndarray) -> Words:
    """Words of units that lie between neighbouring ``edges`` of ``raw``; A-Z count as a-z."""
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SLICE_BYTES)
        while to < len(raw):
            gaps = np.flatnonzero(SPACE[raw[to : to + SLICE_BYTES]])
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(len(raw), to + SLICE_BYTES)
        hashes, starts, ends = _piece_words(raw[at:to], edges - at)
        parts.append((hashes, starts + at, ends + at))
        at = to
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, edges))
    return Words(hashes, starts, ends, counts)


def shingles_of(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words in order, and how many each unit has.

    A unit of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    counts = words.counts
    n = len(words.hashes)
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), n_shingles
    first_word = np.cumsum(counts) - counts
    where = np.repeat(first_word - (np.cumsum(n_shingles) - n_shingles), n_shingles)
    where = where + np.arange(len(where))
    width = np.repeat(np.minimum(counts, size), n_shingles)
    hashes = np.zeros(len(where), dtype=np.uint64)
    for k in range(size):
        step = hashes * _STEP + words.hashes[np.minimum(where + k, n - 1)]
        hashes = step if k == 0 else np.where(k < width, step, hashes)
    return mix(hashes + width.astype(np.uint64)), n_shingles


class MinHash:
    """Minima of ``size`` seeded permutations over the shingles of each unit."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.scale = rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 2**32, size, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row per unit that has a shingle, in order."""
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        out = np.empty((len(starts), len(self.scale)), dtype=np.uint32)
        if len(starts):
            high = (shingles >> np.uint64(32)).astype(np.uint32)
            low = shingles.astype(np.uint32)
            for k, (a, b) in enumerate(zip(self.scale, self.shift, strict=True)):
                # The low half enters as a second multiplier, so permutations differ in more than scale.
                out[:, k] = np.minimum.reduceat((high ^ b) * a ^ low, starts)
        return out


def sketch(minima: np.ndarray, bits: int = 64) -> list[np.ndarray]:
    """One bit of every minimum, ``bits`` to a signed long: equal bits grow with similarity."""
    mixed = mix(minima.astype(np.uint64) * _STEP) & np.uint64(1)
    place = np.arange(bits, dtype=np.uint64)
    return [
        (mixed[:, k : k + bits] << place).sum(axis=1, dtype=np.uint64).view(np.int64)
        for k in range(0, minima.shape[1] - bits + 1, bits)
    ]


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, edges) of slices of a text column; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)
    edges = edges[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(edges, edges[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, raw[edges[row] : edges[end]], edges[row : end + 1] - edges[row]
        row = end


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal ``keys`` (no nulls) as tables; several whole groups may share one.

    Rows must come sorted by the keys. At most one group and one batch are in memory at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            same &= values[1:] == values[:-1]
        cuts = np.flatnonzero(~same) + 1
        if held:
            before, now = held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)
            if any(before.column(k) != now.column(k) for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
