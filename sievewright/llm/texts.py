"""Vectorised text primitives over Arrow string columns (used inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cum = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = cum[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cum, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the ``n + 1`` offsets of its values; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (a run without ``breaks``, blanks by default) and the index of the first word of each text."""
    solid = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, solid[:-1]] if len(data) else solid
    after = np.r_[solid[1:], False] if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * powers[:-1], out=sums[1:])
    inverse = np.full(n + 1, _BASE_INV, np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles of each text, end to end, and the ``n + 1`` offsets.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = raw_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    total = len(words)
    joined = np.zeros(max(0, total - width + 1), np.uint64)
    for k in range(width):
        joined = joined * U(0xD6E8FEB86659FD93) + words[k : k + len(joined)]
    joined = mix(joined)
    sets, counts = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.unique(joined[a : b - width + 1])
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * U(0xA0761D6478BD642F) + w
            own = mix(np.array([h], np.uint64))
        else:
            own = words[:0]
        sets.append(own)
        counts.append(len(own))
    return (np.concatenate(sets) if sets else words[:0]), np.r_[0, np.cumsum(counts)].astype(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64 for unsigned values) over the segments between offsets; empty segments give 0."""
    cum = np.r_[values[:0].sum(keepdims=True) if len(values) == 0 else np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)]
    return cum[offsets[1:]] - cum[offsets[:-1]]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by key: each holds complete groups, in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        change = np.flatnonzero(~same)
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut == 0 and held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != v for k, v in zip(keys, last)):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the graph of edges ``a-b`` and the smallest node that each reaches."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
