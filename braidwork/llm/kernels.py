"""Array code over Arrow text columns: words, rolling hashes and line spans without a Python object per word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier: it has an inverse modulo 2**64, so that a span's hash does not depend on where the span stands.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def release() -> None:
    """Gives freed memory back to the system: a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 20), BASE if kind == "up" else BASE_INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of about `most` bytes of text (a longer text alone is one slice): the slice, its bytes, and where each text starts and ends in them. Null texts are empty."""
    for batch in batches:
        yield from _slices(batch, text, most)
    release()


def _slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    col = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = batch.slice(at, to - at)
        values = pc.fill_null(col.slice(at, to - at), "")
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        wide = pa.types.is_large_string(values.type)
        offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield part, data, offsets - offsets[0]
        at = to


class Rolling:
    """Hashes of any span of an array of small numbers, from one pass of prefix sums modulo 2**64.

    For feature buckets only, where a collision costs nothing: long texts can be made that collide. Where equal hashes
    must mean equal spans, span_hashes is the one to use.
    """

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _power("up", len(data)), out=self.sums[1:])
        self.down = _power("down", len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: Longer spans are hashed one by one.
_SHORT = 128
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a step, each step scrambled by a bijection that is not linear, so that no
    arrangement of the same bytes cancels out. Spans of up to eight bytes and one length never collide."""
    starts, size = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    out = mix(size.astype(U) * U(BASE) + U(1))
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        h = mix(h ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) + U(BASE)
        more = left > 8
        if not more.all():
            out[live[~more]] = h[~more]
            live, at, left, h = live[more], at[more], left[more], h[more]
        at, left = at + 8, left - 8
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        raw = memoryview(data.tobytes())
        out[long] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), (starts + size)[long].tolist(), strict=True)), "<u8")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether every span of data holds the same bytes as the span of other beside it, which has the same hash: spans of up to eight bytes do if they are of one length."""
    if not np.array_equal(sizes, lengths):
        return False
    long, done = np.flatnonzero(sizes > 8), 0
    total = np.cumsum(np.asarray(sizes, np.int64)[long])
    while done < len(long):  # so many bytes at once that the places fit a few MB
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 18), side="right")))
        rows, done = long[done:to], to
        n = np.asarray(sizes, np.int64)[rows]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not (data[np.repeat(starts[rows], n) + step] == other[np.repeat(at[rows], n) + step]).all():
            return False
    return True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word. Words never cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    full = ~BLANK[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before = np.empty_like(full)
    before[0] = False
    before[1:] = full[:-1]
    before[cuts] = False
    after = np.empty_like(full)
    after[-1] = False
    after[:-1] = full[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gram_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window inside one text, and the window's first word number."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    h = words[at].copy()
    for k in range(1, n):
        h = mix(h * U(BASE)) + words[at + k]
    return mix(h), at


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Integer sums of values by text number."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    edges = np.searchsorted(doc, np.arange(n + 1))
    return sums[edges[1:]] - sums[edges[:-1]]
