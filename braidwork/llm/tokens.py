"""Token ids of whole texts, and their Simple-8b file format.

Ids come from a tokenizers file whose pre-tokenizer is the byte-level one: a blank followed by a non-blank always
starts a new piece there, so that a text can be cut before such blanks, each distinct unit be encoded once, and the
ids be put together again. Texts with the file's added tokens in them are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.llm.common import needed
from braidwork.llm.kernels import U, blocks, same_spans, span_hashes

#: Bytes before which a text may be cut, by the byte before. A blank starts a new piece unless a blank follows it
#: (bytes that may begin a wider blank count as blanks); so do closing marks and line ends after a letter or mark,
#: and letters after a single line end. Cuts are free to be missed, never to be wrong.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def _unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        here, before = data[1:], data[:-1]
        cut[1:-1] = _MARK[here] & _LETTER[before] | (here == 10) & _SOLID[before] & (before < 128)
        cut[1:-2] |= (here[:-1] == 32) & _SOLID[data[2:]]
        # a line end alone before a letter; of a longer run the last blank is a piece of its own
        cut[2:-1] |= _LETTER[data[2:]] & (data[1:-1] == 10) & _SOLID[data[:-2]] & (data[:-2] < 128)
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of texts by a tokenizers file.

    Knows about `most` units at most: sorted hashes, with each unit's bytes and ids in two arrays. A unit's ids are
    used again only where its bytes are the ones that were encoded; a slice with two units of one hash is encoded
    whole. When it is full, units that were not met again go.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.hashes, self.met = np.zeros(0, U), np.zeros(0, bool)
        self.ids, self.raw = Pool("<u4"), Pool(np.uint8)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        raw, found = data.tobytes(), []
        units = [raw[a : a + n].decode() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        for at in range(0, len(units), 20_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(units[at : at + 20_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), "<u4", int(sizes.sum()))
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.searchsorted(self.hashes, hashes) + np.arange(len(hashes))
        rest = np.ones(len(self.hashes) + len(hashes), bool)
        rest[place] = False
        self.hashes, self.met = _merged(self.hashes, hashes, place, rest), _merged(self.met, False, place, rest)
        self.ids.add(flat, sizes, place, rest)
        self.raw.add(data[np.repeat(start, size) + step], size, place, rest)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.fromiter((i for ids in found for i in ids), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            return self._whole(raw, offsets)
        start = _unit_starts(data, offsets)
        size = np.append(start[1:], len(data)) - start
        hashes, first, which = np.unique(span_hashes(data, start, start + size), return_index=True, return_inverse=True)
        if not same_spans(data, start, size, data, start[first][which], size[first][which]):
            return self._whole(raw, offsets)
        if len(self.hashes) > self.most:
            kept = np.flatnonzero(self.met)[: self.most // 2]
            self.hashes, self.met = self.hashes[kept], np.zeros(len(kept), bool)
            self.ids.keep(kept)
            self.raw.keep(kept)
        at = np.searchsorted(self.hashes, hashes)
        known = np.flatnonzero(np.append(self.hashes, U(0))[at] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        known = known[at[known] < len(self.hashes)]
        told, unit = at[known], first[known]
        if not same_spans(data, start[unit], size[unit], self.raw.flat, self.raw.starts[told], self.raw.sizes[told]):
            return self._whole(raw, offsets)
        self.met[told] = True
        new = np.ones(len(hashes), bool)
        new[known] = False
        if new.any():
            self._learn(hashes[new], data, start[first[new]], size[first[new]])
            at = np.searchsorted(self.hashes, hashes)
        ids, total = self.ids.take(at[which])
        return ids, np.diff(total[np.searchsorted(start, offsets)])


def _merged(old: np.ndarray, new, place: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.empty(len(rest), old.dtype)
    out[place], out[rest] = new, old
    return out


class Pool:
    """Runs of numbers in one array that grows: run k is flat[starts[k]:starts[k] + sizes[k]]."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.starts = self.sizes = np.zeros(0, np.int32)

    def add(self, flat: np.ndarray, sizes: np.ndarray, place: np.ndarray, rest: np.ndarray) -> None:
        """New runs that get the numbers `place`; the others keep their order in `rest`."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = _merged(self.starts, self.used + np.cumsum(sizes) - sizes, place, rest)
        self.sizes = _merged(self.sizes, sizes, place, rest)
        self.used += len(flat)

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs in a row, and where each begins and the last ends."""
        sizes = self.sizes[runs].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[runs] - total[:-1], sizes) + np.arange(total[-1])], total

    def keep(self, runs: np.ndarray) -> None:
        flat, total = self.take(runs)
        self.starts, self.sizes = total[:-1].astype(np.int32), np.diff(total).astype(np.int32)
        self.flat, self.used = np.concatenate([flat, np.zeros(1 << 16, flat.dtype)]), len(flat)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, units: int = 700_000) -> Encoder:
    """One encoder per worker process, file and number of units kept: later tasks find their units known."""
    if (path, units) not in _encoders:
        _encoders.clear()
        _encoders[path, units] = Encoder(path, units)
    return _encoders[path, units]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text", units: int = 700_000, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with all ids in a row, the end id after each text, and each text's number of ids with it; null texts count as empty."""
    for part, data, offsets in blocks(batches, text, most):
        ids, sizes = encoder(path, units).encode(data, offsets)
        yield part, np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def _binaries(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Slices of ids between edges as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids (binary): each text's ids with end_id, cut only where longer than capacity.

    The first piece takes the remainder, all others are full. Null and empty texts are the end id alone; repeated
    rows give repeated pieces; a null key is carried.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, sizes in encoded(batches, path, end_id, text, 500_000, 1 << 19):
            # a longer text's first piece takes what full pieces leave over
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = sizes - (pieces - 1) * capacity
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            keys = part.column(part.schema.get_field_index(key)).take(pa.array(row, pa.int64()))
            columns = [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), _binaries(ids, np.concatenate([[0], np.cumsum(length)]))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


# Simple-8b: 4 bits of selector over 60 bits of payload. By selector, from 1: values per word and bits per value.
# Selector 0 is the escape: the payload is an index into the list of values that need over 60 bits.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120])
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
BLOCK = 512
MAGIC = b"S8B1"
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """ids (unsigned 64-bit) as one segment: header, each block's first word number, words, escaped values.

    Selectors in order hold more and narrower values, so a word that fits one fits all before it: each block's next
    word is found by widening as long as it fits, for all blocks at once.
    """
    ids = np.ascontiguousarray(ids, dtype=U)
    n = len(ids)
    blocks_ = -(-n // BLOCK)
    most = int(ids.max()) if n else 0
    large = ids >> U(60) > 0 if most >> 60 else np.zeros(n, bool)
    if most < 1 << 16:
        bits = _BITS[ids]
    else:  # values from 2**53 round up in a double: one bit more does no harm below the escape
        bits = (np.minimum(np.frexp(np.where(large, U(0), ids).astype(np.float64))[1], 60) + large * 61).astype(np.uint8)
    top = int(bits.max()) if n else 0
    wide: dict[int, np.ndarray] = {}
    at = np.arange(blocks_, dtype=np.int64) * BLOCK
    end = np.minimum(at + BLOCK, n)
    owner = np.arange(blocks_)
    where, which, block = [], [], []
    while len(at):
        pick = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for s in range(1, len(COUNTS)):
            if not len(live):
                break
            width = int(WIDTHS[s])
            if top > width:
                if width not in wide:
                    wide[width] = np.concatenate([[0], np.cumsum(bits > width, dtype=np.int32)])
                w, a = wide[width], at[live]
                live = live[w[np.minimum(a + COUNTS[s], end[live])] == w[a]]
            pick[live] = s
        where.append(at)
        which.append(pick)
        block.append(owner)
        at = at + COUNTS[pick]
        go = at < end
        at, end, owner = at[go], end[go], owner[go]
    if where:
        start, sel, own = np.concatenate(where), np.concatenate(which), np.concatenate(block)
        order = np.argsort(start, kind="stable")
        start, sel, own = start[order], sel[order], own[order]
    else:
        start = sel = own = np.zeros(0, np.int64)
    words = np.zeros(len(start), U)
    stop = np.minimum((start // BLOCK + 1) * BLOCK, n)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(sel == s)
        if not len(rows) or not width:
            continue
        word = np.zeros(len(rows), U)
        for j in range(count):
            p = start[rows] + j
            good = p < stop[rows]
            word[good] |= ids[p[good]] << U(j * width) if s else np.where(large[p[good]], U(0), ids[p[good]])
        words[rows] = word
    words |= (sel + 1).astype(U) << U(60)
    escaped = np.flatnonzero(large[start]) if n else np.zeros(0, np.int64)
    words[escaped] = np.arange(len(escaped), dtype=U)
    firsts = np.searchsorted(own, np.arange(blocks_)).astype("<u4")
    head = np.array([BLOCK, n, len(words), len(escaped)], "<u8").tobytes()
    return MAGIC + head + firsts.tobytes() + words.astype("<u8").tobytes() + ids[start[escaped]].astype("<u8").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    """The ids of a segment. Every word of a block but its last is full, so all words' places follow from the selectors."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    size, n, n_words, n_escaped = (int(x) for x in np.frombuffer(data, "<u8", 4, 4))
    blocks_ = -(-n // size)
    firsts = np.frombuffer(data, "<u4", blocks_, 36).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, 36 + 4 * blocks_)
    escaped = np.frombuffer(data, "<u8", n_escaped, 36 + 4 * blocks_ + 8 * n_words)
    out = np.zeros(n, U)
    if not n:
        return out
    sel = (words >> U(60)).astype(np.int64)
    payload = words & U((1 << 60) - 1)
    held = np.where(sel > 0, COUNTS[np.maximum(sel - 1, 0)], 1)
    total = np.concatenate([[0], np.cumsum(held)])
    block = np.repeat(np.arange(blocks_), np.diff(np.append(firsts, n_words)))
    start = total[:-1] - total[firsts][block] + block * size
    stop = np.minimum((block + 1) * size, n)
    rows = np.flatnonzero(sel == 0)
    out[start[rows]] = escaped[payload[rows].astype(np.int64)]
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(sel == s + 1)
        if not len(rows) or not width:
            continue
        mask = U((1 << int(width)) - 1)
        for j in range(count):
            p = start[rows] + j
            good = p < stop[rows]
            out[p[good]] = (payload[rows[good]] >> U(j * width)) & mask
    return out


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", units: int = 1_500_000) -> None:
    """Writes every text's ids with end_id to `out`, in ascending key order (null keys first, ties by text hash).

    A file is a Parquet file of segments. A segment holds whole texts: shard, segment, before (ids of its shard
    ahead of it), doc_ids, lengths, and data, the Simple-8b bytes of all its ids. Shards follow one another in key
    order; equal keys are spread by the hash of their text, so one repeated key need not fill one shard.
    """
    schema = f"shard int, segment int, before long, n_ids long, doc_ids array<{docs.schema[key].dataType.simpleString()}>, lengths array<long>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for segment, (part, ids, lengths) in enumerate(encoded(batches, path, end_id, text, units, 1 << 21)):
            keys = part.column(part.schema.get_field_index(key))
            one = pa.array([0, len(lengths)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(one, keys), pa.ListArray.from_arrays(one, pa.array(lengths)), pa.array([pack_ids(ids)], pa.binary())],
                names=["shard", "segment", "before", "n_ids", "doc_ids", "lengths", "data"],
            )
            before += len(ids)

    h = F.xxhash64(text)
    ordered = docs.select(key, text).withColumn("_tie", h).repartitionByRange(F.col(key), F.col("_tie")).sortWithinPartitions(key, "_tie")
    ordered.select(key, text).mapInArrow(run, schema).write.parquet(out)


def read_tokens(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """One row per text of the files in `out`: key, start (ids of all texts before it), n_tokens, ids (binary)."""
    files = spark.read.parquet(out)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    firsts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    files = files.join(needed(firsts, "shards"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(k)[row] for k, c in enumerate(batch.schema.names)}
                lengths = one["lengths"].values.to_numpy()
                edges = np.concatenate([[0], np.cumsum(lengths)])
                ids = unpack_ids(one["data"].as_py()).astype("<u4")
                column = _binaries(ids, edges)
                start = one["first"].as_py() + one["before"].as_py() + edges[:-1]
                yield pa.RecordBatch.from_arrays([one["doc_ids"].values, pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), column], names=[key, "start", "n_tokens", "ids"])

    return files.select("first", "before", "doc_ids", "lengths", "data").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids binary")
