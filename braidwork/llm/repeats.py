"""Repeats across all texts, from an enhanced suffix array: maximal groups of equal byte strings with all occurrences.

A suffix array of the whole corpus would sort every byte. Two strings of `least` bytes that are equal hold the same
anchor at the same place: the 32 bytes of smallest hash, the leftmost of several. So the suffixes whose first `least`
bytes have one anchor are one bucket, and the part of the corpus's suffix array in which neighbours share `least` bytes
is the buckets' arrays side by side. Only anchors that occur twice are looked at; what a bucket holds of a text is the
bytes around the anchor that its strings can reach, and equal surroundings are one entry.

Inside a bucket the array of the suffixes that start at the anchor is sorted once, and those that start a byte further
left follow from it by a stable sort on that byte, as do the lengths that neighbours share. Where the bytes to the left
of an interval differ, the common-prefix intervals are scanned with a stack: those whose occurrences have different
left bytes are maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import needed, written
from braidwork.llm.kernels import BASE, U, blocks, mix, release

#: Bytes of an anchor.
ANCHOR = 32
#: Entries of a bucket at most: a larger one is cut into bands of starts, in the end into single ones.
MOST = 16_384
#: Bytes of text that are hashed at once: what stays in a core's cache.
STEP = 1 << 16
DIVERSE = -1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes from every place on, by doubling. Bytes are compared later; texts made to collide cost time only."""
    h, step, factor = data.astype(U) + U(1), 1, BASE
    while step < ANCHOR:
        h = h[:-step] * U(factor) + h[step:]
        step, factor = step * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
    return mix(h)


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` places the place of its smallest hash, the leftmost of several."""
    value, at, size = h, np.arange(len(h), dtype=np.int32), 1

    def over(shift: int) -> tuple[np.ndarray, np.ndarray]:
        less = value[shift:] < value[:-shift]
        return np.where(less, value[shift:], value[:-shift]), np.where(less, at[shift:], at[:-shift])

    while size * 2 <= width:
        value, at = over(size)
        size *= 2
    if size < width:
        value, at = over(width - size)
    return at


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text's windows of `least` bytes the anchors, in order: text number, hash, place in the text, and the least and most bytes from a window's start to its anchor."""
    parts: list[tuple[np.ndarray, ...]] = []
    n, width = len(data), least - ANCHOR + 1
    for base in range(0, max(n - least + 1, 0), STEP):
        h = _gram_hashes(data[base : min(base + STEP + least - 1, n)])
        at = _leftmost_least(h, width)
        # windows that the end of a text cuts
        ends = offsets[np.searchsorted(offsets, base, side="right") : np.searchsorted(offsets, base + len(at) + least, side="left")]
        edges = np.zeros(len(at) + 1, np.int32)
        np.add.at(edges, np.clip(ends - least + 1 - base, 0, len(at)), 1)
        np.add.at(edges, np.clip(ends - base, 0, len(at)), -1)
        inside = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        if not len(inside):
            continue
        p = at[inside]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(p)]]) - 1
        p = p[first].astype(np.int64)
        starts = inside[first]
        parts.append((np.searchsorted(offsets, starts + base, side="right") - 1, h[p].view(np.int64), p + base, p - inside[last], p - starts))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    doc, h, p, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
    # an anchor whose windows were cut by a step is one
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[first], h[first], p[first] - offsets[doc[first]], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)


def _scan(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """A row per document: key, sha, n_bytes, and its anchors as arrays h, p, lo, hi."""
    rows = docs.select(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            doc, h, p, lo, hi = anchors(data, offsets, least)
            ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, kind)) for c, kind in ((h, pa.int64()), (p, pa.int64()), (lo, pa.int32()), (hi, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets)), *lists], names=["key", "sha", "n_bytes", "h", "p", "lo", "hi"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, sha string, n_bytes long, h array<long>, p array<long>, lo array<int>, hi array<int>")


def _nodes(sha: Column) -> list[Column]:
    """A text's name: two hashes of its digest."""
    return [F.xxhash64(sha).alias("node"), F.xxhash64(sha, F.lit(1)).alias("node2")]


_ENTRY = "h long, entry binary, lo int, hi int, body binary"


def _entries(chosen: DataFrame, least: int, bodies: bool) -> DataFrame:
    """What stands around every anchor of hits, as far as its windows reach: with bodies h, entry, lo, hi, body and who, a hash of text and place; else node, node2, p, entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column("text"), batch.column("hits")
            each = np.asarray(hits.value_lengths()).astype(np.int64)
            h, p, lo, hi = (hits.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "p", "lo", "hi"))
            upto = np.cumsum(each)
            body: list[bytes] = []
            for r, (a, b) in enumerate(zip((upto - each).tolist(), upto.tolist(), strict=True)):
                data = memoryview(texts[r].as_buffer())
                body += [bytes(data[x:y]) for x, y in zip((p[a:b] - hi[a:b]).tolist(), (p[a:b] + least - lo[a:b]).tolist(), strict=True)]
            named = [hashlib.blake2b(d, digest_size=16, salt=b"%d:%d" % (x, y)).digest() for d, x, y in zip(body, lo.tolist(), hi.tolist(), strict=True)]
            entry = pa.array(named, pa.binary())
            node, node2 = (np.repeat(batch.column(c).to_numpy(), each) for c in ("node", "node2"))
            if bodies:
                who = mix(node.view(U) ^ mix(node2.view(U) + p.view(U)))
                yield pa.RecordBatch.from_arrays([pa.array(h), entry, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(body, pa.binary()), pa.array(who.view(np.int64))], names=["h", "entry", "lo", "hi", "body", "who"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node2), pa.array(p), entry], names=["node", "node2", "p", "entry"])
        release()

    return chosen.select("node", "node2", F.col("text").cast("binary").alias("text"), "hits").mapInArrow(run, f"{_ENTRY}, who long" if bodies else "node long, node2 long, p long, entry binary")


def _banded(entries: DataFrame, width: int, least: int) -> DataFrame:
    """Entries of buckets that are too large, dealt anew by bands of `width` starts: the members of a new bucket share all bytes that the windows of its band have in common. was: the entry they were cut from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes, int, int, bytes, bool, bytes]] = []
            for h, entry, lo, hi, body, twin in zip(*(batch.column(c).to_pylist() for c in ("h", "entry", "lo", "hi", "body", "twin")), strict=True):
                for low in range(lo // width * width, hi + 1, width):
                    high = low + width - 1
                    a, b = max(lo, low), min(hi, high)
                    common, piece = body[hi - low : hi + least - high], body[hi - b : hi - a + least]
                    key = int.from_bytes(hashlib.blake2b(f"{h}:{low}:".encode() + common, digest_size=8).digest(), "little", signed=True)
                    out.append((key, hashlib.blake2b(f"{a}:{b}:".encode() + piece, digest_size=16).digest(), a, b, piece, twin, entry))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "entry", "lo", "hi", "body", "twin", "was"])

    return entries.select("h", "entry", "lo", "hi", "body", "twin").mapInArrow(run, f"{_ENTRY}, twin boolean, was binary")


class _Buckets:
    """The entries of whole buckets as arrays, in order of bucket. An entry that several places have stands twice, so that it is a repeat of itself."""

    def __init__(self, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, bodies: list[bytes], twin: np.ndarray, least: int):
        self.row = np.repeat(np.arange(len(bucket)), 1 + twin)
        rights = [b[k:] for b, k in zip(bodies, hi.tolist(), strict=True)]
        places = bucket.tolist()
        order = np.array(sorted(self.row.tolist(), key=lambda i: (places[i], rights[i])), np.int64)
        self.row, self.least = order, least
        n, reach = len(bodies), int(hi.max(initial=0))
        size = np.array([len(r) for r in rights], np.int64)
        right = np.zeros((n, int(size.max(initial=0)) + 1), np.uint8)
        left = np.zeros((n, reach + 1), np.uint8)
        for i, (r, b, k) in enumerate(zip(rights, bodies, hi.tolist(), strict=True)):
            right[i, : len(r)] = np.frombuffer(r, np.uint8)
            left[i, :k] = np.frombuffer(b, np.uint8, k)[::-1]
        self.lo, self.hi, self.left = lo[order], hi[order], left[order]
        same = right[order[1:]] == right[order[:-1]]
        alike = np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))
        alike = np.minimum(alike, np.minimum(size[order[1:]], size[order[:-1]]))
        self.first = np.concatenate([[-1], np.where(bucket[order[1:]] == bucket[order[:-1]], alike, -1)]) if len(order) else np.zeros(0, np.int64)

    def clusters(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number d of bytes to the left of the anchor the suffixes from there, as far as they have a neighbour that shares `least` bytes and not all share the byte to the left, too: d, entries in order of suffix, how much each shares with the one before (0: nothing here), and the left bytes, DIVERSE where the entry ends."""
        at, shared = np.arange(len(self.first)), self.first.astype(np.int64)
        d = 0
        while len(at):
            stays = self.hi[at] > d
            byte = np.where(stays, self.left[at, min(d, self.left.shape[1] - 1)].astype(np.int64), DIVERSE)
            yield from self._diverse(d, at, shared, byte)
            # one byte further left: entries that end are gone, the others fall apart by that byte
            group = np.cumsum(shared < 0)
            alike = np.concatenate([[False], (group[1:] == group[:-1]) & (byte[1:] == byte[:-1]) & stays[1:] & stays[:-1]])
            if np.array_equal(alike, shared >= 0) and stays.all():
                shared = np.where(alike, shared + 1, -1)
            else:
                kept = np.flatnonzero(stays)
                kept = kept[np.argsort(group[kept] * 256 + byte[kept], kind="stable")]
                old = shared
                both = np.flatnonzero((group[kept[1:]] == group[kept[:-1]]) & (byte[kept[1:]] == byte[kept[:-1]]))
                shared = np.full(len(kept), -1, np.int64)
                if len(both):
                    ends = np.stack([kept[both] + 1, kept[both + 1] + 1], axis=1).ravel()
                    shared[both + 1] = np.minimum.reduceat(np.append(old, 0), ends)[::2] + 1
                at = at[kept]
            alone = (shared < 0) & np.append(shared[1:] < 0, True)
            at, shared = at[~alone], shared[~alone]
            d += 1

    def _diverse(self, d: int, at: np.ndarray, shared: np.ndarray, byte: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        joined = shared >= self.least
        if not joined.any():
            return
        inside = joined | np.append(joined[1:], False)
        group = np.cumsum(~joined)[inside]
        at, byte, joined, shared = at[inside], byte[inside], joined[inside], shared[inside]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        mixed = (np.minimum.reduceat(byte, first) == DIVERSE) | (np.minimum.reduceat(byte, first) != np.maximum.reduceat(byte, first))
        take = np.repeat(mixed, np.diff(np.append(first, len(group))))
        if take.any():
            yield d, at[take], np.where(joined, shared, 0)[take], byte[take]


def interval_tree(shared: list[int], left: list[int]) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Stack scan over suffixes in order: shared[i] is the length of the prefix that i shares with i - 1 (0: a new tree), left[i] the byte before it.

    Gives for every suffix the smallest maximal repeat that it belongs to (-1: none), and the repeats as (length,
    number of suffixes, first suffix, parent). An interval whose suffixes all have one left byte is no repeat of its
    own: the same bytes with that one before them are.
    """
    owner, found = [-1] * len(shared), []
    stack: list[tuple[int, int, int]] = []
    free: list[int] = []  # suffixes without a repeat so far
    loose: list[int] = []  # repeats without a parent so far
    for i in range(1, len(shared) + 1):
        h = shared[i] if i < len(shared) else 0
        start, mark = i - 1, left[i - 1]
        free.append(i - 1)
        while stack and stack[-1][0] > h:
            length, start, inner = stack.pop()
            mark = inner if inner == mark else DIVERSE
            if mark == DIVERSE:
                g = len(found)
                found.append([length, i - start, start, -1])
                while free and free[-1] >= start:
                    owner[free.pop()] = g
                while loose and found[loose[-1]][2] >= start:
                    found[loose.pop()][3] = g
                loose.append(g)
        if h == 0:
            free.clear()
            loose.clear()
        elif stack and stack[-1][0] == h:
            inner = stack[-1][2]
            stack[-1] = (h, stack[-1][1], inner if inner == mark else DIVERSE)
        else:
            stack.append((h, start, mark))
    return owner, [tuple(g) for g in found]


def _repeats(entries: DataFrame, least: int) -> DataFrame:
    """entries (h, entry, lo, hi, body, twin) -> entry, d, length, occurrences, repeat, parent: each entry's starts d bytes left of its anchor, at their smallest repeats."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        h, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "lo", "hi"))
        names = rows.column("entry").to_pylist()
        twin = rows.column("twin").to_numpy(zero_copy_only=False).astype(np.int64)
        held = _Buckets(h, lo, hi, rows.column("body").to_pylist(), twin, least)
        ds, ats, lcps, bytes_ = [], [], [], []
        for d, at, shared, byte in held.clusters():
            ds.append(np.full(len(at), d))
            ats.append(at)
            lcps.append(shared)
            bytes_.append(byte)
        out: list[list] = [[] for _ in range(6)]
        if ds:
            d, row = np.concatenate(ds), held.row[np.concatenate(ats)]
            owner, found = interval_tree(np.concatenate(lcps).tolist(), np.concatenate(bytes_).tolist())
            called = [int.from_bytes(hashlib.blake2b(names[row[s]] + f"{d[s]}:{length}".encode(), digest_size=8).digest(), "little", signed=True) for length, _, s, _ in found]
            mine = np.array(owner)
            some = np.flatnonzero(mine >= 0)
            groups = mine[some].tolist()
            out = [[names[i] for i in row[some].tolist()], d[some].tolist(), [found[g][0] for g in groups], [found[g][1] for g in groups], [called[g] for g in groups], [called[found[g][3]] if found[g][3] >= 0 else None for g in groups]]
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["entry", "d", "length", "occurrences", "repeat", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            other = np.flatnonzero(h != h[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != int(h[0])):
                held.append(batch.slice(0, cut))
                yield work(pa.Table.from_batches(held))
                held = []
            elif cut:
                yield work(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held))
        release()

    rows = entries.select("h", "entry", "lo", "hi", "body", "twin").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "entry binary, d int, length int, occurrences long, repeat long, parent long")


def _gathered(rows: DataFrame) -> DataFrame:
    """Entries of equal surroundings as one, counted in each task first: twin tells whether they come from more than one place."""
    return rows.groupBy("h", "entry", "lo", "hi").agg(F.first("body").alias("body"), (F.bool_or("twin") | (F.min("who") != F.max("who"))).alias("twin"))


def maximal_repeats(docs: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text", most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The scan of the documents, the texts with anchors that occur twice, places (node, node2, p, entry) of entries in texts, and repeats (entry, d, length, occurrences, repeat, parent).

    An occurrence starts d bytes before its place and has `length` bytes; it is named at the smallest repeat it belongs
    to, and is one of the repeat's parents, too. Surroundings that several places share are one entry, which counts as
    two occurrences. A repeat longer than its anchor's windows reach comes in pieces that overlap, one for each anchor.
    """
    seen = written(_scan(docs, key, text, least), "scan")
    named = seen.filter(F.size("h") > 0).select("key", "sha", *_nodes(F.col("sha")), "h", "p", "lo", "hi")
    classes = written(named.groupBy("node", "node2").agg(F.min("key").alias("first"), F.count("*").alias("copies")), "classes")
    each = named.select("node", "node2", F.explode(F.arrays_zip("h", "p", "lo", "hi")).alias("a")).select("node", "node2", "a.*")
    who = F.xxhash64("node", "node2", "p")
    common = written(each.groupBy("h").agg(F.min(who).alias("a"), F.max(who).alias("b")).filter("a <> b").select("h"), "common")
    hits = each.join(common, "h").groupBy("node", "node2").agg(F.collect_set(F.struct("h", "p", "lo", "hi")).alias("hits"))
    wanted = written(classes.join(hits, ["node", "node2"]), "wanted")
    keys = needed(wanted.select(F.col("first").alias("key")).filter("key IS NOT NULL").distinct(), "keys")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = rows.join(keys, "key", "left_semi").join(wanted.withColumnRenamed("first", "key"), "key")
    if not wanted.filter("first IS NULL").isEmpty():  # texts that no key names
        nameless = rows.filter("key IS NULL").drop("key")
        sha = F.sha2("text", 256)
        nameless = nameless.select("text", *_nodes(sha)).join(wanted.filter("first IS NULL").select("node", "node2", F.col("first").alias("key"), "copies", "hits"), ["node", "node2"])
        chosen = chosen.unionByName(nameless.select(chosen.columns))
    own = F.sha2("text", 256)
    chosen = chosen.filter((F.xxhash64(own) == F.col("node")) & (F.xxhash64(own, F.lit(1)) == F.col("node2")))
    chosen = written(chosen.select("node", "node2", "copies", "text", "hits"), "texts")
    entries = written(_gathered(_entries(chosen, least, bodies=True).withColumn("twin", F.lit(False))), "entries")
    parts: list[DataFrame] = []
    cuts: list[DataFrame] = []
    for width in (22, 3, 1):
        large = entries.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("h")
        large = needed(large, "large")
        if large.isEmpty():
            break
        parts.append(entries.join(large, "h", "left_anti"))
        pieces = _banded(entries.join(large, "h", "left_semi"), width, least)
        cuts.append(written(pieces.select("was", F.col("entry").alias("now")).distinct(), "cuts"))
        entries = written(_gathered(pieces.withColumn("who", F.xxhash64("was"))), "entries")
    parts.append(entries)
    found = written(_repeats(reduce(DataFrame.unionByName, parts), least), "repeats")
    for cut in reversed(cuts):  # pieces under the names of what they were cut from
        whole = found.join(cut, found["entry"] == cut["now"]).select(F.col("was").alias("entry"), "d", "length", "occurrences", "repeat", "parent")
        rest = found.join(cut.select(F.col("now").alias("entry")), "entry", "left_anti")
        found = written(whole.unionByName(rest), "repeats")
    return seen, chosen, _entries(chosen, least, bodies=False), found


def remove_repeats(docs: DataFrame, least: int = 200, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256. Every byte that some maximal repeat of at least `least` bytes covers goes, in every occurrence.

    Texts are UTF-8 bytes, null is empty; a repeat may start or end inside a character. Equal texts of `least` bytes
    or more go whole, also those of rows that share a key or have none; shorter texts stay whatever they repeat.
    Overlapping occurrences count, in one text too. Very long texts are read in steps, and no size of group is left
    out. An empty table gives an empty one; further columns are not read.
    """
    seen, chosen, places, found = maximal_repeats(docs, least, key, text, most)
    reach = written(found.groupBy("entry").agg(F.max("d").alias("before"), F.max(F.col("length") - F.col("d")).alias("behind")), "reach")
    places = written(places, "places")
    # entries with more than a thousandth of all places: fewer than a thousand, so the join with them is a broadcast
    often = places.groupBy("entry").agg(F.count("*").alias("c")).filter(F.col("c") > max(1000, places.count() // 1000)).select("entry")
    hot = F.broadcast(written(reach.join(often, "entry", "left_semi"), "hot"))
    met = places.join(hot, "entry").unionByName(places.join(hot, "entry", "left_anti").join(reach, "entry"))
    covers = met.select("node", "node2", (F.col("p") - F.col("before")).alias("a"), (F.col("p") + F.col("behind")).alias("b"))
    spans = covers.groupBy("node", "node2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    # of texts that stand once: those that stand more often go whole
    cut = written(chosen.filter("copies = 1").select("node", "node2", "text").join(spans, ["node", "node2"]), "covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                data, kept, upto, removed, n = memoryview(batch.column("text")[r].as_buffer()), hashlib.sha256(), 0, 0, 0
                for span in batch.column("spans")[r].as_py():
                    a, b = span["a"], span["b"]
                    if a > upto or not n:
                        kept.update(data[upto:a])
                        n, upto = n + 1, a
                    removed += max(b - upto, 0)
                    upto = max(upto, b)
                kept.update(data[upto:])
                rows.append((removed, n, kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("node2"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["node", "node2", "removed", "spans", "kept"])
        release()

    done = cut.select("node", "node2", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(run, "node long, node2 long, removed long, spans long, kept string")
    rows = seen.select("key", "sha", "n_bytes", *_nodes(F.col("sha")))
    counts = rows.groupBy("node", "node2").agg(F.count("*").alias("copies")).filter("copies > 1").select("node", "node2", F.lit(True).alias("again"))
    marked = counts.join(done, ["node", "node2"], "full")
    joined = rows.join(marked, ["node", "node2"], "left")
    whole = F.coalesce(F.col("again"), F.lit(False)) & (F.col("n_bytes") >= least)
    return joined.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
