"""Exact n-gram Jaccard join by signature trees, with its connected components.

Texts with equal sets are one class. Classes meet where the prefixes of their sets (by one order of all shingles,
common ones last) share a shingle; a linked pair always does. In each such group a tree over the classes holds
OR-combined bitmaps and size ranges, and a dual traversal drops pairs of nodes whose largest possible overlap is too
small. What is left is compared set by set.

Groups first link to one member each, their hub: the one that shares most of its prefix. Groups of one hub are then
put together, so that texts which share many shingles meet once; a group that is one component by then needs no pair.
So a large group of near copies costs one comparison per member, while a link between different components is never
lost. From a tree come the rows that have a partner; those meet once more with their sets, are compared there, and only
links that join two components come out, fewer than the rows that went in, however many pairs are alike.

A group that still holds several components is compared pair by pair. Beyond CELL members it is dealt out in pairs of
blocks, and a member goes to as many cells as there are blocks: of a group of g members that do not link to its hub
about g * g / CELL rows are sent. This part grows with the square of such a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import needed, written
from braidwork.llm.kernels import LOWER, U, blocks, gram_hashes, mix, release, span_hashes, word_spans

#: Shingles in more than HEAVY_FROM prefixes go last in the order; the HEAVY_MOST most frequent of them at most, so that their list stays small. The order affects balance only, never the result.
HEAVY_FROM, HEAVY_MOST = 24, 65_536
#: Rows and shingles of the largest group treated as one tree; larger ones are dealt out in cells of pairs of blocks, of so many blocks at most: a row is sent to as many cells as there are blocks.
CELL, CELL_ITEMS, BLOCKS = 128, 1 << 20, 256
FAN = 8
#: Bits of a bitmap for each shingle of its set.
SPARSE = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text in a row, and how many each has. Texts of 1 to k-1 words have one, of all their words."""
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    n_words = np.bincount(doc, minlength=n)
    h, at = gram_hashes(words, doc, k)
    hashes, owner = [h], [doc[at]]
    for short in range(1, k):
        h, at = gram_hashes(words, doc, short)
        good = n_words[doc[at]] == short
        hashes.append(mix(h[good] ^ U(short)))
        owner.append(doc[at[good]])
    h, own = np.concatenate(hashes), np.concatenate(owner)
    if any(len(x) for x in owner[1:]):
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    edges = np.searchsorted(own, np.arange(n + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else h), np.array([len(s) for s in sets], np.int64)


def digests(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(salt)), dtype=U)])
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(U)).view(np.int64))
    return out[0], out[1]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(h: np.ndarray, sizes: np.ndarray, percent: int, heavy: np.ndarray) -> list[np.ndarray]:
    """The first shingles of each set: by hash, heavy ones last."""
    late = np.zeros(len(h), bool)
    if len(heavy):
        late = heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h
    out, at = [], 0
    for n in sizes.tolist():
        mine, last = h[at : at + n], late[at : at + n]
        p = prefix_size(n, percent) if n else 0
        first = mine[~last][:p]
        out.append(first if len(first) == p else np.concatenate([first, mine[last][: p - len(first)]]))
        at += n
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(edges, pa.array(flat))


def _bitmaps(h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A bitmap of each set, SPARSE bits per shingle at least: a power of two, so that larger ones fold onto smaller ones."""
    out, at = [], 0
    for n in sizes.tolist():
        m = 64 * SPARSE << max(0, (max(n, 1) - 1) // 64).bit_length()
        bits = np.zeros(m, np.uint8)
        bits[(h[at : at + n] & U(m - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
        at += n
    return pa.array(out, pa.binary())


def _scan(docs: DataFrame, key: str, text: str, k: int, percent: int, want: str, heavy: np.ndarray | None = None) -> DataFrame:
    """One row per text from one pass over whole texts: key, node (its set's hash), node2, n, and what is wanted of the set."""
    kind = docs.schema[key].dataType.simpleString()
    extra = {"prefix": ", prefix array<long>", "routes": ", prefix array<long>, bitmap binary", "set": ", items binary"}[want]
    heavy = np.zeros(0, U) if heavy is None else heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, text, 1 << 19):
            h, sizes = shingle_sets(data, offsets, k)
            node, node2 = digests(h, sizes)
            columns = [part.column(part.schema.get_field_index(key)), pa.array(node), pa.array(node2), pa.array(sizes)]
            names = [key, "node", "node2", "n"]
            if want == "set":
                edges = np.concatenate([[0], np.cumsum(sizes)])
                columns.append(pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
                names.append("items")
            else:
                columns.append(_lists(_prefixes(h, sizes, percent, heavy)))
                names.append("prefix")
            if want == "routes":
                columns.append(_bitmaps(h, sizes))
                names.append("bitmap")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, node long, node2 long, n long{extra}")


def _size_fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


class Bits:
    """Bitmaps of many rows as one array of 64-bit words."""

    def __init__(self, column: pa.Array):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.words = np.frombuffer(column.buffers()[2], np.uint8)[: ends[-1]].view(U) if len(column) and ends[-1] else np.zeros(0, U)
        self.start, self.size = ends[:-1] // 8, np.diff(ends) // 8

    def at(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The rows' bitmaps folded to size words."""
        out = np.zeros((len(rows), size), U)
        for fold in np.unique(self.size[rows] // size) if len(rows) else []:
            mine = np.flatnonzero(self.size[rows] // size == fold)
            for j in range(int(fold)):
                out[mine] |= self.words[self.start[rows[mine], None] + j * size + np.arange(size)]
        return out


def _possible(n_a, n_b, bits_a, bits_b, percent: int, ones_a=None, ones_b=None, low_a=None, low_b=None) -> np.ndarray:
    """False where no set under a can link with one under b: too many shingles of one have no bit in the other. n: largest sizes, low: smallest, ones: smallest bit counts."""
    low_a, low_b = (n_a if low_a is None else low_a), (n_b if low_b is None else low_b)
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
    ones_a = np.bitwise_count(bits_a).sum(axis=1, dtype=np.int64) if ones_a is None else ones_a
    ones_b = np.bitwise_count(bits_b).sum(axis=1, dtype=np.int64) if ones_b is None else ones_b
    far_a = (100 + percent) * (ones_a - shared) > 100 * n_a - percent * low_b
    far_b = (100 + percent) * (ones_b - shared) > 100 * n_b - percent * low_a
    return ~(far_a | far_b) & (100 * n_a >= percent * low_b) & (100 * n_b >= percent * low_a)


def tree_pairs(n: np.ndarray, group: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (by place) of different groups that may link, by dual traversal of a signature tree over rows in order of size."""
    order = np.argsort(n, kind="stable")
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [(bits[order], n[order], n[order], ones[order], group[order], np.zeros(len(n), bool))]
    while len(levels[-1][1]) > 1:
        b, lo, hi, one, g, mixed = levels[-1]
        at = np.arange(0, len(lo), FAN)
        g_lo, g_hi = np.minimum.reduceat(g, at), np.maximum.reduceat(g, at)
        levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(one, at), g_lo, np.logical_or.reduceat(mixed, at) | (g_lo != g_hi)))
    x = y = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        b, lo, hi, one, g, mixed = levels[depth]
        kept_x, kept_y = [], []
        step = max(1, (1 << 21) // (FAN * FAN * b.shape[1]))
        for at in range(0, len(x), step):
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            cx, cy = (x[at : at + step, None] * FAN + i).ravel(), (y[at : at + step, None] * FAN + j).ravel()
            good = (cx < len(lo)) & (cy < len(lo)) & (cx <= cy if depth else cx < cy)
            cx, cy = cx[good], cy[good]
            good = ~((g[cx] == g[cy]) & ~mixed[cx] & ~mixed[cy])
            cx, cy = cx[good], cy[good]
            good = _possible(hi[cx], hi[cy], b[cx], b[cy], percent, one[cx], one[cy], lo[cx], lo[cy])
            kept_x.append(cx[good])
            kept_y.append(cy[good])
        x, y = np.concatenate(kept_x), np.concatenate(kept_y)
        if not len(x):
            break
    return (order[x], order[y]) if len(n) > 1 else (np.zeros(0, np.int64),) * 2


def group_pairs(cell: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: Bits, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs inside each run of equal cell numbers. Runs of up to FAN rows are single leaves and are done together."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
    length = np.diff(edges)
    small = np.repeat(length <= FAN, length)
    a, b = [], []
    for d in range(1, FAN):
        i = np.flatnonzero(small[:-d] & (cell[:-d] == cell[d:]))
        i = i[(comp[i] != comp[i + d]) & (100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d]))]
        a.append(i)
        b.append(i + d)
    x, y = np.concatenate(a), np.concatenate(b)
    size = np.minimum(bits.size[x], bits.size[y])
    out_x, out_y = [], []
    for w in np.unique(size):
        rows = np.flatnonzero(size == w)
        for at in range(0, len(rows), max(1, (1 << 21) // int(w))):
            r = rows[at : at + max(1, (1 << 21) // int(w))]
            good = r[_possible(n[x[r]], n[y[r]], bits.at(x[r], int(w)), bits.at(y[r], int(w)), percent)]
            out_x.append(x[good])
            out_y.append(y[good])
    for s, e in zip(edges[:-1][length > FAN], edges[1:][length > FAN], strict=True):
        rows = np.arange(s, e)
        for w in np.unique(bits.size[rows]):
            # linked sets differ by less than a factor of two: their bitmaps are of one size or of the next
            mine = rows[(bits.size[rows] == w) | (bits.size[rows] == 2 * w) & (n[rows] * percent * SPARSE <= 64 * w * 100)]
            if len(mine) > 1:
                i, j = tree_pairs(n[mine], comp[mine], bits.at(mine, int(w)), percent)
                out_x.append(mine[i])
                out_y.append(mine[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_x]), np.concatenate([none, *out_y])


class Met:
    """Components that were joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        up = self.up
        while (p := up.get(c, c)) != c:
            up[c] = c = up.get(p, p)
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(x: np.ndarray, y: np.ndarray, comp: np.ndarray, items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int, met: Met, most: int = 1 << 19) -> tuple[list[int], list[int]]:
    """Of the pairs (x, y) of rows, those that are linked and join two components that met none before; others need no comparison. Row r holds the shingles items[starts[r]:starts[r] + sizes[r]]."""
    if not len(x):
        return [], []
    used = np.unique(np.concatenate([x, y]))
    size = sizes[used]
    total = np.concatenate([[0], np.cumsum(size)])
    names, dense = np.unique(items[np.repeat(starts[used] - total[:-1], size) + np.arange(total[-1])], return_inverse=True)
    at, mark = dict(zip(used.tolist(), range(len(used)), strict=True)), np.zeros(len(names), bool)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    out_a, out_b = [], []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a = int(x[s])
        own, partners = int(comp[a]), y[s:e].tolist()
        mine = dense[total[at[a]] : total[at[a] + 1]]
        mark[mine] = True
        while partners:
            here = met.root(own)
            chosen, held, k = [], 0, 0
            for k, b in enumerate(partners, 1):
                if met.root(int(comp[b])) != here:
                    chosen.append(b)
                    held += int(sizes[b])
                    if held > most:
                        break
            partners = partners[k:]
            if chosen:
                parts = [dense[total[at[b]] : total[at[b] + 1]] for b in chosen]
                both = np.add.reduceat(mark[np.concatenate(parts)], np.cumsum([0] + [len(p) for p in parts[:-1]]), dtype=np.int64)
                for b in np.array(chosen)[100 * both >= percent * (len(mine) + sizes[chosen] - both)].tolist():
                    if met.join(own, int(comp[b])):
                        out_a.append(a)
                        out_b.append(b)
        mark[mine] = False
    return out_a, out_b


def _by_cell(rows: DataFrame, work: Callable[[dict[str, pa.Array], Met], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs work on whole cells: rows (cell, node, n, comp, ...) dealt by cell, in order of cell, n and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            return work({c: table.column(c).chunk(0) if table.column(c).num_chunks else table.column(c).combine_chunks() for c in table.column_names}, met)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            last = int(np.searchsorted(cell != cell[-1], False)) if (cell == cell[-1]).all() else int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            whole = held + ([batch.slice(0, last)] if last else [])
            if last or (held and held[-1].column(0)[0].as_py() != int(cell[0])):
                if whole:
                    yield done(whole)
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield done(held)
        release()

    return rows.repartition("cell").sortWithinPartitions("cell", "n", "node").mapInArrow(run, schema)


def _tree_members(rows: DataFrame, percent: int) -> DataFrame:
    """rows (cell, node, n, comp, bitmap) -> those (without bitmap) that the tree of their cell pairs with a row of another component."""

    def work(col: dict[str, pa.Array], met: Met) -> pa.RecordBatch:
        x, y = group_pairs(col["cell"].to_numpy(), col["n"].to_numpy(), col["comp"].to_numpy(), Bits(col["bitmap"]), percent)
        keep = pa.array(np.union1d(x, y), pa.int64())
        names = ["cell", "node", "n", "comp"]
        return pa.RecordBatch.from_arrays([col[c].take(keep) for c in names], names=names)

    return _by_cell(rows.select("cell", "node", "n", "comp", "bitmap"), work, "cell long, node long, n long, comp long")


def _tree_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows (cell, node, n, comp, items) -> links a, b that join components, fewer than the rows of their cells."""

    def work(col: dict[str, pa.Array], met: Met) -> pa.RecordBatch:
        node, n, comp = (col[c].to_numpy() for c in ("node", "n", "comp"))
        ends = np.frombuffer(col["items"].buffers()[1], np.int32)[col["items"].offset :][: len(node) + 1].astype(np.int64) // 8
        items = np.frombuffer(col["items"].buffers()[2], U)
        x, y = group_pairs(col["cell"].to_numpy(), n, comp, Bits(_bitmaps(items[ends[0] : ends[-1]], n)), percent)
        a, b = spanning_links(x, y, comp, items, ends[:-1], n, percent, met)
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], names=["a", "b"])

    return _by_cell(rows.select("cell", "node", "n", "comp", "items"), work, "a long, b long")


def _bit_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, n_a, bits_a, b, n_b, bits_b) that may link by their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            a, b = Bits(col["bits_a"]), Bits(col["bits_b"])
            n_a, n_b = col["n_a"].to_numpy(), col["n_b"].to_numpy()
            size, good = np.minimum(a.size, b.size), np.zeros(len(n_a), bool)
            for w in np.unique(size):
                r = np.flatnonzero(size == w)
                good[r] = _possible(n_a[r], n_b[r], a.at(r, int(w)), b.at(r, int(w)), percent)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([col["a"].take(keep), col["b"].take(keep)], names=["a", "b"])

    return pairs.select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """node, items: the whole sets of the given nodes, made again from one text of each class."""
    who = written(nodes.distinct().join(classes.select("node", "first"), "node"), "wanted")
    keys = needed(who.select(F.col("first").alias(key)).filter(F.col(key).isNotNull()).distinct(), "keys")
    rows = docs.select(key, text)
    chosen = rows.join(keys, key, "left_semi")
    if not who.filter(F.col("first").isNull()).isEmpty():  # classes that no key names
        chosen = chosen.unionByName(rows.filter(F.col(key).isNull()))
    sets = _scan(chosen, key, text, k, percent, "set")
    return written(sets.join(who.select("node").distinct(), "node", "left_semi").select("node", "items").dropDuplicates(["node"]), "sets")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really are that similar, compared element by element."""
    pairs = written(pairs, "candidates")
    n_pairs = pairs.count()
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, classes, key, text, k, percent)
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), U) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(r)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
        release()

    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").coalesce(1 + n_pairs // 500), "links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over links (a, b); nodes without links are absent.

    Every round takes the smallest label among neighbours and then the label's own label; each round is a written
    table, so lost executors cost one round. Labels are broadcast while their counted rows allow it.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    n = edges.count()
    parts = 1 + n // 200_000
    side = F.broadcast if n <= 200_000 else (lambda df: df)
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(parts), "labels")
    while True:
        near = edges.join(side(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.select("node", F.col("label").alias("old"))
        hop = labels.select(F.col("node").alias("old"), F.col("label").alias("far"))
        step = near.join(side(own), "node").join(side(hop), "old").select("node", F.least("old", "near", "far").alias("label"), "old")
        step = written(step.coalesce(parts), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, percent: int = 85, k: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id, the smallest key reachable by links.

    Two texts link when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles; percent must be over 50,
    since linked sets are taken to differ by less than a factor of two. Null, empty and wordless texts have no shingle,
    link with nothing and are their own component. Repeated rows and equal texts share a component; a null key never
    names one unless its component has no other. Sets are compared by 64-bit hashes of shingles. Empty tables give
    empty ones; other columns are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"percent must be over 50 and at most 100: {percent}")
    seen = written(_scan(docs, key, text, k, percent, "prefix"), "scan")
    classes = written(seen.filter("n > 0").groupBy("node", "node2", "n").agg(F.min(key).alias("first"), F.first("prefix").alias("prefix")), "classes")
    counts = classes.select(F.explode("prefix").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    common = counts.filter(F.col("c") > HEAVY_FROM).orderBy(F.desc("c"), "item").limit(HEAVY_MOST).select("item").toArrow()
    heavy = np.sort(common.column("item").to_numpy().astype(np.int64).view(U))
    routes = _scan(docs, key, text, k, percent, "routes", heavy).filter("n > 0")
    routes = written(routes.select("node", "n", "prefix", "bitmap").dropDuplicates(["node"]), "routes")
    rows = routes.select("node", "n", F.explode("prefix").alias("item"))
    shared = rows.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    rows = written(rows.join(shared, "item").select("item", "node", "n", "df"), "groups")
    # a group's hub is the member that shares the largest part of its prefix: the text that the others were made from
    central = rows.groupBy("node", "n").agg((F.count("*") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).alias("share")).drop("n")
    rows = rows.join(central, "node")
    hubs = rows.groupBy("item").agg(F.max(F.struct("share", "node", "n")).alias("hub"))
    rows = written(rows.drop("share").join(hubs, "item"), "hubs")
    # one comparison per member and group
    star = rows.filter(F.col("node") != F.col("hub.node")).select(F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"), F.col("node").alias("b"), F.col("n").alias("n_b"))
    star = star.filter(_size_fits("n_a", "n_b", percent)).distinct()
    bits = routes.select("node", "bitmap")
    star = star.join(bits.select(F.col("node").alias("a"), F.col("bitmap").alias("bits_a")), "a").join(bits.select(F.col("node").alias("b"), F.col("bitmap").alias("bits_b")), "b")
    links = _linked(_bit_filter(star, percent), docs, classes, key, text, k, percent)
    labels = components(links)
    # groups of several components, by hub: all pairs across components, through trees. Linked texts share a shingle
    # and so its hub; the pair of a group of two was compared above
    rows = rows.filter("df > 2").select(F.col("hub.node").alias("hub"), "node", "n").distinct()
    rows = written(rows.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label"), "members")
    spread = rows.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("node") == F.col("hub"), F.col("comp"))).alias("main"), F.count("*").alias("c"), F.sum("n").alias("held"))
    spread = spread.filter("lo <> hi").select("hub", "main", ((F.col("c") > CELL) | (F.col("held") > CELL_ITEMS)).alias("large"))
    rows = written(rows.join(written(spread, "mixed"), "hub"), "across")
    # a large group: blocks of its main component and of the rest; a cell for each pair of blocks but those of the main component alone
    in_main = F.col("comp") == F.col("main")
    parts = F.least(F.lit(BLOCKS), F.greatest(F.count("*") / CELL, F.sum("n") / CELL_ITEMS))
    sides = rows.filter("large").groupBy("hub", in_main.alias("in_main")).agg(F.ceil(parts).alias("b"))
    sides = sides.groupBy("hub").agg(F.coalesce(F.max(F.when(F.col("in_main"), F.col("b"))), F.lit(1)).alias("b_main"), F.coalesce(F.max(F.when(~F.col("in_main"), F.col("b"))), F.lit(1)).alias("b_rest"))
    rows = rows.join(needed(sides.coalesce(1), "sides"), "hub", "left")
    block = F.pmod(F.xxhash64("node"), F.when(in_main, F.col("b_main")).otherwise(F.col("b_rest")))
    others = F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("b_rest")).otherwise(F.col("b_main")) - 1)
    cross = F.transform(others, lambda o: F.when(in_main, F.xxhash64("hub", F.lit("cross"), o, F.col("block"))).otherwise(F.xxhash64("hub", F.lit("cross"), F.col("block"), o)))
    rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("b_rest") - 1), lambda o: F.xxhash64("hub", F.lit("rest"), F.least(o, F.col("block")), F.greatest(o, F.col("block"))))
    cells = F.when(~F.col("large"), F.array(F.col("hub"))).when(in_main, cross).otherwise(F.concat(cross, rest))
    rows = rows.withColumn("block", block).select("node", "n", "comp", F.explode(cells).alias("cell"))
    rows = written(_tree_members(rows.join(bits, "node"), percent), "paired")
    sets = _sets(rows.select("node"), docs, classes, key, text, k, percent)
    more = written(_tree_links(rows.join(sets, "node"), percent), "links")
    labels = components(links.union(more))
    # back to documents: components are named by their smallest key
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = needed(named.join(names, "label").select("node", "node2", "n", "component_id"), "named")
    joined = seen.select(key, "node", "node2", "n").join(named, ["node", "node2", "n"], "left")
    return joined.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))
