"""Vectors in cells: an exact join of near vectors, and a stored index that skips cells by a bound.

Both deal queries and rows to the same cells and multiply them there, block by block. A cell with many rows is split,
and so are the queries that meet in it: no task holds more than a block of each side. What leaves a block is at most k
rows a query, ties decided, so equal vectors cost no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.sources.shared import written

#: Bytes of vectors of one side in a block.
BLOCK_BYTES = 16 << 20
#: Rows of the sample that planes and centres are fitted on, and its bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: Halvings of the space at most; cells of an index at most.
PLANES, CELLS = 12, 1024
#: Rows that could be compared while one copy of a query is shuffled, and copies of a query that a join may make for its planes: what is shuffled stays in proportion to the input.
COPY, COPIES = 1000, 16
#: Scores of a matrix at once.
WIDE = 1 << 20
#: Scores are compared by so many digits; sums in another order differ by less.
DIGITS = 9
#: Added to every bound: rounding never costs a row.
SLACK = 1e-7


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of that dimension that are usable (no null or NaN in them, not zero), and their vectors scaled to length 1."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(sizes == dim)
    x = flat[(ends - sizes)[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good = (norm > 0) & np.isfinite(norm)
    return rows[good], x[good] / norm[good][:, None]


def _array(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32()), pa.array(x.ravel()))


def sample(rows: DataFrame, dim: int) -> np.ndarray:
    """Unit vectors of a bounded sample: the rows whose ids have the smallest hashes."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    found = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("id", "v")).limit(most).select("v").toArrow().column(0).combine_chunks()
    return units(found, dim)[1]


def best_of(score: np.ndarray, ids: pa.Array, k: int, digits: int = DIGITS, larger: bool = False, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of every row of scores (-inf: none) of at least `least`, ties by `digits` digits to the smaller, or larger, id: row, column, score."""
    top = min(k, score.shape[1])
    if not top:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    kth = score.max(axis=1) if top == 1 else np.partition(score, -top, axis=1)[:, -top]
    floor = np.maximum(kth - 10.0**-digits, max(least, np.finfo(np.float64).min))
    some = np.flatnonzero((score.max(axis=1) if top > 1 else kth) >= floor)
    who, what = np.nonzero(score[some] >= floor[some, None])
    who = some[who]
    value = score[who, what]
    seen, nth = np.unique(what, return_inverse=True)
    place = np.empty(len(seen), np.int64)
    place[pc.sort_indices(ids.take(pa.array(seen))).to_numpy()] = np.arange(len(seen))
    order = np.lexsort((-place[nth] if larger else place[nth], -np.round(value, digits), who))
    who, what, value = who[order], what[order], value[order]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < k
    return who[keep], what[keep], value[keep]


def _same(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in a, in order, and in b; null equals nothing."""
    codes = np.asarray(pc.fill_null(pa.concat_arrays([a, b.cast(a.type)]).dictionary_encode().indices, -1))
    own, other = codes[: len(a)], codes[len(a) :]
    order = np.argsort(other, kind="stable")
    low, high = (np.searchsorted(other[order], own, side=side) for side in ("left", "right"))
    n = np.where(own >= 0, high - low, 0)
    return np.repeat(np.arange(len(a)), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]


def dealt(asked: DataFrame, rows: DataFrame, on: list[str], dim: int, k: int, least: float | None = None, others_only: bool = False, digits: int = DIGITS, larger: bool = False) -> DataFrame:
    """(qid, id, score): the k best of every block for the queries (on..., qid, v) among the rows (on..., id, v) that agree on `on`; unit vectors on both sides.

    How many blocks a cell has on each side follows from its counted rows; a query goes to every block of rows of its
    cells, a row to every block of queries. score is the cosine, at least `least` where given.
    """
    size = max(1, BLOCK_BYTES // (8 * dim))
    parts = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    counts = written(parts(asked, "q_parts").join(parts(rows, "r_parts"), on), "blocks")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = asked.join(counts, on).withColumn("q_part", F.pmod(F.xxhash64("qid"), "q_parts")).withColumn("r_part", blocks("r_parts"))
    r = rows.join(counts, on).withColumn("r_part", F.pmod(F.xxhash64("id"), "r_parts")).withColumn("q_part", blocks("q_parts"))
    keys = [*on, "q_part", "r_part"]
    kinds = dict(asked.dtypes), dict(rows.dtypes)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = (t.column(c).combine_chunks() for t, c in ((left, "qid"), (right, "id")))
        q, x = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for t in (left, right))
        out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        mine, same = _same(qid, ids) if others_only else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        step = max(1, WIDE // max(1, len(x)))
        for s in range(0, len(q) if len(x) else 0, step):
            score = q[s : s + step] @ x.T
            a, b = np.searchsorted(mine, (s, s + step))
            score[mine[a:b] - s, same[a:b]] = -np.inf
            who, what, value = best_of(score, ids, k, digits, larger, -np.inf if least is None else least - 10.0**-digits)
            out.append((qid.take(pa.array(who + s)), ids.take(pa.array(what)), value))
        columns = [pa.concat_arrays([o[i] for o in out]) if out else pa.array([], a.type) for i, a in enumerate((qid, ids))]
        return pa.Table.from_arrays([*columns, pa.array(np.concatenate([o[2] for o in out]) if out else np.zeros(0))], names=["qid", "id", "score"])

    left, right = q.select(*keys, "qid", "v"), r.select(*keys, "id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, f"qid {kinds[0]['qid']}, id {kinds[1]['id']}, score double")


def dimensions(vectors: DataFrame) -> list[int]:
    """The lengths that vectors have: few in any table of one model."""
    return sorted(r.dim for r in vectors.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().collect())


# --- near vectors --------------------------------------------------------------------------------------------------


@dataclass
class Planes:
    """Orthonormal directions and where each is cut: a vector's cell is on which side of every cut it lies."""

    directions: np.ndarray
    cuts: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, rows: float, radius: float) -> Planes:
        """Directions in which the sample varies most, cut in the middle: as many as make the work least.

        A query could meet so many rows; it meets those of the cells in its reach and is copied to each, COPIES at
        most. How many those are is counted on the sample. A radius that reaches everything gets no plane.
        """
        if not len(x):
            return cls(np.zeros((0, x.shape[1])), np.zeros(0))
        middle = x - x.mean(axis=0)
        directions = np.linalg.eigh(middle.T @ middle)[1][:, ::-1].T
        cuts = np.median(x @ directions.T, axis=0)
        few, best = x[:: -(-len(x) // 512)], (np.inf, 0)
        for n in range(min(PLANES, x.shape[1]) + 1):
            reach = len(cls(directions[:n], cuts[:n]).within(few, radius)[0]) / len(few)
            if n and reach > COPIES:
                break
            best = min(best, (reach / 2**n * rows + COPY * reach, n))
        return cls(directions[: best[1]], cuts[: best[1]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.directions.T > self.cuts) << np.arange(len(self.cuts))).sum(axis=1).astype(np.int64)

    def within(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of every cell that may hold a vector at most `radius` away: the way across cuts at right angles is the root of the sum of their squared distances."""
        far = (x @ self.directions.T - self.cuts) ** 2
        own, cost = self.cells(x), np.zeros((len(x), 1))
        flips = np.zeros(1, np.int64)
        for i in range(len(self.cuts)):
            cost = np.concatenate([cost, cost + far[:, i : i + 1]], axis=1)
            flips = np.concatenate([flips, flips | (1 << i)])
        who, what = np.nonzero(cost <= radius * radius + SLACK)
        return who, own[who] ^ flips[what]


def _with_cells(vectors: DataFrame, dim: int, planes: Planes, radius: float | None) -> DataFrame:
    """Unit vectors with their cell, or, with a radius, with the list cells of all in reach; other columns come along."""
    kept = [c for c in vectors.columns if c != "v"]
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = units(batch.column(batch.schema.get_field_index("v")), dim)
            for s in range(0, len(at), 256):
                some = x[s : s + 256]
                if radius is None:
                    cell = pa.array(planes.cells(some))
                else:
                    who, reached = planes.within(some, radius)  # in order of who
                    cell = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(some) + 1)), pa.int32()), pa.array(reached))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).take(pa.array(at[s : s + 256])) for c in kept], _array(some), cell], names=[*kept, "v", name])

    name = "cell" if radius is None else "cells"
    return vectors.select(*kept, "v").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "v array<double>", f"{name} {'long' if radius is None else 'array<long>'}"]))


def near_join(queries: DataFrame, rows: DataFrame, least: float, by: str | None = None, others_only: bool = False) -> DataFrame:
    """(qid, id, score): for every query (qid, v) its nearest row (id, v) by cosine of at least `least`, ties to the larger id.

    Vectors at least that alike are at most sqrt(2 - 2 * least) apart on the unit sphere. The space is halved along up
    to PLANES directions, fitted on a bounded sample of the rows; a query goes to the cells that lie that near. Nothing
    is missed whatever the sample; a loose threshold reaches all cells and compares all pairs, in blocks. Each side is
    scanned once for its cells; a query is stored once with the list of its cells. by names a column that must be equal, and not null, on both sides; with others_only a
    query meets no row of its own id. Vectors that are null, zero, not finite or of another dimension take no part.
    """
    extra = [by] if by else []
    on = [*extra, "cell", "dim"]
    kinds = dict(queries.dtypes), dict(rows.dtypes)
    out = rows.sparkSession.createDataFrame([], f"qid {kinds[0]['qid']}, id {kinds[1]['id']}, score double")
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    for dim in dimensions(queries):
        held = rows.filter(F.size("v") == dim)
        sizes = held.groupBy(*extra).count().agg(F.sum(F.col("count").cast("double") * F.col("count")), F.sum("count")).first()
        planes = Planes.fitted(sample(held, dim), sizes[0] / sizes[1] if sizes[1] else 0, radius)  # a query meets rows of its own group
        r = written(_with_cells(held.select("id", "v", *extra), dim, planes, None), "near-rows").withColumn("dim", F.lit(dim))
        q = written(_with_cells(queries.filter(F.size("v") == dim).select("qid", "v", *extra), dim, planes, radius), "near-queries")
        q = q.withColumn("cell", F.explode("cells")).drop("cells").withColumn("dim", F.lit(dim))
        found = dealt(q, r, on, dim, 1, least, others_only, digits=12, larger=True).withColumn("s", F.round("score", 12))
        best = found.groupBy("qid").agg(F.max(F.struct("s", "id", "score")).alias("b")).filter(F.col("b.s") >= least)
        out = out.unionByName(best.select("qid", "b.id", "b.score"))
    return out


# --- a stored index ------------------------------------------------------------------------------------------------


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of unit vectors by Lloyd's rounds from evenly spaced rows; an empty centre stays where it is."""
    found = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(np.int64)] if len(x) else x
    for _ in range(rounds if len(found) > 1 else 0):
        mine = np.concatenate([(x[s : s + 4096] @ found.T).argmax(axis=1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, mine, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], found)
    return found


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class VectorIndex:
    """Rows by the centre that is nearest, and of each cell its centre, its rows, and the least and largest angle of a row to the centre.

    rows: dim, cell, id, v (unit vectors) and further columns; cells: dim, cell, centre, n, low, high. Angles between
    unit vectors obey the triangle inequality: a row of a cell cannot be nearer to a query than the query's angle to
    the centre less `high`, nor than `low` less that angle.
    """

    rows: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, key: str = "id", vector: str = "embedding", cells: int | None = None, write: Callable[[DataFrame, str], DataFrame] = written) -> VectorIndex:
        """An index of every usable vector. Centres come from a bounded sample; there are as many as the root of the rows, at most CELLS. Columns besides key and vector come along, for filters."""
        rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), *[c for c in vectors.columns if c not in (key, vector, "id", "v", "cell", "dim", "angle")])
        parts: list[DataFrame] = []
        found: list[tuple[int, int, list[float]]] = []
        for dim in dimensions(rows):
            held = rows.filter(F.size("v") == dim)
            middle = centres(sample(held, dim), cells or int(np.clip(np.sqrt(held.count()), 1, CELLS)))
            if len(middle):
                parts.append(_assigned(held, dim, middle))
                found += [(dim, c, v.tolist()) for c, v in enumerate(middle)]
        spark = vectors.sparkSession
        if not parts:
            empty = _assigned(rows, 1, np.ones((1, 1)))
            parts = [empty.filter("false")]
        placed = parts[0]
        for more in parts[1:]:
            placed = placed.unionByName(more)
        stored = write(placed.repartition("dim", "cell").sortWithinPartitions("dim", "cell"), "vectors")
        known = spark.createDataFrame(found, "dim int, cell int, centre array<double>")
        held = stored.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        return cls(stored.drop("angle"), write(known.join(held, ["dim", "cell"]), "cells"))

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.cells.write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"))

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The k nearest rows of each query (qid, query_vector): qid, id, score, rank from 0; and per query the rows and cells compared, and all there are.

        First the nearest cells that hold k rows are read: the k-th score found bounds what is left, and only cells
        whose bound is better are read then. So nothing is missed. With probes a query reads its so many nearest cells
        and no more: approximate. where is a condition on the rows' columns; it may leave fewer than k in the first
        cells, and then all are read. Ties to the smaller id. Queries that are null, zero, not finite or of a dimension
        that no row has find nothing.
        """
        kind = dict(queries.dtypes)["qid"]
        asked = queries.select("qid", F.col("query_vector").alias("v"))
        spark, ids = queries.sparkSession, dict(self.rows.dtypes)["id"]
        hits = spark.createDataFrame([], f"qid {kind}, id {ids}, score double")
        read = spark.createDataFrame([], f"qid {kind}, cells long, n long, all_cells long, all_rows long")
        table = self.cells.toArrow()  # at most CELLS a dimension
        for dim in sorted(set(table.column("dim").to_pylist())):
            mine = table.filter(pc.equal(table.column("dim"), dim))
            known = {c: mine.column(c).to_numpy() for c in ("cell", "n", "low", "high")}
            known["centre"] = np.array(mine.column("centre").to_pylist())
            held = self.rows.filter(F.col("dim") == dim)
            held = (held if where is None else held.filter(where)).select("cell", "id", "v")
            of = asked.filter(F.size("v") == dim)
            first = written(_probed(of.withColumn("worst", F.lit(None).cast("double")), dim, known, k, probes), "probes")
            found = _ranked(written(dealt(first, _read(held, first), ["cell"], dim, k), "first"), k)
            if probes is None:
                kth = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
                more = written(_probed(of.join(kth, "qid", "left"), dim, known, k, None, rest=True), "probes")
                found = _ranked(found.select("qid", "id", "score").unionByName(dealt(more, _read(held, more), ["cell"], dim, k)), k)
                first = first.unionByName(more)
            hits = hits.unionByName(found.select("qid", "id", "score"))
            sizes = spark.createDataFrame([(int(c), int(n)) for c, n in zip(known["cell"], known["n"], strict=True)], "cell int, n long")
            read = read.unionByName(first.select("qid", "cell").join(F.broadcast(sizes), "cell").groupBy("qid").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.lit(len(known["cell"])).cast("long").alias("all_cells"), F.lit(int(known["n"].sum())).cast("long").alias("all_rows")))
        return _ranked(hits, k), read


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    from braidwork.operators.index import top

    return top(hits.withColumn("_r", F.round("score", DIGITS)), k, score="_r").drop("_r")


def _read(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the cells that are asked for, at most CELLS: a filter that the scan can use."""
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    return rows.filter(F.col("cell").isin(cells)) if cells else rows.filter("false")


def _assigned(rows: DataFrame, dim: int, middle: np.ndarray) -> DataFrame:
    """Unit vectors with the nearest centre and the angle to it; other columns come along."""
    kept = [c for c in rows.columns if c != "v"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = units(batch.column(batch.schema.get_field_index("v")), dim)
            cosine = x @ middle.T
            cell = cosine.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            angle = _angle(cosine[np.arange(len(x)), cell])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).take(take) for c in kept], _array(x), pa.array(np.full(len(x), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*kept, "v", "dim", "cell", "angle"])

    return rows.select(*kept, "v").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "v array<double>, dim int, cell int, angle double"]))


def _probed(queries: DataFrame, dim: int, known: dict[str, np.ndarray], k: int, probes: int | None, rest: bool = False) -> DataFrame:
    """qid, v, cell: the cells that a query (qid, v, worst) reads first, or the rest of those that may hold a score over `worst` (null: all)."""
    schema = f"qid {dict(queries.dtypes)['qid']}, v array<double>, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = units(batch.column("v"), dim)
            worst = batch.column("worst").take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64)
            for s in range(0, len(at), 256):
                angle = _angle(x[s : s + 256] @ known["centre"].T)
                bound = np.maximum(np.maximum(angle - known["high"], known["low"] - angle), 0)
                order = np.lexsort((np.broadcast_to(known["cell"], angle.shape), angle), axis=1)
                if probes is not None:
                    early = np.zeros(angle.shape, bool)
                    np.put_along_axis(early, order[:, :probes], True, axis=1)
                else:  # the nearest cells that hold k rows together
                    held = np.cumsum(known["n"][order], axis=1)
                    early = np.zeros(angle.shape, bool)
                    np.put_along_axis(early, order, np.concatenate([np.ones((len(held), 1), bool), held[:, :-1] < k], axis=1), axis=1)
                least = worst[s : s + 256][:, None]
                wanted = ~early & (np.isnan(least) | (bound <= _angle(least) + SLACK)) if rest else early
                who, what = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at[s : s + 256][who])), _array(x[s : s + 256][who]), pa.array(known["cell"][what].astype(np.int32))], names=["qid", "v", "cell"])

    return queries.select("qid", "v", "worst").mapInArrow(run, schema)
