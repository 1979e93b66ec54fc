"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard, with exact scores.

Rows are dealt to shards of bounded size. In each shard greedy searches from a random graph propose neighbours for
every node and relaxed distance pruning keeps diverse ones; reverse edges are added, and pruned where there is no room.
Distances are computed for the pairs that a search meets, never for all. Blocks of queries then walk every shard's
graph by beam search, and each query keeps the best of all shards, scored in double precision on the original vectors.
Equal vectors are one node of a graph; of more than k + 1 of them only the smallest ids can appear in any answer, so
the others are answered for without being stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import written

#: Rows of a shard and of a block of queries, and components of one: fewer rows of long vectors.
SHARD_ROWS, QUERY_ROWS, SHARD_VALUES, QUERY_VALUES = 16_384, 1024, 1 << 23, 1 << 21
#: Components that one step gathers at most.
GATHERED = 1 << 24
#: Bytes of queries that are broadcast at most.
SMALL = 32 << 20


class Vectors:
    """Rows in single precision with their squared lengths."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        self.squares = (self.x * self.x).sum(axis=1)

    def between(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each q to its row of nodes."""
        out, step = np.empty(nodes.shape, np.float32), max(1, GATHERED // max(1, nodes.shape[1] * self.x.shape[1]))
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            out[part] = np.matmul(self.x[nodes[part]], q[part, :, None])[..., 0]
        return np.maximum(self.squares[nodes] - 2 * out + (q * q).sum(axis=1)[:, None], 0)


def _beam(graph: np.ndarray, entry: int, n_queries: int, distance, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries together: the width nearest nodes met, nearest first, -1 where fewer were met. distance(rows, nodes) gives the distances of query rows to their nodes."""
    rows = np.arange(n_queries)
    ids = np.full((n_queries, width), -1, np.int64)
    dist = np.full((n_queries, width), np.inf, np.float32)
    done = np.ones((n_queries, width), bool)
    met = np.zeros((n_queries, len(graph)), bool)
    ids[:, 0], done[:, 0], met[:, entry] = entry, False, True
    dist[:, 0] = distance(rows, np.full((n_queries, 1), entry))[:, 0]
    active = rows
    while len(active):
        order = np.argsort(done[active], axis=1, kind="stable")[:, :at_once]
        fresh = ~np.take_along_axis(done[active], order, 1)
        done[active[:, None], order] = True
        seeds = np.where(fresh, np.take_along_axis(ids[active], order, 1), -1)
        near = np.where(seeds[:, :, None] >= 0, graph[seeds], -1).reshape(len(active), -1)
        near = np.where(met[active[:, None], near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        good = near >= 0
        met[np.broadcast_to(active[:, None], near.shape)[good], near[good]] = True
        d = np.where(good, distance(active, np.maximum(near, 0)), np.inf).astype(np.float32)
        all_ids, all_d = np.concatenate([ids[active], near], 1), np.concatenate([dist[active], d], 1)
        all_done = np.concatenate([done[active], ~good], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ids[active], dist[active], done[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_d, best, 1), np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(axis=1)]
    return ids, dist


def _prune(v: Vectors, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to degree candidates of each node: the nearest one left is kept, and those alpha times nearer to it than to the node go."""
    out = np.full((len(nodes), degree), -1, np.int64)
    step = max(1, GATHERED // max(1, candidates.shape[1] * v.x.shape[1]))
    for at in range(0, len(nodes), step):
        own = nodes[at : at + step]
        c = np.where(candidates[at : at + step] == own[:, None], -1, candidates[at : at + step])
        c.sort(axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = np.where(c >= 0, v.between(v.x[own], np.maximum(c, 0)), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        points, squares = v.x[np.maximum(c, 0)], v.squares[np.maximum(c, 0)]
        alive, rows = c >= 0, np.arange(len(own))
        for k in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[at : at + step, k] = np.where(some, c[rows, first], -1)
            alive[rows, first] = False
            near = squares - 2 * np.matmul(points, points[rows, first][:, :, None])[..., 0] + squares[rows, first][:, None]
            alive &= ~((alpha * alpha * near <= d) & some[:, None])
    return out


def build(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 3) -> tuple[np.ndarray, int]:
    """The graph (degree out-edges a row, -1 for none) and its entry node, the one nearest the middle."""
    n, v = len(x), Vectors(x)
    rng = np.random.default_rng(seed)
    entry = int(v.between(v.x.mean(axis=0, keepdims=True), np.arange(n)[None])[0].argmin())
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        graph[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    order = rng.permutation(n)
    for at in range(0, n, batch):
        nodes = order[at : at + batch]
        found, _ = _beam(graph, entry, len(nodes), lambda rows, near, nodes=nodes: v.between(v.x[nodes[rows]], near), width)
        graph[nodes] = _prune(v, nodes, np.concatenate([found, graph[nodes]], 1), alpha, degree)
        # reverse edges, the nearest 2 * degree of a node; where they do not fit they are pruned with the edges that are there
        edges = graph[nodes]
        far = v.between(v.x[nodes], np.maximum(edges, 0)).ravel()
        source, target = np.repeat(nodes, degree), edges.ravel()
        source, target, far = source[target >= 0], target[target >= 0], far[target >= 0]
        by = np.lexsort((far, target))
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        room = place < 2 * degree
        incoming = np.full((len(hit), 2 * degree), -1, np.int64)
        incoming[np.repeat(np.arange(len(hit)), count)[room], place[room]] = source[room]
        both = np.concatenate([graph[hit], incoming], 1)
        fits = (both >= 0).sum(axis=1) <= degree
        graph[hit[fits]] = np.take_along_axis(both[fits], np.argsort(both[fits] < 0, axis=1, kind="stable")[:, :degree], 1)
        graph[hit[~fits]] = _prune(v, hit[~fits], both[~fits], alpha, degree)
    return graph, entry


def search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, width: int) -> np.ndarray:
    """The width nearest nodes met by each query, nearest first."""
    v, qs = Vectors(x), q.astype(np.float32)
    return _beam(graph, entry, len(q), lambda rows, near: v.between(qs[rows], near), min(width, len(x)))[0]


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim) + 0.0


def nearest(vectors: DataFrame, queries: Column, k: int = 10, width: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row where `queries` holds, its k nearest other rows: query_id, rank, key, score (Euclidean distance).

    Nearest first, ties to the smaller key; all candidates if there are fewer than k. Unusable vectors (see usable)
    neither ask nor answer; vectors of another dimension are never neighbours. Repeated vectors are found as ties.
    Rows that share a key are one candidate, as near as the nearest of its vectors, and one query that asks with all of
    them. Rows without a key take no part; an empty table gives an empty one. Other columns are not read, so that names
    like those of the result do no harm.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("v"), F.coalesce(queries, F.lit(False)).alias("ask"))
    rows = written(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")), "vectors")
    # of equal vectors the k + 1 smallest ids, found in three steps of salted groups
    kept = rows.select("id", "v", "dim", F.xxhash64("v").alias("h"), F.hash("v").alias("h2"))
    for salts in (256, 16, 1):
        w = Window.partitionBy("h", "h2", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
        kept = kept.withColumn("_n", F.dense_rank().over(w)).withColumn("_same", F.lag("id").over(w))
        kept = kept.filter((F.col("_n") <= k + 1) & ~F.col("id").eqNullSafe(F.col("_same"))).drop("_n", "_same")
    kept = written(kept.drop("h", "h2"), "distinct")
    sizes = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asks = {r["dim"]: r["n"] for r in rows.filter("ask").groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def parts(counts: dict[int, int], rows: int, values: int) -> dict[int, int]:
        return {dim: -(-n // max(1, min(rows, values // dim))) for dim, n in sorted(counts.items())}

    def dealt(into: dict[int, int]) -> Column:
        of = F.lit(1)
        for dim, n in into.items():
            of = F.when(F.col("dim") == dim, n).otherwise(of)
        return F.pmod(F.xxhash64("id"), of).cast("int")

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        dim = table.column("dim")[0].as_py()
        x = _matrix(table.column("v").combine_chunks(), dim)
        nodes, which = np.unique(x, axis=0, return_inverse=True)
        graph, entry = build(nodes)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": table.column("shard").slice(0, 1), "entry": pa.array([entry], pa.int32()), "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "which": pa.array([which.astype(np.int32).tobytes()], pa.binary()), "nodes": pa.array([nodes.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary())})

    shards = kept.withColumn("shard", dealt(parts(sizes, SHARD_ROWS, SHARD_VALUES))).groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, entry int, ids binary, which binary, nodes binary, graph binary")
    shards = written(shards, "graphs")

    asked = parts(asks, QUERY_ROWS, QUERY_VALUES)

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), "asking": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "points": pa.array([_matrix(table.column("v").combine_chunks(), dim).tobytes()], pa.binary())})

    blocks = written(rows.filter("ask").withColumn("block", dealt(asked)).groupBy("dim", "block").applyInArrow(block, "dim int, block int, asking binary, points binary"), "queries")
    n_blocks = F.lit(0)
    for dim, n in asked.items():
        n_blocks = F.when(F.col("dim") == dim, n).otherwise(n_blocks)
    small = sum(8 * dim * n for dim, n in asks.items()) <= SMALL
    # every block of queries meets every shard
    work = shards.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), n_blocks), lambda b: b < n_blocks))).join(F.broadcast(blocks) if small else blocks, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                dim = one["dim"]
                ids, which = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["which"], np.int32)
                x, graph = np.frombuffer(one["nodes"]).reshape(-1, dim), np.frombuffer(one["graph"], np.int32).reshape(len(np.frombuffer(one["nodes"])) // dim, -1).astype(np.int64)
                asking, q = np.frombuffer(one["asking"], np.int64), np.frombuffer(one["points"]).reshape(-1, dim)
                near = search(x, graph, one["entry"], q, width)
                score, step = np.empty(near.shape), max(1, GATHERED // max(1, near.shape[1] * dim))
                for s in range(0, len(q), step):
                    score[s : s + step] = np.sqrt(((x[np.maximum(near[s : s + step], 0)] - q[s : s + step, None, :]) ** 2).sum(axis=2))
                score[near < 0] = np.inf
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(len(x) + 1))
                out = []
                for i, a in enumerate(asking.tolist()):
                    best = np.argsort(score[i], kind="stable")
                    best = best[near[i][best] >= 0]
                    for reach in (2 * k, len(best)):  # keys that stand for several vectors may need more nodes
                        some = best[score[i][best] <= score[i][best[min(reach, len(best) - 1)]]]
                        members = [order[edges[m] : edges[m + 1]] for m in near[i][some]]
                        mine = ids[np.concatenate(members)]
                        d = np.repeat(score[i][some], [len(m) for m in members])[mine != a]
                        mine = mine[mine != a]
                        top = np.lexsort((mine, d))
                        top = top[np.sort(np.unique(mine[top], return_index=True)[1])][:k]
                        if len(top) == k:
                            break
                    out += [(a, f, s) for f, s in zip(mine[top].tolist(), d[top].tolist(), strict=True)]
                cols = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", key, "score"])

    found = work.select("dim", "entry", "ids", "which", "nodes", "graph", "asking", "points").mapInArrow(run, f"query_id long, {key} long, score double")
    found = found.groupBy("query_id", key).agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
