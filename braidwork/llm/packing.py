"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import written

Config = tuple[int, ...]


def _price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for every capacity, and the length taken last (0: leave one place empty)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    gain = values[lengths]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(lengths, c, side="right")
        if k:
            total = best[c - lengths[:k]] + gain[:k]
            top = int(np.argmax(total))
            if total[top] > best[c]:
                best[c], last[c] = total[top], lengths[top]
    return best, last


def _backtrack(start: np.ndarray, last: np.ndarray) -> list[list[int]]:
    left, rows = start.copy(), [[] for _ in start]
    while True:
        while True:  # skip empty places
            idle = (left > 0) & (last[left] == 0)
            if not idle.any():
                break
            left[idle] -= 1
        live = np.flatnonzero(left > 0)
        if not len(live):
            return rows
        took = last[left[live]]
        for r, l in zip(live.tolist(), took.tolist(), strict=True):
            rows[r].append(l)
        left[live] -= took


#: A length is worth a little more than its share of a sequence the longer it is: short ones stay free to fill gaps.
GROWTH = 1.02


def fractional(demand: np.ndarray, capacity: int, rounds: int = 20, rate: float = 8.0) -> dict[Config, float]:
    """Configurations and their fractional use, by multiplicative weights.

    Each round prices all configurations at once: one knapsack table gives, for every length, the best
    configuration that holds it. Those within a thousandth of the best possible value are used for a share of their
    length's demand; a length's weight falls as its demand gets covered.
    """
    lengths = np.flatnonzero(demand)
    size = (lengths / capacity) ** GROWTH
    covered, used = np.zeros(len(demand)), Counter()
    for r in range(rounds):
        ratio = covered[lengths] / demand[lengths]
        values = np.zeros(len(demand))
        values[lengths] = size * np.exp(-rate * (ratio - r / rounds).clip(-2, 2))
        best, last = _price(values, capacity)
        worth = values[lengths] + best[capacity - lengths]
        chosen = lengths[worth >= (1 - 1e-3) * best[capacity]]
        for l, rest in zip(chosen.tolist(), _backtrack(capacity - chosen, last), strict=True):
            config = tuple(sorted([l, *rest], reverse=True))
            share = demand[l] / rounds / config.count(l)
            used[config] += share
            for x in config:
                covered[x] += share
    return dict(used)


def _best_fit(demand: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over a histogram: equal bins move together."""
    bins: list[Counter] = [Counter() for _ in range(capacity + 1)]
    done: Counter = Counter()
    for l in range(len(demand) - 1, 0, -1):
        left = int(demand[l])
        room = l
        while left:
            while room <= capacity and not bins[room]:
                room += 1
            if room > capacity:
                # open bins; items of this length fill each as far as they go
                per = capacity // l
                full, rest = divmod(left, per)
                if full:
                    bins[capacity - per * l][(l,) * per] += full
                if rest:
                    bins[capacity - rest * l][(l,) * rest] += 1
                left = 0
            else:
                config, n = next(iter(bins[room].items()))
                k = min(n, left)
                bins[room][config] -= k
                if not bins[room][config]:
                    del bins[room][config]
                bins[room - l][(*config, l)] += k
                left -= k
                room = max(l, room - l) if room - l >= l else room
    for b in bins:
        for config, n in b.items():
            done[config] += n
    return done


def _rounded(left: np.ndarray, uses: dict[Config, float]) -> Counter:
    """Uses rounded up as far as demand is left, fullest configurations first, of these the ones with the longest piece; takes what it places from left."""
    taken: Counter = Counter()
    for config, x in sorted(uses.items(), key=lambda cx: (-sum(cx[0]), -cx[0][0], -cx[1], cx[0])):
        need = Counter(config)
        k = min(int(np.ceil(x)), *(int(left[l]) // c for l, c in need.items()))
        if k > 0:
            taken[config] += k
            for l, c in need.items():
                left[l] -= k * c
    return taken


def _dive(demand: np.ndarray, capacity: int, rounds: int, rest: float) -> Counter:
    """Solves and rounds in turn until no more than the share `rest` of all places is left, or a few sequences; best-fit decreasing places that."""
    left, used, size = demand.copy(), Counter(), np.arange(len(demand))
    most = max(rest * float(demand @ size), 4 * capacity)
    while True:
        taken = _rounded(left, fractional(left, capacity, rounds)) if left.any() else Counter()
        used += taken
        if not taken or left @ size <= most:
            return used + _best_fit(left, capacity)


#: Rounds of the linear program, and the share of places left to best-fit, of each try at rounding.
TRIES = ((20, 0.1), (40, 0.3))


def solve(demand: np.ndarray, capacity: int) -> Counter:
    """Configurations and how often each is used; every length is placed exactly as often as demanded.

    The linear program over what is left is solved and its uses are rounded up as far as demand lasts, again and
    again; best-fit decreasing places the small rest. This is tried with other numbers of rounds until no packing can
    have fewer sequences. As in column generation, best-fit's own configurations are one more candidate; of equally
    short packings the first from the linear program is taken.
    """
    demand = np.asarray(demand, np.int64)
    if not demand.any():
        return Counter()
    least = -(-int((demand * np.arange(len(demand))).sum()) // capacity)
    found = []
    for rounds, rest in TRIES:
        found.append(_dive(demand, capacity, rounds, rest))
        if sum(found[-1].values()) == least:
            return found[-1]
    return min([*found, _best_fit(demand, capacity)], key=lambda used: sum(used.values()))


def _slots(configs: Counter, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of every slot, its first sequence, its place. Ranks of a slot fill its copies in turn."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    first = 0
    for config, n in sorted(configs.items(), reverse=True):
        at = 0
        for l in config:
            found.setdefault(l, []).append((filled[l], first, at))
            filled[l] += n
            at += l
        first += n
    return {l: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for l, rows in found.items()}


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: gapless sequences of at most capacity.

    The driver gets the length histogram, of at most `capacity` rows, and nothing else. Pieces of one length are
    numbered in hash buckets, so that a length which most pieces share is spread; `order` names columns that tell
    pieces apart (equal rows may swap places). Lengths must be from 1 to capacity; an empty table gives an empty one.
    """
    pieces = written(pieces, "pieces")
    histogram = {r[length]: r["n"] for r in pieces.groupBy(length).agg(F.count("*").alias("n")).collect()}
    if any(l is None or not 0 < l <= capacity for l in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    demand = np.zeros(capacity + 1, np.int64)
    for l, n in histogram.items():
        demand[l] = n
    whole = Counter({(capacity,): int(demand[capacity])} if demand[capacity] else {})
    demand[capacity] = 0
    slots = _slots(whole + solve(demand, capacity), capacity)
    buckets = max(64, int(sum(histogram.values()) // 50_000))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select(length, "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first")), "ranks")
    inside = Window.partitionBy(length, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(firsts, [length, "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    names = pieces.columns
    schema = ", ".join([f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names] + ["sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l = batch.column(batch.schema.get_field_index(length)).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)
            order_ = np.argsort(l, kind="stable")
            edges = np.flatnonzero(np.diff(l[order_])) + 1
            for rows in np.split(order_, edges) if len(l) else []:
                start, first, place = slots[int(l[rows[0]])]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                sequence[rows] = first[k] + rank[rows] - start[k]
                offset[rows] = place[k]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(run, schema)
