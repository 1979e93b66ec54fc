"""Running values along an order, and exact ranks, where no task holds all rows of a key.

A table is put in order by ranges, so that a key with most rows fills many parts. Each part computes on its own; what
the parts before it come to is a summary of one row a part, summed in order and added back. Ranks narrow down a bracket
of values by sketches and counts, a fixed amount of memory for each group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.sources.shared import written


@dataclass
class Ordered:
    """rows in parts that follow one another in the order of (by, order); rows that tie stand as they were read."""

    rows: DataFrame
    by: list[str]

    @classmethod
    def of(cls, rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> Ordered:
        """Null keys and values come first, as keys and values of their own. parts: how many, the session's shuffle partitions by default."""
        numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        along = [*by, *order, "_row"]
        ranged = numbered.repartitionByRange(parts, *along) if parts else numbered.repartitionByRange(*along)
        placed = ranged.sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
        return cls(written(placed.drop("_row"), "ordered"), by)

    def _inside(self):
        return Window.partitionBy("_part", *self.by).orderBy("_at")

    def _carried(self, summary: Column, over: str) -> DataFrame:
        """_part, by and _carry: `over` of the summaries of all parts before that hold the key. A part has at most two keys that others hold, its first and its last: two rows a part at most."""
        each = self.rows.groupBy("_part", *self.by).agg(summary.alias("_s"))
        keys = self.by or [F.lit(0)]
        shared = each.withColumn("_parts", F.count("*").over(Window.partitionBy(*keys))).filter("_parts > 1")
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        made = F.sum("_s").over(before) if over == "sum" else F.last("_s", ignorenulls=True).over(before)
        return shared.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in self.by], made.alias("_carry"))

    def _joined(self, carry: DataFrame) -> DataFrame:
        same = F.col("_part") == F.col("_p")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return self.rows.join(F.broadcast(carry), same, "left").drop("_p", *[f"_k_{c}" for c in self.by])

    def total(self, value: Column, name: str, before: bool = False) -> Ordered:
        """With the sum of value over the key's rows up to each row, or those before it."""
        carry = self._carried(F.sum(value), "sum")
        upto = F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, -1 if before else 0))
        rows = self._joined(carry).withColumn(name, F.coalesce(upto, F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return Ordered(rows, self.by)

    def previous(self, value: str, name: str) -> Ordered:
        """With the value of the key's row before, null for its first."""
        carry = self._carried(F.max_by(value, "_at"), "last")
        first = F.row_number().over(self._inside()) == 1
        rows = self._joined(carry).withColumn(name, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(self._inside()))).drop("_carry")
        return Ordered(rows, self.by)

    def result(self) -> DataFrame:
        return self.rows.drop("_part", "_at")


# --- ranks ---------------------------------------------------------------------------------------------------------

#: Values of a group that are put in order at once.
FEW = 65_536
#: Splitters that a sketch gives.
GRID = 200
#: Rows of a side that is broadcast.
SMALL = 200_000


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & a[c].eqNullSafe(b[f"_g_{c}"])
    return same


def exact_ranks(rows: DataFrame, value: str, places: dict[str, Column], by: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """by..., and for every name of places the value at that place (from 0, from the count `n`) of its group in order.

    Each place starts with the bracket of all its group's values. A round sketches what is in the bracket, chooses two
    splitters around the place, counts exactly what lies below and between them, and keeps the part that holds the
    place; where the splitters are the bracket's own ends, one splitter parts it in three. Once a bracket has at most
    `few` values, they are put in order. Nulls are left out; a group without a value has no row.
    """
    rows = rows.select(*by, F.col(value).alias("_v")).filter("_v IS NOT NULL")
    g = [f"_g_{c}" for c in by]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), place.cast("long").alias("_k")) for name, place in places.items()]))
    state = groups.filter("n > 0").select(*[F.col(c).alias(f"_g_{c}") for c in by], "_lo", "_hi", "n", wanted.alias("_w"))
    state = state.select(*g, "_w._name", "_w._k", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    state = written(state, "brackets")
    wide = f"_lo < _hi AND _inside > {few}"
    while not state.filter(wide).isEmpty():
        open_ = state.filter(wide)
        held = rows.join(_few(open_), _same(rows, open_, list(by)) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        keys = [*g, "_name", "_k", "_lo", "_hi", "_below", "_inside"]
        cuts = held.groupBy(*keys).agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("_s"))
        j = F.floor((F.col("_k") - F.col("_below")) / F.col("_inside") * GRID).cast("int")
        at = lambda i: F.element_at("_s", F.greatest(F.least(i + 1, F.lit(GRID + 1)), F.lit(1)))
        cuts = cuts.select(*keys, at(j - 1).alias("_a"), at(j + 2).alias("_b"), at(j).alias("_c"))
        stuck = (F.col("_a") == F.col("_lo")) & (F.col("_b") == F.col("_hi"))
        cuts = written(cuts.select(*keys, F.when(stuck, F.col("_c")).otherwise(F.col("_a")).alias("_a"), F.when(stuck, F.col("_c")).otherwise(F.col("_b")).alias("_b")), "cuts")
        held = rows.join(_few(cuts), _same(rows, cuts, list(by)) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        less, more = F.col("_v") < F.col("_a"), F.col("_v") > F.col("_b")
        counted = held.groupBy(*keys, "_a", "_b").agg(F.count_if(less).alias("_lt"), F.count_if(~less & ~more).alias("_mid"), F.max(F.when(less, F.col("_v"))).alias("_under"), F.min(F.when(more, F.col("_v"))).alias("_over"))
        left = F.col("_k") - F.col("_below")
        below, within = left < F.col("_lt"), left < F.col("_lt") + F.col("_mid")
        pick = lambda x, y, z: F.when(below, x).when(within, y).otherwise(z)
        step = counted.select(
            *g, "_name", "_k",
            pick(F.col("_lo"), F.col("_a"), F.col("_over")).alias("_lo"), pick(F.col("_under"), F.col("_b"), F.col("_hi")).alias("_hi"),
            pick(F.col("_below"), F.col("_below") + F.col("_lt"), F.col("_below") + F.col("_lt") + F.col("_mid")).alias("_below"),
            pick(F.col("_lt"), F.col("_mid"), F.col("_inside") - F.col("_lt") - F.col("_mid")).alias("_inside"),
        )
        state = written(state.filter(f"NOT ({wide})").unionByName(step), "brackets")
    one = state.filter("_lo = _hi").select(*g, "_name", F.col("_lo").alias("_x"))
    some = state.filter("_lo < _hi")
    held = rows.join(_few(some), _same(rows, some, list(by)) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    some = held.groupBy(*g, "_name", "_k", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    some = some.select(*g, "_name", F.element_at("_all", (F.col("_k") - F.col("_below") + 1).cast("int")).alias("_x"))
    both = one.unionByName(some)
    return both.groupBy(*[F.col(f"_g_{c}").alias(c) for c in by]).agg(*[F.first(F.when(F.col("_name") == name, F.col("_x")), ignorenulls=True).alias(name) for name in places])


def _few(rows: DataFrame) -> DataFrame:
    """A side of a join that is broadcast if its counted rows are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows
