"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import needed, written

#: Hash buckets inside a source; a source's cut falls into one of them, and only that bucket is put in order.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Words are counted where one starts, so nothing is extracted."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    squeezed = F.trim(F.regexp_replace(flat, " {2,}", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(F.length(squeezed) > 0, spaces + 1).otherwise(0), F.lit(0)).cast("long")


def numbered(sources: DataFrame, source: str = "source") -> DataFrame:
    """sources with place, from 0 in code-point order, null last: ranges are numbered side by side, and only their counts meet."""
    order = F.col(source).asc_nulls_last()
    ranged = written(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    ahead, so_far = [], 0
    for part, n in counts:
        ahead += [F.lit(part), F.lit(so_far)]
        so_far += n
    first = F.element_at(F.create_map(*ahead), F.col("_part")) if ahead else F.lit(0)
    inside = Window.partitionBy("_part").orderBy(order)
    return ranged.withColumn("place", F.row_number().over(inside) - 1 + first).drop("_part")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """source, source_size, weight -> also target: `share` of all sizes by weight, none above `epochs` times its size.

    Round by round the sources that are above are clamped and what they leave is shared by weight among the others,
    until none is above. A round sums all sources where they are; the driver holds one number, the level to which the
    unclamped ones are filled per weight, and it only rises. Sources of size 0 get 0.
    """
    live = F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0)
    rows = sources.withColumn("_cap", (epochs * F.col("source_size")).cast("double")).withColumn("_live", live.cast("double"))
    rows = written(rows, "sources")
    all_ = rows.agg(F.sum("source_size").alias("size"), F.sum("_live").alias("weight")).first()
    total, level = share * float(all_["size"] or 0), 0.0
    while True:
        above = F.col("_cap") <= F.lit(level) * F.col("_live")
        got = rows.agg(F.sum(F.when(above, F.col("_cap"))).alias("clamped"), F.sum(F.when(~above, F.col("_live"))).alias("open")).first()
        if not got["open"]:
            break  # every source is clamped
        higher = (total - float(got["clamped"] or 0)) / float(got["open"])
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_live"))
    return rows.withColumn("target", F.when(F.col("_live") > 0, target).otherwise(0.0)).select("source", "source_size", "weight", "target")


def _plan(docs: DataFrame, size: Column, weights: tuple[float, ...], share: float, epochs: float, seed: int, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """key, source, size, h and bucket of every document; and by source (p) its size and target, the whole repetitions, the rest, the bucket that the cut falls into, and what is left there."""
    # the hash of a key is spread over buckets: a source that holds most rows is summed and cut bucket by bucket
    h = _hash(seed, source, key)
    narrow = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.cast("long").alias("size"), h.alias("h"))
    narrow = written(narrow.withColumn("bucket", _bucket("h")), "sizes")
    sums = written(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "buckets")
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = water_fill(numbered(sources).withColumn("weight", turn), share, epochs)
    plan = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = plan.withColumnRenamed("source", "s")
    cut = (
        sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .join(small, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", "source_size", "target", "whole", "rest")
        .agg(F.min(F.when((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("size")), F.struct(F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("ahead")).alias("left")))).alias("cut"))
    )
    return narrow, needed(cut.select(F.col("s").alias("p"), "source_size", "target", "whole", "rest", "cut.cut_bucket", "cut.left").coalesce(1), "plan")


def _hash(seed: int, source: str, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.coalesce(F.col(source).cast("string"), F.lit("")))


def _bucket(h: str) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _at_cut() -> Column:
    return F.coalesce(F.col("bucket") == F.col("cut_bucket"), F.lit(False))


def _part_at_cut(size: Column) -> Column:
    """What a row in its source's cut bucket adds: rows in order until nothing is left."""
    inside = Window.partitionBy("source").orderBy("h", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0), F.least(size, F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0))))


def _before_cut() -> Column:
    """Whether a row outside the cut bucket is taken once more. Without a cut the rest is the whole source (rest = source_size) or nothing."""
    return (F.col("rest") > 0) & (F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")))


def mix_sources(docs: DataFrame, size: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 7, source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken and copies.

    Sources in code-point order, null last, weigh `weights` in turn. A document is taken floor(target/source_size)
    times whole; the rest of the target is filled with further documents in seeded hash order, and the document at
    the cut is taken in part (copies is then fractional). So each source's taken words differ from its target by less than one word, and no
    document exceeds the next whole number of repetitions. Equal rows that share key and hash are ordered by size;
    a null source is a source of its own; documents of size 0 take nothing. Empty tables give empty ones.
    """
    narrow, plan = _plan(docs, size, weights, share, epochs, seed, source, key)
    rows = narrow.join(plan, F.col("source").eqNullSafe(F.col("p"))).drop("p")
    ordered = rows.filter(_at_cut()).withColumn("part", _part_at_cut(F.col("size")))
    others = rows.filter(~_at_cut()).withColumn("part", F.when(_before_cut(), F.col("size")).otherwise(0))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long")
    return ordered.unionByName(others).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, taken / F.col("size")).otherwise(0.0).alias("copies")
    )


def mixed(docs: DataFrame, size: Column, present: Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 7, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with _copies, how often the mix takes each row, as mix_sources does; present tells cheaply whether a row's size is over 0.

    The plan comes to the rows, by source; only rows in their source's cut bucket are put in order, one of BUCKETS. So
    no row is shuffled but these, however large.
    """
    _, plan = _plan(docs, size, weights, share, epochs, seed, source, key)
    columns = docs.columns
    kept = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])).select("_row", F.col(source).alias("source"), F.col(key).alias("key"), _hash(seed, source, key).alias("h"), size.alias("_size"), present.alias("_present"))
    rows = kept.withColumn("bucket", _bucket("h")).join(plan, F.col("source").eqNullSafe(F.col("p")))
    cut = rows.filter(_at_cut()).withColumn("size", F.col("_size"))
    cut = cut.withColumn("_copies", F.when(F.col("size") > 0, F.col("whole") + _part_at_cut(F.col("size")) / F.col("size")).otherwise(0.0))
    others = rows.filter(~_at_cut()).withColumn("_copies", F.when(F.col("_present"), F.col("whole") + _before_cut().cast("int")).otherwise(0).cast("double"))
    return cut.select("_row.*", "_copies").unionByName(others.select("_row.*", "_copies"))
