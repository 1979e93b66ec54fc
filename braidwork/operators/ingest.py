"""Ingest: provenance, exact and near duplicates, flags, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.screening import injection_signals, pii_types
from braidwork.functions.text import fingerprint
from braidwork.operators.cells import near_join


def version_id(content: Column) -> Column:
    """First 16 hex digits of the bytes' sha256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def document_id(owner: Column, path: Column, version: Column, screening: Column) -> Column:
    """[owner/]path@version~screening."""
    prefix = F.when(F.coalesce(owner, F.lit("")) != "", F.concat(owner, F.lit("/"))).otherwise(F.lit(""))
    return F.concat(prefix, path, F.lit("@"), version, F.lit("~"), F.substring(F.md5(screening.cast("binary")), 1, 8))


def fingerprinted(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("content_fingerprint", fingerprint(F.col(text)))


def exact_dedup(rows: DataFrame, owner: str = "owner", order: str = "ordinal", mark: str = "content_fingerprint") -> DataFrame:
    """The first row of each (owner, fingerprint). The choice is one aggregate, so a fingerprint is made once a row, and a copy that fills a third of the table costs one row per task."""
    rest = [c for c in rows.columns if c not in (owner, mark)]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("_first")
    return rows.groupBy(owner, mark).agg(first).select(owner, mark, "_first.*").select(*rows.columns)


def dedup_vs_store(fresh: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("lang", "owner", "content_fingerprint"), document: str = "document_key") -> DataFrame:
    """Fresh rows unless their fingerprint is stored for other documents and not for their own."""
    known = stored.select(*keys, document).distinct()
    elsewhere = fresh.join(known.select(*keys).distinct(), list(keys), "left_semi").select(*keys, document).distinct()
    copies = elsewhere.join(known, [*keys, document], "left_anti")
    return fresh.join(copies, [*keys, document], "left_anti")


def near_duplicates(fresh: DataFrame, stored: DataFrame, threshold: float = 0.985, key: str = "id", vector: str = "embedding", owner: str = "owner", document: str = "document_key") -> DataFrame:
    """Each fresh row's best stored neighbour of the same owner, where it is of another document and at least that near: (key, match_id, score).

    Both sides are dealt to cells of the space and meet only where they may be that near: see near_join. Nothing is
    missed, and an owner that holds most rows is spread over its cells. Ties go to the larger id.
    """
    asked = fresh.select(F.col(key).alias("qid"), F.col(vector).alias("v"), F.col(owner).alias("owner"))
    rows = stored.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(owner).alias("owner"))
    best = near_join(asked, rows, threshold, "owner", others_only=True).select(F.col("qid").alias(key), F.col("id").alias("match_id"), "score")
    told = best.join(stored.select(F.col(key).alias("match_id"), F.col(document).alias("_other")), "match_id").join(fresh.select(key, F.col(document).alias("_doc")), key)
    return told.filter(F.col("_doc") != F.col("_other")).select(key, "match_id", "score")


def flagged(rows: DataFrame, text: str = "content", trusted: int | None = None, pii: bool = True) -> DataFrame:
    """rows with injection and personal-data flags; an authority from `trusted` on exempts."""
    signals = injection_signals(F.col(text))
    exempt = (F.size("injection_signals") > 0) & (F.coalesce("authority", F.lit(-1)) >= trusted) if trusted is not None else F.lit(False)
    out = rows.withColumn("injection_signals", signals).withColumn("injection_exempt", exempt)
    out = out.withColumn("injection_suspected", (F.size("injection_signals") > 0) & ~F.col("injection_exempt"))
    return out.withColumn("pii_types", pii_types(F.col(text))).withColumn("pii_found", F.size("pii_types") > 0) if pii else out


def without_suspected(chunks: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose parent is suspected go with it."""
    blocked = parents.filter("injection_suspected").select("parent_id").distinct()
    return chunks.join(blocked, "parent_id", "left_anti"), parents.filter("NOT injection_suspected")


def retained_parents(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    return parents.join(chunks.select("parent_id").distinct(), "parent_id", "left_semi")


def latest_screening(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of a (document_key, version_id) screened with other settings than its current ones go; rows that never recorded any stay."""
    other = current.select("document_key", "version_id", F.col("screening").alias("_now"))
    kept = rows.join(other, ["document_key", "version_id"], "left")
    return kept.filter(F.col("_now").isNull() | F.col("screening").isNull() | (F.col("screening") == F.col("_now"))).drop("_now")


def catalog(rows: DataFrame) -> DataFrame:
    """One row per document_key: chunks, last page, versions and the newest source, by path."""
    path = F.expr("substring(document_key, locate(':', document_key) + 1)")
    return (
        rows.groupBy("document_key")
        .agg(F.count("*").alias("chunks"), F.max("page").alias("pages"), F.countDistinct("version_id").alias("versions"), F.max_by("source", "ingested_at").alias("source"))
        .withColumn("path", path)
    )


def listed(documents: DataFrame, name: str, limit: int) -> DataFrame:
    """Documents whose path holds name, whatever its case, with the total and whether rows are left out; a top-k report."""
    hits = documents.filter(F.contains(F.lower("path"), F.lit(name.lower())))
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(F.lower("path"), "document_key").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def new_rows(fresh: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Fresh rows whose id is not stored; of repeated ids one stays. Running an ingest again adds nothing."""
    return fresh.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def in_order(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows of an array column `ids`, in its order; unknown ids are left out."""
    return ids.select(F.posexplode("ids").alias("pos", key)).join(rows, key).orderBy("pos")


def first_language(rows: DataFrame, key: str = "id", lang: str = "lang") -> DataFrame:
    """One row per id: that of the first language that has it."""
    w = Window.partitionBy(key).orderBy(lang)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def deleted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def redaction_counts(counts: DataFrame, by: str, column: str = "counts") -> DataFrame:
    """Counts of all pages of a document together: one row per document and kind."""
    return counts.select(by, F.explode(column).alias("kind", "n")).groupBy(by, "kind").agg(F.sum("n").alias("n"))


def progress(files: DataFrame, samples: int = 100) -> DataFrame:
    """Counters of an ingest (filename, ok, error, chunks) with the first names and failures; counts are exact, lists are short."""
    def first(kept: Column, column: str, name: str) -> DataFrame:
        few = files.filter(kept).select("filename", column).orderBy("filename").limit(samples)
        return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("filename", F.col(column).alias("x")))), lambda r: r["x"]).alias(name))

    totals = files.agg(F.count("*").alias("files_total"), F.count_if("ok").alias("files_indexed"), F.count_if(~F.col("ok")).alias("files_failed"), F.sum(F.when(F.col("ok"), F.col("chunks")).otherwise(0)).alias("chunks_ingested"))
    return totals.crossJoin(F.broadcast(first(F.col("ok"), "filename", "indexed_names"))).crossJoin(F.broadcast(first(~F.col("ok"), "error", "failures")))
