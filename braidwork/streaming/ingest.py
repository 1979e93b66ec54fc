"""Streams: incremental ingest and index, and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from braidwork.functions.text import TOKEN
from braidwork.operators.index import Index, build
from braidwork.operators.ingest import fingerprinted, new_rows
from braidwork.sources.sinks import exists, stored


def document_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 64) -> DataFrame:
    """New Parquet files of a landing folder, at most `files` a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table so far; empty before the first step."""
    return stored(spark, path, like.schema).select(*like.columns)


def index_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Documents (doc_id, text) into an index under `out`: lengths, then postings, by step.

    Steps are folders of their own number and overwrite themselves, so a step that runs again leaves no row twice;
    documents that are in already are left out. A batch build over the same documents gives the same index.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = build(batch.dropDuplicates(["doc_id"]))
        known = _rows(spark, f"{out}/lengths", fresh.lengths.withColumn("step", F.lit(0).cast("long"))).filter(F.col("step") != number)
        lengths = new_rows(fresh.lengths, known)
        postings = fresh.postings.join(lengths.select("id"), "id", "left_semi").select("term", "id", "tf")
        for name, rows in (("postings", postings), ("lengths", lengths)):
            rows.withColumn("step", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(f"{out}/{name}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What an index on disk was made with; another version or another way to split words means another index.
VERSION = 1


def sign_index(spark: SparkSession, out: str) -> None:
    """Writes what the index under `out` was made with, and how many documents it holds."""
    n = spark.read.parquet(f"{out}/lengths").count()
    spark.createDataFrame([(VERSION, TOKEN, n)], "version int, tokenizer string, documents long").coalesce(1).write.mode("overwrite").parquet(f"{out}/meta")


def index_faults(spark: SparkSession, out: str, documents: int | None = None) -> list[str]:
    """Why the index under `out` must be built anew: nothing if it can be read. documents: how many the store holds."""
    if not all(exists(spark, f"{out}/{part}") for part in ("postings", "lengths", "meta")):
        return ["a part is missing"]
    meta, held = spark.read.parquet(f"{out}/meta").first(), spark.read.parquet(f"{out}/lengths").count()
    wrong = [("another version", meta.version != VERSION), ("another tokenizer", meta.tokenizer != TOKEN), ("documents were added or lost", held != (meta.documents if documents is None else documents))]
    return [what for what, is_so in wrong if is_so]


def load_index(spark: SparkSession, out: str, docs: DataFrame) -> Index:
    """The index under `out`, built from docs (doc_id, text) where it is missing, of another make, or does not hold as many documents."""
    if index_faults(spark, out, docs.count()):
        fresh = build(docs)
        for name, rows in (("postings", fresh.postings), ("lengths", fresh.lengths)):
            rows.withColumn("step", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("step").parquet(f"{out}/{name}")
        sign_index(spark, out)
    return read_index(spark, out)


def wants_compaction(spark: SparkSession, out: str, base_bytes: int, least: int = 1 << 20) -> bool:
    """Whether what was appended since the last compaction, of base_bytes, is more than a quarter of it, and than `least`."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/postings")
    size = home.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(home).getLength()
    return size - base_bytes > max(base_bytes // 4, least)


def read_index(spark: SparkSession, out: str) -> Index:
    return Index(spark.read.parquet(f"{out}/postings").select("term", "id", "tf"), spark.read.parquet(f"{out}/lengths").select("id", "dl"))


def compacted(spark: SparkSession, out: str, to: str, files: int = 16) -> Index:
    """The same index in few files."""
    index = read_index(spark, out)
    index.postings.repartition(files, "term").sortWithinPartitions("term", "id").write.parquet(f"{to}/postings")
    index.lengths.repartition(files, "id").write.parquet(f"{to}/lengths")
    return read_index(spark, to)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Fingerprinted documents appended by step; a document whose id is stored is not stored again."""
    def step(batch: DataFrame, number: int) -> None:
        fresh = fingerprinted(batch).withColumn("id", F.col("doc_id"))
        known = _rows(batch.sparkSession, out, fresh.withColumn("step", F.lit(0).cast("long"))).filter(F.col("step") != number)
        new_rows(fresh, known).withColumn("step", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(out)

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(changes: DataFrame) -> DataFrame:
    """The newest status of every job; a finished job stays as it is, so a change delivered again does nothing."""
    done = F.col("status").isin("completed", "failed", "cancelled")
    return changes.groupBy("job_id").agg(F.coalesce(F.min_by(F.when(done, F.col("status")), F.when(done, F.col("at"))), F.max_by("status", "at")).alias("status"), F.max("at").alias("updated_at"))
