"""Sinks, landing folders and queues, and evaluation sets."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from braidwork.operators.ingest import new_rows
from braidwork.sources.files import GOLDEN, MAX_BYTES

# Limits of an audit record.
AUDIT_ITEMS, AUDIT_TEXT = 20, 200
FINISHED = ("completed", "failed", "cancelled")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table so far; empty before its first row."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_parents(parents: DataFrame, path: str) -> None:
    """Appends sections that are read by id and never searched: no vectors, and none that is there already."""
    rows = parents.drop("embedding")
    new_rows(rows, stored(parents.sparkSession, path, rows.schema), "parent_id").write.mode("append").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunks by id: ids that are there are left out, a blank id becomes a random one."""
    rows = chunks.withColumn("id", F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.expr("uuid()")).otherwise(F.col("id")))
    new_rows(rows, stored(chunks.sparkSession, path, rows.schema)).write.mode("append").parquet(path)


# --- uploads and queues --------------------------------------------------------------------------------------------


def land_uploads(files: DataFrame, folder: str, batch: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Uploads (filename, content) into a landing folder, for a stream to read; gives the refused ones with the reason.

    PDF files within the size limit are taken. Each gets a random prefix to its name, so that two of one name both stay.
    """
    size = F.length("content")
    reason = F.when(~F.lower("filename").endswith(".pdf") | ~F.substring("content", 1, 5).cast("string").startswith("%PDF-"), "not a PDF").when(size > max_bytes, "too large")
    checked = files.withColumn("reason", F.when(size.isNull(), "empty").otherwise(reason))
    name = F.concat(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.lit("_"), F.element_at(F.split("filename", r"[/\\]"), -1))
    checked.filter("reason IS NULL").select(name.alias("filename"), "content").write.mode("append").parquet(f"{folder}/{batch}" if batch else folder)
    return checked.filter("reason IS NOT NULL").select("filename", "reason")


def publish_jobs(jobs: DataFrame, queue: str) -> None:
    """Appends jobs (job_id, payload) to a queue folder as JSON lines; they are durable once this returns."""
    jobs.select("job_id", "payload").write.mode("append").json(queue)


def consume_jobs(spark: SparkSession, queue: str, home: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs every queued job that is new: work gets (job_id, payload) and gives (job_id, status, note).

    A batch is delivered at least once. States are kept by batch under home/states, so that a batch that runs again
    replaces its own; a job with a finished state is not run again. Lines that are no job go to home/rejected.
    """
    schema = StructType.fromDDL("job_id string, status string, note string, batch long")

    def step(lines: DataFrame, number: int) -> None:
        parsed = lines.select("value", F.from_json("value", "job_id string, payload string").alias("j"))
        bad = parsed.filter(F.coalesce(F.trim("j.job_id"), F.lit("")) == "").select("value", F.lit(number).alias("batch"))
        bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{home}/rejected")
        known = stored(spark, f"{home}/states", schema).filter((F.col("batch") != number) & F.col("status").isin(*FINISHED))
        fresh = parsed.filter(F.coalesce(F.trim("j.job_id"), F.lit("")) != "").select("j.*").dropDuplicates(["job_id"]).join(known, "job_id", "left_anti")
        done = work(fresh).select("job_id", "status", "note").withColumn("batch", F.lit(number).cast("long"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{home}/states")

    return spark.readStream.option("maxFilesPerTrigger", 1).text(queue).writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()


# --- audit ---------------------------------------------------------------------------------------------------------


def audit_value(value: Column, kind: str = "string") -> Column:
    """Details of an audit record: strings are cut at 200 characters with a mark, lists and maps at 20 items."""
    def cut(text: Column) -> Column:
        return F.when(F.length(text) > AUDIT_TEXT, F.concat(F.left(text, F.lit(AUDIT_TEXT)), F.lit("..."))).otherwise(text)

    if kind == "array":
        return F.transform(F.slice(value, 1, AUDIT_ITEMS), lambda v: cut(v.cast("string")))
    if kind == "map":
        few = F.slice(F.map_entries(value), 1, AUDIT_ITEMS)
        return F.map_from_entries(F.transform(few, lambda e: F.struct(F.left(e["key"].cast("string"), F.lit(AUDIT_TEXT)).alias("key"), cut(e["value"].cast("string")).alias("value"))))
    return cut(value.cast("string"))


def write_audit(records: DataFrame, path: str) -> None:
    """Appends records (time, action, outcome, actor and details) as JSON lines; details are cut, null ones left out."""
    plain = {"time", "action", "outcome", "actor"}
    out = {}
    for f in records.schema.fields:
        if f.name not in plain:
            name = f.dataType.typeName()
            out[f.name] = audit_value(F.col(f.name), name) if name in ("string", "array", "map") else F.col(f.name)
    records.withColumns(out).write.mode("append").option("ignoreNullFields", True).json(path) if out else records.write.mode("append").json(path)


# --- evaluation sets and results -----------------------------------------------------------------------------------


def read_golden_strictly(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSONL file: blank lines are skipped; a line that is no object, lacks a question or has an unknown key fails the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    known = F.array(*[F.lit(n) for n in GOLDEN.fieldNames()])
    good = F.coalesce(F.size(F.array_except(keys, known)) == 0, F.lit(False))
    rows = lines.withColumn("ok", F.assert_true(good, F.concat(F.lit("unknown key or no object: "), F.left("value", F.lit(200)))))
    rows = rows.filter("ok IS NULL").select(F.from_json("value", GOLDEN).alias("q")).select("q.*")
    rows = rows.withColumn("ok", F.assert_true(F.col("question").isNotNull(), F.lit("a line has no question"))).filter("ok IS NULL").drop("ok")
    return rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.substring(F.md5(F.col("question").cast("binary")), 1, 12)).otherwise(F.col("id")))


def write_golden(questions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    questions.select(*[c for c in GOLDEN.fieldNames() if c in questions.columns]).write.mode(mode).json(path)


def add_golden(questions: DataFrame, path: str) -> None:
    """Adds questions to a set."""
    write_golden(questions, path, "append")


#: What the built-in evaluation set asks about: a subject, the file it is told in, and what is told.
SAMPLE = (
    ("retrieval", "intro.txt", "passages are fetched before an answer is written"),
    ("grounding", "intro.txt", "every claim names the passage it comes from"),
    ("abstention", "intro.txt", "an answer that no passage supports is withheld"),
    ("keyword search", "search.txt", "rare words of a question weigh more than common ones"),
    ("vector search", "search.txt", "passages near in meaning are found whatever their words"),
    ("rank fusion", "search.txt", "two rankings are joined by the places in both"),
    ("page references", "search.txt", "a question that names a page reads that page"),
    ("reranking", "rerank.txt", "pairs of question and passage are scored together"),
    ("candidate lists", "rerank.txt", "more passages are fetched than are kept"),
    ("recall", "evaluation.txt", "the share of expected sources that were found"),
    ("precision", "evaluation.txt", "the share of found passages that were expected"),
    ("reciprocal rank", "evaluation.txt", "one over the place of the first expected source"),
    ("regression gates", "evaluation.txt", "a run fails where a metric fell by more than its tolerance"),
    ("calibration", "evaluation.txt", "weights are chosen on a grid over stored rankings"),
)


def sample_golden(spark: SparkSession) -> DataFrame:
    """The built-in evaluation set of 14 questions."""
    rows = [(f"What does {subject} mean here?", f"{subject.capitalize()} means that {told}.", [source], None, None, "answer") for subject, source, told in SAMPLE]
    made = spark.createDataFrame(rows, GOLDEN)
    return made.withColumn("id", F.substring(F.md5(F.col("question").cast("binary")), 1, 12))


def sample_documents(spark: SparkSession) -> DataFrame:
    """The four documents that the built-in set asks about: (doc_id, text)."""
    texts: dict[str, list[str]] = {}
    for subject, source, told in SAMPLE:
        texts.setdefault(source, []).append(f"{subject.capitalize()} means that {told}.")
    return spark.createDataFrame([(name, "\n\n".join(parts)) for name, parts in texts.items()], "doc_id string, text string")


def write_results(results: DataFrame, summary: DataFrame, path: str, least: float = 0.7, at: float | None = None) -> str:
    """Results and summary of an evaluation under a folder named by its time; the summary says whether the threshold was met."""
    home = f"{path}/eval_{time.strftime('%Y%m%d_%H%M%S', time.gmtime(at))}"
    results.write.json(f"{home}/results")
    ci_summary(summary, least).coalesce(1).write.json(f"{home}/summary")
    return home


def ci_summary(summary: DataFrame, least: float = 0.7) -> DataFrame:
    """The one row that a build reads."""
    return summary.withColumn("threshold_met", F.coalesce(F.col("avg_faithfulness") >= least, F.lit(False))).withColumn("faithfulness_threshold", F.lit(least))


def report(summary: DataFrame, results: DataFrame, most: int = 50) -> str:
    """A summary row and the first results as text: a report for people."""
    top = summary.first().asDict()
    lines = [f"{name}: {value}" for name, value in top.items()]
    for n, r in enumerate(results.orderBy("qid").limit(most).collect(), 1):
        row = r.asDict()
        marks = ", ".join(f"{c} {row[c]:.4f}" for c in ("faithfulness", "relevance", "context_precision", "context_recall") if row.get(c) is not None)
        lines.append(f"{n}. [{'PASS' if row.get('passed') else 'FAIL'}] {str(row.get('question', row['qid']))[:60]}  {marks}")
    return "\n".join(lines)


def as_payload(value: Any) -> str:
    """A job's payload as text."""
    return json.dumps(value, sort_keys=True)
