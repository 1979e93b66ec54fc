"""Files as documents, evaluation sets, result and audit sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is loaded, and limits.
SUFFIXES = ("txt", "md", "pdf", "json")
MAX_BYTES, MAX_PAGES = 50 * 1024 * 1024, 1000
SKIPPED = ("ingest_jobs.json",)

GOLDEN = T.StructType([T.StructField("question", T.StringType()), T.StructField("reference_answer", T.StringType()), T.StructField("expected_sources", T.ArrayType(T.StringType())), T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("expected_behavior", T.StringType())])


def scan_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents of a file or under a folder, and files that are refused with the reason. A path that is not there raises FileNotFoundError.

    Text, Markdown and JSON are decoded as UTF-8 with bad bytes replaced; a PDF is passed on as bytes for a parser of
    the caller's. Listing, size and hash come from one scan; a bad file costs a row, never the job.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(folder)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index("path", "/", -1)
    kind = F.lower(F.substring_index(name, ".", -1))
    files = raw.withColumn("filename", name).withColumn("filetype", F.concat(F.lit("."), kind))
    if not system.getFileStatus(where).isFile():  # a file that is named is taken whatever its suffix
        files = files.filter(kind.isin(*SUFFIXES) & ~F.col("filename").isin(*SKIPPED))
    reason = F.when(F.col("length") > max_bytes, "too large")
    refused = files.withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "filename", "length", "reason")
    text = F.when(F.col("filetype") != ".pdf", F.expr("make_valid_utf8(cast(content AS string))"))
    docs = files.filter(F.col("length") <= max_bytes).select(F.col("path").alias("source"), "filename", "filetype", F.sha2("content", 256).alias("content_hash"), F.substring(F.sha2("content", 256), 1, 16).alias("version_id"), F.col("modificationTime").alias("file_modified_at"), text.alias("content"), F.when(F.col("filetype") == ".pdf", F.col("content")).alias("data"))
    return docs, refused


def paged(docs: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Documents with page texts: content is the pages with an empty line between; those of too many pages go."""
    kept = docs.filter(F.coalesce(F.size("pages"), F.lit(0)) <= most)
    return kept.withColumn("content", F.when(F.size("pages") > 0, F.array_join("pages", "\n\n", "")).otherwise(F.col("content")))


def pdf_date(modified: Column, created: Column) -> Column:
    """The date of a PDF, from its modification date else its creation date as they stand in the file (D:YYYYMMDDHHmmSS with an offset); without an offset it is UTC, without a time midnight."""
    def parsed(text: Column) -> Column:
        said = F.regexp_extract(text, "^(?:D:)?([0-9]{4,14})", 1)
        full = F.concat(said, F.substring(F.lit("00000101000000"), F.length(said) + 1, F.lit(14)))
        sign, hours, minutes = (F.regexp_extract(text, r"([+-])([0-9]{2})'?([0-9]{2})?'?$", g) for g in (1, 2, 3))
        offset = F.when(sign == "", F.lit("+00:00")).otherwise(F.concat(sign, hours, F.lit(":"), F.when(minutes == "", "00").otherwise(minutes)))
        return F.when(said != "", F.try_to_timestamp(F.concat(full, offset), F.lit("yyyyMMddHHmmssXXX")))

    return F.coalesce(parsed(modified), parsed(created))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, entities of five kinds are resolved, blanks are squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|noscript)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|li|tr|h[1-6]|br|section|article)\b[^>]*>", "\n"), r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    lines = F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; a blank id is the start of the question's md5."""
    rows = spark.read.schema(GOLDEN).json(path).filter(F.col("question").isNotNull())
    return rows.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.substring(F.md5(F.col("question").cast("binary")), 1, 12)).otherwise(F.col("id")))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)
