"""What the corpus operators share: tables, the shared folder, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words everywhere in this subpackage: the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a few MB: a Python worker and its executor hold one at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions whose settings name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own, one for the application, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="braidwork-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: short lineage that outlives lost executors, and known sizes for the next plan."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/braidwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Characters of a text that a model may learn from at most; longer ones are judged, not learned from.
LONGEST = 200_000


def sampled(key: Column, of: str, share: Column) -> Column:
    """Whether a hash of the key is below a share of all hashes, to 60 bits: of any number of rows about that share, and not none for a small one."""
    wide, fine = 1 << 20, 1 << 40
    whole = F.floor(share * wide)
    first = F.pmod(F.xxhash64(F.lit(of), key), F.lit(wide))
    rest = F.pmod(F.xxhash64(F.lit(of), F.lit("rest"), key), F.lit(fine))
    return (first < whole) | ((first == whole) & (rest < (share * wide - whole) * fine))


#: Values of a table that is broadcast at most: 4 MB of numbers, several times that as a hash table.
SMALL = 500_000


def needed(df: DataFrame, name: str) -> DataFrame:
    """A table of numbers as the small side of a join: broadcast only if its counted values are at most SMALL, else left to a shuffled join."""
    df = written(df, name)
    return F.broadcast(df) if df.count() * len(df.columns) <= SMALL else df
