"""The corpus pipeline over `documents`: language, near duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. SQL cannot express the trained stages, so ORACLE_SQL is None; tests hold every stage against a
plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import language, pii
from braidwork.llm.common import WORD, needed, table, written
from braidwork.llm.jaccard import jaccard_components
from braidwork.llm.mixing import mixed, word_count
from braidwork.llm.packing import pack
from braidwork.llm.registry import LANGUAGE_SAMPLE, tokenizer_path
from braidwork.llm.tokens import token_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language has a smaller mean probability has no language that can be told.
SURE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; texts without a letter, null texts and texts of no sure language go.

    Every row is judged by its own text: repeated rows, null ids and ties between languages (the first in code-point
    order wins) need no care. An empty table, or one without a lang, loses all its rows. Columns besides those of
    documents are left out, whatever their names.
    """
    tagger = language.train(*language.language_sample(docs, LANGUAGE_SAMPLE))
    named = language.identify(docs.select(*COLUMNS), tagger, names=("lang_pred", "lang_score"), keep_text=True)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= SURE)
    return named.filter(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike in 80 % of their five-word shingles the smallest doc_id stays.

    Rows that share an id are judged together: they stay if one of them is its component's smallest. Of rows that share
    id and text one stays, the first by lang, source and n_chars. Rows without an id stay, since nothing names them.
    Texts without a word are alike with nothing and stay. An empty table gives an empty one; further columns are left out.
    """
    found = written(jaccard_components(docs, percent=80, k=5).filter(F.col("component_id") == F.col("doc_id")).select("doc_id"), "kept")
    kept = found.distinct()
    rows = docs.select(*COLUMNS)
    stays = rows.join(needed(kept, "kept-ids"), "doc_id", "left_semi")
    if found.count() > kept.count():  # ids that occur twice among the kept rows
        stays = stays.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_one")).select("doc_id", "text", "_one.*")
    return stays.select(*COLUMNS).unionByName(rows.filter(F.col("doc_id").isNull()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span becomes its kind in brackets; n_chars follows. Rows are independent and all stay, null texts and ids too; further columns are left out."""
    found = pii.find_spans(docs.select(*COLUMNS))
    return found.withColumn("text", pii.redacted(F.col("text"), F.col("spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, a part of a document rounded: rows repeat, or go.

    Rows are taken one by one, also those that share an id or have none. Documents without a word take nothing and go.
    An empty table gives an empty one; further columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    taken = mixed(docs.select(*COLUMNS), word_count(F.col("text")), text.rlike(WORD))
    copies = F.round("_copies").cast("int")
    return taken.filter(copies > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), copies))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in gapless sequences.

    Null and empty texts are the end id alone; repeated rows are packed as often as they stand; null ids are carried. An
    empty table gives an empty one; of the documents only ids and texts go on.
    """
    pieces = token_pieces(docs, tokenizer_path(), capacity=2048, end_id=0)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
