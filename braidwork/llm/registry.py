"""Registered queries of the corpus operators: thin callers that fix the production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import ann, language, licenses, merkle, pii, quality
from braidwork.llm.common import crc_bucket, shared_dir, table
from braidwork.llm.jaccard import jaccard_components
from braidwork.llm.mixing import mix_sources, word_count
from braidwork.llm.packing import pack
from braidwork.llm.repeats import remove_repeats
from braidwork.llm.repetition import repetition
from braidwork.llm.spelling import spelling_variants
from braidwork.llm.tokens import read_tokens, token_pieces, write_tokens


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("license_ids", F.array_join("license_ids", ","))


#: Bounds of the training samples: labelled rows in all, and rows of each language.
QUALITY_SAMPLE, LANGUAGE_SAMPLE = 3000, 150


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    sample = quality.labelled_sample(docs, labels, "quality", QUALITY_SAMPLE)
    model = quality.train(sample.column(0).to_pylist(), sample.column(1).to_pylist())
    scored = quality.score(docs, model, positive=1)
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    tagger = language.train(*language.language_sample(docs.filter(~held_out), LANGUAGE_SAMPLE))
    return language.identify(docs.select("doc_id", "text"), tagger).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/braidwork/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path(), end_id=2)
    return read_tokens(spark, out).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, k=4)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), least=200)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(merkle.document_leaves(docs, crc_bucket(F.col("doc_id"), 3) == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_nearest": op4_nearest,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_tokens": op7_tokens,
    "op8_language": op8_language,
    "op9_repetition": op9_repetition,
    "op10_jaccard": op10_jaccard,
    "op11_repeats": op11_repeats,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op2_licenses": licenses.oracle(), "op13_merkle": merkle.oracle()}
