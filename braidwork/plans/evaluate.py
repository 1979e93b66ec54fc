"""Evaluation runs: judged answers of a question set, with and without repairs, and retrieval by mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import json_object, lexical_overlap, sentences
from braidwork.operators import evaluation, ingest, retrieval
from braidwork.operators.chunking import chunk_documents
from braidwork.plans.search import Library, answer, healed, search
from braidwork.sources.shared import written

#: Answers and passages -> a reply in JSON, as a judging model gives it.
Judge = Callable[[Column, Column], Column]


def overlap_judge(claim: Column, evidence: Column) -> Column:
    """A stand-in for a judging model: the share of the claim's content words that the evidence has, as a reply."""
    share = F.round(lexical_overlap(claim, evidence), 4)
    return F.to_json(F.struct(share.alias("score"), (share >= 0.7).alias("verdict")))


def judged_score(reply: Column, fields: tuple[str, str]) -> Column:
    """struct<score, verdict, explanation> of a judge's reply, whose object names them as fields or plainly; a reply without one counts as its word true or false."""
    parsed = json_object(reply)
    score = F.coalesce(*[F.get_json_object(parsed, f"$.{n}").try_cast("double") for n in (fields[0], "score")])
    verdict = F.coalesce(*[F.get_json_object(parsed, f"$.{n}").try_cast("boolean") for n in (fields[1], "verdict")])
    low = F.lower(reply)
    guess = F.coalesce(F.contains(low, F.lit("true")) & ~F.contains(low, F.lit("false")), F.lit(False))
    plain = parsed.isNull()
    score = F.when(plain, guess.cast("double")).otherwise(F.coalesce(score, F.lit(0.0)))
    return F.struct(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), F.when(plain, guess).otherwise(F.coalesce(verdict, F.lit(False))).alias("verdict"), F.get_json_object(parsed, "$.explanation").alias("explanation"))


def faithfulness(answer_: Column, contexts: Column, judge: Judge = overlap_judge) -> Column:
    """Whether the passages support an answer."""
    return judged_score(judge(answer_, contexts), ("faithfulness_score", "faithful"))


def relevance(question: Column, answer_: Column, judge: Judge = overlap_judge) -> Column:
    """Whether an answer is about the question."""
    return judged_score(judge(question, answer_), ("relevance_score", "relevant"))


def run(library: Library, golden: DataFrame, k: int = 5, threshold: float = 0.7, judge: Judge = overlap_judge, self_heal: bool = False, **options: Any) -> DataFrame:
    """One row per question of a set (id, question, reference_answer): the answer, its four scores, and whether it passed.

    All questions run together. Context precision is the mean precision at the relevant passages, recall the share of
    the reference's sentences that the passages hold.
    """
    asked = golden.select(F.col("id").alias("qid"), "question", "reference_answer")
    hits = written(search(library, asked.select("qid", "question"), k, **options), "hits")
    answers = healed(library, asked.select("qid", "question")) if self_heal else answer(library, asked.select("qid", "question"), k, **options)
    if "status" not in answers.columns:
        answers = answers.withColumn("status", F.lit("passed")).withColumn("attempts", F.lit(1))
    packed = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda h: h["document"]).alias("documents"))
    rows = asked.join(answers.select("qid", "answer", "status", "attempts"), "qid", "left").join(packed, "qid", "left")
    rows = rows.withColumn("documents", F.coalesce("documents", F.array().cast("array<string>"))).withColumn("answer", F.coalesce("answer", F.lit("")))
    bare = F.regexp_replace(F.col("answer"), r"(?s)\n\nSources:\n.*$", "")
    shown = F.array_join("documents", "\n\n")
    relevant = F.transform("documents", lambda d: lexical_overlap(F.coalesce("reference_answer", F.lit("")), d) >= 0.5)
    hit_at = F.transform(relevant, lambda r, i: F.when(r, F.size(F.filter(F.slice(relevant, 1, i + 1), lambda x: x)) / (i + 1)))
    found = F.filter(hit_at, lambda p: p.isNotNull())
    precision = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, p: a + p) / F.size(found)).otherwise(0.0)
    said = F.filter(sentences(F.coalesce("reference_answer", F.lit(""))), lambda s: F.trim(s) != "")
    recall = F.when(F.size(said) > 0, F.size(F.filter(said, lambda s: lexical_overlap(s, shown) >= 0.5)) / F.size(said)).otherwise(0.0)
    rows = rows.withColumn("f", faithfulness(bare, shown, judge)).withColumn("r", relevance(F.col("question"), bare, judge))
    rows = rows.select("qid", "question", "answer", "status", "attempts", F.col("f.score").alias("faithfulness"), F.col("r.score").alias("relevance"), F.round(precision, 4).alias("context_precision"), F.round(recall, 4).alias("context_recall"), F.size("documents").alias("contexts_used"))
    return rows.withColumn("passed", (F.col("faithfulness") >= threshold) & (F.col("relevance") >= threshold))


def compared(library: Library, golden: DataFrame, **options: Any) -> tuple[DataFrame, DataFrame]:
    """A set answered twice, plainly and with repairs: one row per question with both, and wins, losses and ties in faithfulness."""
    plain, repaired = written(run(library, golden, **options), "plain"), written(run(library, golden, self_heal=True, **options), "repaired")
    old = plain.select("qid", F.col("faithfulness").alias("baseline_faithfulness"), F.col("relevance").alias("baseline_relevance"), F.col("passed").alias("baseline_passed"))
    new = repaired.select("qid", F.col("faithfulness").alias("final_faithfulness"), F.col("relevance").alias("final_relevance"), "status", "attempts")
    return old.join(new, "qid"), evaluation.paired(plain, repaired, "faithfulness")


@dataclass
class Harness:
    """A library of its own, made of documents (doc_id, text), and its question set: (id, question, expected_sources)."""

    library: Library
    questions: DataFrame

    @classmethod
    def of(cls, documents: DataFrame, golden: DataFrame, size: int = 800, overlap: int = 150, embed: Callable[[Column], Column] = retrieval.hashed_embedding) -> Harness:
        """Chunks and indexes the documents; questions without expected sources are left out."""
        chunks = chunk_documents(documents.select("doc_id", F.col("text").alias("content")), "recursive", size, overlap).filter("kind = 'chunk'")
        rows = chunks.select("id", F.col("content").alias("document"), F.col("doc_id").alias("source"), F.col("doc_id").alias("filename"), "page", F.coalesce("is_last_page", F.lit(False)).alias("is_last_page"), "chunk_index", F.lit("shared").alias("owner"), F.lit(False).alias("restricted"), embed(F.col("content")).alias("embedding"))
        rows = written(rows, "chunks")
        counts = chunks_per_source(rows)
        asked = golden.filter(F.size("expected_sources") > 0).select(F.col("id").alias("qid"), "question", F.col("expected_sources").alias("expected"))
        relevant = asked.select("qid", F.explode(F.array_distinct("expected")).alias("source")).join(counts, "source").groupBy("qid").agg(F.sum("chunks").alias("relevant_in_corpus"))
        return cls(Library.of(rows), written(asked.join(relevant, "qid", "left").fillna(0, ["relevant_in_corpus"]), "questions"))

    def ranked(self, mode: str, k: int) -> DataFrame:
        """Sources in order of rank: mode is vector, hybrid, or hybrid+rerank."""
        return search(self.library, self.questions.select("qid", "question"), k, hybrid=mode != "vector", rerank=mode.endswith("rerank")).select("qid", "rank", "source")

    def scores(self, k: int = 5, modes: tuple[str, ...] = ("vector", "hybrid", "hybrid+rerank")) -> DataFrame:
        """Mean metrics of each mode."""
        out = None
        for mode in modes:
            row = evaluation.mean_scores(evaluation.query_scores(self.ranked(mode, k), self.questions, k)).withColumn("mode", F.lit(mode))
            out = row if out is None else out.unionByName(row)
        return out


def chunks_per_source(chunks: DataFrame, source: str = "source") -> DataFrame:
    return chunks.groupBy(source).agg(F.count("*").alias("chunks"))


def language_totals(chunks: DataFrame, lang: str = "lang") -> DataFrame:
    """Chunks of each language, and of all (null)."""
    return chunks.rollup(lang).agg(F.count("*").alias("chunks"))


def by_language(chunks: DataFrame, langs: tuple[str, ...], lang: str = "lang") -> DataFrame:
    """The rows of some languages, each once: that of the first language in order where several hold an id."""
    return ingest.first_language(chunks.filter(F.col(lang).isin(*langs)), lang=lang)
