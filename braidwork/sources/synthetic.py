"""Made inputs: questions from templates, and clustered vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = ("What is {t}?", "How does {t} work here?", "What are the limits of {t}?", "Where is {t} used? Case {n}.", "Why is {t} needed?", "Which part of {t} comes first?")
TOPICS = ("keyword search", "vector search", "rank fusion", "reranking", "chunking", "page numbers", "citations", "evaluation", "near duplicates", "access scope")


def made_questions(spark: SparkSession, n: int, seed: int = 7, templates: tuple[str, ...] = TEMPLATES, topics: tuple[str, ...] = TOPICS) -> DataFrame:
    """(qid, question): n distinct questions, each of a template and a topic drawn by the hash of its number."""
    def drawn(options: tuple[str, ...], salt: int):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(len(options))) + 1).cast("int"))

    number = F.col("id").cast("string")
    text = F.replace(F.replace(drawn(templates, 1), F.lit("{t}"), drawn(topics, 2)), F.lit("{n}"), number)
    return spark.range(n).select(F.col("id").alias("qid"), F.concat(text, F.lit(" (ref "), number, F.lit(")")).alias("question"))


def made_vectors(spark: SparkSession, n: int, dim: int = 64, noise: float = 1.2, seed: int = 0, rows: int = 10_000) -> DataFrame:
    """(id, label, embedding): n vectors around max(n / 1000, 10) centres; a centre and a row depend on their numbers only, whatever the partitions."""
    centres = max(n // 1000, 10)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                rng = np.random.default_rng([seed, 1, i])
                label = int(rng.integers(centres))
                centre = np.random.default_rng([seed, 0, label]).normal(size=dim)
                out.append((i, label, (centre + noise * rng.normal(size=dim)).astype(np.float32).tolist()))
            yield pd.DataFrame(out, columns=["id", "label", "embedding"])

    return spark.range(0, n, 1, max(1, -(-n // rows))).mapInPandas(run, "id long, label int, embedding array<float>")


def made_queries(vectors: DataFrame, n: int, noise: float = 0.8, seed: int = 0) -> DataFrame:
    """(qid, query_vector): n of the vectors by the hash of their id, each moved a little; a sample by intent."""
    chosen = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
    moved = F.transform("embedding", lambda x, i: (x + noise * F.sqrt(F.lit(2.0)) * (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * 2).cast("double"))
    return chosen.select(F.col("id").alias("qid"), moved.alias("query_vector"))
