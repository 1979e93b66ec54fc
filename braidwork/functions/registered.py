"""Functions for SQL and adapters for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.operators.chunking import STRATEGIES


@F.udtf(returnType="chunk_index int, content string")
class ChunkText:
    """chunk_text(text, strategy, size, overlap): the chunks of a text, as a table function."""

    def eval(self, text: str, strategy: str, size: int, overlap: int):
        if strategy not in STRATEGIES or overlap >= size:
            raise ValueError(f"no strategy {strategy!r}, or overlap {overlap} is not smaller than {size}")
        kept = (piece.strip() for piece in STRATEGIES[strategy](text or "", size, overlap))
        for at, piece in enumerate(p for p in kept if p):
            yield at, piece


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)


def embedder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> Callable[[Column], Column]:
    """A model as a column function string -> array<float>. load runs once per task and gives what encodes a list of texts; null texts give null."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            given = texts[texts.notna()]
            vectors = pd.Series([list(map(float, v)) for v in encode(given.tolist())] if len(given) else [], index=given.index, dtype=object)
            yield vectors.reindex(texts.index).where(texts.notna(), None)

    return embed


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]]) -> Callable[[Column, Column], Column]:
    """A model of pairs as a column function (question, document) -> double."""
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for questions, documents in batches:
            yield pd.Series(list(map(float, predict(list(zip(questions.fillna(""), documents.fillna(""), strict=True))))), dtype=float)

    return score
