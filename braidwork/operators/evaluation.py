"""Retrieval metrics, summaries, regression gate and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric names and the calibration grid.
METRICS = ("recall", "precision", "mrr", "ndcg", "hit_rate")
ALPHAS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
RRF_KS = (10, 30, 60, 100)


def query_scores(hits: DataFrame, questions: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The five metrics of each question. hits: (by..., rank from 0, source); questions: (qid, expected array, relevant_in_corpus). Questions without hits score 0."""
    top = hits.filter(F.col("rank") < k).join(questions, "qid")
    rel = F.array_contains("expected", F.col("source"))
    place = F.col("rank") + 1
    got = top.groupBy(*by).agg(
        F.size(F.array_distinct(F.collect_list(F.when(rel, F.col("source"))))).alias("_found"),
        F.sum(rel.cast("int")).alias("_rel"),
        F.min(F.when(rel, place)).alias("_first"),
        F.sum(F.when(rel, 1.0 / F.log2(place + 1)).otherwise(0.0)).alias("_dcg"),
    )
    frame = questions if by == ("qid",) else questions.join(hits.select(*by).distinct(), "qid")
    all_q = frame.join(got, list(by), "left")
    ideal = F.least(F.lit(k), F.col("relevant_in_corpus").cast("int"))
    idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))
    n = F.size(F.array_distinct("expected"))
    return all_q.select(
        *by,
        F.coalesce(F.when(n > 0, F.col("_found") / n), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("_rel") / k, F.lit(0.0)).alias("precision"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(ideal > 0, F.coalesce(F.col("_dcg"), F.lit(0.0)) / idcg).otherwise(0.0).alias("ndcg"),
        F.when(F.col("_first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"),
    )


def mean_scores(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in METRICS])


def average_precision(verdicts: DataFrame, by: str = "qid") -> DataFrame:
    """Mean of the precision at every relevant rank (from 1); 0 without any."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumn("_p", F.sum(F.col("relevant").cast("int")).over(w) / F.col("rank"))
    return at.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_p"))), F.lit(0.0)), 4).alias("average_precision"))


def rate(hits: Column, of: Column) -> Column:
    """Share of rows with `of` that have `hits`, to 4 digits; null without any."""
    n = F.count_if(of)
    return F.when(n > 0, F.round(F.count_if(hits & of) / n, 4))


def mean(value: Column, of: Column) -> Column:
    return F.round(F.avg(F.when(of, value)), 4)


def eval_summary(results: DataFrame) -> DataFrame:
    """Counts, averages and rates over evaluated answers."""
    four = lambda c: F.round(c, 4)
    return results.agg(
        F.count("*").alias("count"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        four(F.avg("faithfulness")).alias("avg_faithfulness"),
        four(F.min("faithfulness")).alias("min_faithfulness"),
        four(F.max("faithfulness")).alias("max_faithfulness"),
        four(F.count_if("passed") / F.count("*")).alias("pass_rate"),
        four(F.avg("relevance")).alias("avg_answer_relevance"),
        four(F.avg("context_precision")).alias("avg_context_precision"),
        four(F.avg("context_recall")).alias("avg_context_recall"),
        F.round(F.avg("contexts_used"), 1).alias("avg_contexts_used"),
    )


def healing_summary(records: DataFrame, faithfulness: float = 0.7, relevance: float = 0.7) -> DataFrame:
    """Conditional rates and means of repaired answers; a rate over no rows is null."""
    all_rows, failed, abstained = F.lit(True), F.col("first_attempt_failed"), F.col("abstained")
    answered = ~abstained
    base_ok = F.coalesce((F.col("baseline_faithfulness") >= faithfulness) & (F.col("baseline_relevance") >= relevance) & ~F.col("baseline_refused"), F.lit(False))
    retrieval_side = F.coalesce(F.col("first_failure_type").isin("retrieval_failure", "query_failure"), F.lit(False))
    heal, base = F.coalesce(F.round(F.avg("healed_latency"), 4), F.lit(0.0)), F.coalesce(F.round(F.avg("baseline_latency"), 4), F.lit(0.0))
    return records.agg(
        F.count("*").alias("count"),
        rate(failed, all_rows).alias("initial_failure_rate"),
        rate(failed & retrieval_side, all_rows).alias("initial_retrieval_failure_rate"),
        rate(F.col("recovered"), failed).alias("healing_success_rate"),
        mean(F.col("attempts").cast("double"), all_rows).alias("avg_healing_attempts"),
        mean(F.col("final_faithfulness"), answered).alias("final_faithfulness"),
        mean(F.col("final_relevance"), answered).alias("final_relevance"),
        rate(F.col("citation_valid"), answered & F.col("citation_valid").isNotNull()).alias("citation_validity_rate"),
        rate(abstained, all_rows).alias("abstention_rate"),
        rate(abstained, F.col("expected_behavior") == "abstain").alias("correct_abstention_rate"),
        rate(abstained, F.col("expected_behavior") == "answer").alias("false_abstention_rate"),
        rate(base_ok, failed).alias("false_positive_healing_rate"),
        F.round(heal - base, 4).alias("avg_latency_overhead_seconds"),
        F.when(base > 0, F.round(heal / base, 3)).alias("latency_overhead_ratio"),
    )


def regressions(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Metrics that fell by more than tolerance: (mode, metric, before, after, drop). Both sides: (mode, metrics...)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(["mode"], list(METRICS), "metric", name)

    pairs = long(baseline, "before").join(long(current, "after"), ["mode", "metric"])
    return pairs.withColumn("drop", F.col("before") - F.col("after")).filter(F.col("drop") > tolerance)


def same_identity(baseline: dict, current: dict) -> list[str]:
    """Names of inputs that differ: scores are comparable only where there are none."""
    return sorted(k for k in baseline.keys() | current.keys() if baseline.get(k) != current.get(k))


def calibration(dense: DataFrame, sparse: DataFrame, questions: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Mean metrics of every (alpha, rrf_k): one retrieval pass serves the whole grid. sources: (id, source).

    A question's hits of both rankings come together once, as a list of their ranks and of which expected source each
    stands for; a task ranks that list for every setting and sends on the sums over its questions, 44 rows a batch.
    Questions (qid, expected, relevant_in_corpus) without a hit of a known source do not count.
    """
    both = dense.select("qid", "id", F.col("rank").alias("d")).join(sparse.select("qid", "id", F.col("rank").alias("s")), ["qid", "id"], "full_outer")
    asked = questions.select("qid", F.array_distinct("expected").alias("expected"), F.col("relevant_in_corpus").cast("int").alias("relevant"))
    placed = both.join(sources, "id", "left").join(asked, "qid")
    # the place of the source among the expected ones: 0 for another source, -1 for none
    which = F.coalesce(F.array_position("expected", F.col("source")), F.lit(-1)).cast("int")
    lists = placed.groupBy("qid").agg(F.first(F.size("expected")).alias("n"), F.first("relevant").alias("relevant"), F.sort_array(F.collect_list(F.struct("id", "d", "s", which.alias("which")))).alias("hits"))
    settings = [(a, r) for a in ALPHAS for r in RRF_KS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((len(settings), len(METRICS))), 0
        for batch in batches:
            for n, relevant, hits in zip(batch.column("n").to_pylist(), batch.column("relevant").to_pylist(), batch.column("hits"), strict=True):
                got = hits.values
                which = got.field("which").to_numpy(zero_copy_only=False)
                if (which < 0).all():
                    continue
                count += 1
                d, s = (np.where(np.isnan(x), k, x) for x in (got.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("d", "s")))
                sums += [_graded(which, d, s, alpha, rrf, k, n, relevant) for alpha, rrf in settings]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in settings]), pa.array([r for _, r in settings], pa.int32()), pa.array([count] * len(settings), pa.int64()), *[pa.array(sums[:, i]) for i in range(len(METRICS))]], names=["alpha", "rrf_k", "count", *METRICS])

    partial = lists.mapInArrow(run, "alpha double, rrf_k int, count long, " + ", ".join(f"{m} double" for m in METRICS))
    return partial.groupBy("alpha", "rrf_k").agg(F.sum("count").alias("_n"), *[F.sum(m).alias(m) for m in METRICS]).filter("_n > 0").select("alpha", "rrf_k", *[F.round(F.col(m) / F.col("_n"), 4).alias(m) for m in METRICS])


def _graded(which: np.ndarray, d: np.ndarray, s: np.ndarray, alpha: float, rrf: int, k: int, n: int, relevant: int) -> list[float]:
    """The five metrics of one question under one setting; hits are in order of id, which decides ties."""
    score = alpha / (rrf + d + 1) + (1.0 - alpha) / (rrf + s + 1)
    order = np.argsort(-score, kind="stable")[:k]
    good = np.flatnonzero(which[order] > 0)
    gains = 1.0 / np.log2(good + 2)
    ideal = min(k, relevant) if relevant is not None else 0
    best = sum(1.0 / np.log2(r + 1) for r in range(1, ideal + 1))
    found = len(np.unique(which[order][good]))
    return [found / n if n else 0.0, len(good) / k, 1.0 / (good[0] + 1) if len(good) else 0.0, float(gains.sum()) / best if ideal > 0 else 0.0, 1.0 if len(good) else 0.0]


def best_setting(grid: DataFrame, metric: str, alpha: float = 0.6, rrf_k: int = 60) -> DataFrame:
    """The best cell; among equals the one nearest the default."""
    return grid.orderBy(F.desc(metric), F.abs(F.col("alpha") - alpha), F.abs(F.col("rrf_k") - rrf_k), "alpha", "rrf_k").limit(1)


def gate(summary: DataFrame, column: str = "avg_faithfulness", least: float = 0.7) -> DataFrame:
    """Fails the job where the average is below the threshold."""
    return summary.filter(F.assert_true(F.col(column) >= least, F.lit(f"{column} is below {least}")).isNull())


def recall_of(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true neighbours found, per query: both (qid, id)."""
    hit = found.join(truth, ["qid", "id"], "left_semi").groupBy("qid").agg((F.count("*") / k).alias("recall"))
    return truth.select("qid").distinct().join(hit, "qid", "left").fillna(0.0, ["recall"])


def context_recall(statements: DataFrame) -> DataFrame:
    """Share of a reference answer's statements (qid, attributed) that the contexts support, to 4 digits."""
    return statements.groupBy("qid").agg(F.round(F.avg(F.col("attributed").cast("double")), 4).alias("context_recall"))


def paired(baseline: DataFrame, healed: DataFrame, metric: str) -> DataFrame:
    """Wins, losses and ties of one run over another, question by question (qid, metric)."""
    both = baseline.select("qid", F.col(metric).alias("_b")).join(healed.select("qid", F.col(metric).alias("_h")), "qid")
    delta = F.col("_h") - F.col("_b")
    return both.agg(F.count_if(delta > 1e-9).alias("wins"), F.count_if(delta < -1e-9).alias("losses"), F.count_if(F.abs(delta) <= 1e-9).alias("ties"))


def corpus_identity(files: DataFrame) -> DataFrame:
    """One hash over names and contents (filename, content_hash), whatever their order in the table: 16 hex digits. One short row per file is gathered."""
    line = F.concat_ws(":", "filename", "content_hash")
    return files.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 16).alias("identity"), F.count("*").alias("files"))


def search_report(found: DataFrame, truth: DataFrame, seconds: DataFrame, k: int) -> DataFrame:
    """One row on a search: mean recall@k against the true neighbours (qid, id), and interpolated percentiles of its seconds (qid, seconds)."""
    recall = recall_of(found, truth, k).agg(F.avg("recall").alias("recall"))
    times = seconds.agg(*[F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY seconds)").alias(f"p{round(100 * p)}") for p in (0.5, 0.95)])
    return recall.crossJoin(times)
