"""Request logs: limits, error spans, percentiles, trends and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.scans import Ordered, exact_ranks


def limited(events: DataFrame, most: int = 20, seconds: float = 300.0, key: str = "user_id", at: str = "ts") -> DataFrame:
    """events with in_window, the attempts of their key in the last `seconds` (older by exactly that much is out), and blocked.

    Time is cut into spans of that length, and an event stands in its own span and the next: a window holds two spans
    of a key, however many events the key has.
    """
    micros, width = F.unix_micros(F.col(at).cast("timestamp")), int(seconds * 1_000_000)
    span = F.floor(F.col("_us") / width)
    both = F.explode(F.array(F.struct(span.alias("at"), F.lit(True).alias("own")), F.struct((span + 1).alias("at"), F.lit(False).alias("own"))))
    w = Window.partitionBy(key, "_s.at").orderBy("_us").rangeBetween(-width + 1, 0)
    counted = events.withColumn("_us", micros).withColumn("_s", both).withColumn("in_window", F.count("*").over(w))
    return counted.filter("_s.own").withColumn("blocked", F.col("in_window") >= most).drop("_us", "_s")


def error_windows(events: DataFrame, failed: Column, gap: float = 5.0, by: str | None = None, at: str = "ts") -> DataFrame:
    """Spans of failures at most `gap` seconds apart: first, last, failures. Successes in between end none.

    Failures are put in order by ranges; where a span begins is told from the failure before, also across the edge of a
    range, and spans are numbered by a running sum. No task holds all failures of a key, or of a table without one.
    """
    keys = [by] if by else []
    bad = Ordered.of(events.filter(failed).select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("t")), keys, ["t"])
    bad = bad.previous("t", "_before")
    begins = F.col("_before").isNull() | (F.col("t") - F.col("_before") > int(gap * 1_000_000))
    rows = bad.total(begins.cast("int"), "_span").result()
    whole = rows.groupBy(*keys, "_span").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("failures"))
    return whole.select(*keys, F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), "failures")


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles: the smallest value that at least that share of the group does not exceed."""
    return exact_ranks(rows, value, {f"p{round(s * 100)}": F.greatest(F.ceil(F.col("n") * s) - 1, F.lit(0)) for s in shares}, by)


def floor_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()) -> DataFrame:
    """The value at place floor(n * share) from 0 in order."""
    return exact_ranks(rows, value, {f"p{round(s * 100)}": F.least(F.floor(F.col("n") * s), F.col("n") - 1) for s in shares}, by)


def memory_trend(samples: DataFrame, at: str = "t", value: str = "mb") -> DataFrame:
    """MB per minute over the second half of the time, by least squares; null for under three samples."""
    last = samples.agg(F.max(at).alias("_last"))
    half = samples.crossJoin(F.broadcast(last)).filter(F.col(at) >= F.col("_last") / 2)
    return half.agg(F.when(F.count("*") >= 3, F.round(F.regr_slope(value, at) * 60, 2)).alias("trend"))


def phase_summary(requests: DataFrame, by: str = "phase") -> DataFrame:
    """Requests, rate, error rate and latencies of load-test phases: (phase, t, ok, ms)."""
    seconds = F.greatest(F.max("t") - F.min("t"), F.lit(1e-9))
    counts = requests.groupBy(by).agg(F.count("*").alias("requests"), F.round(F.count("*") / seconds, 2).alias("per_second"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("error_rate"), F.max("ms").alias("max_ms"))
    ranks = percentiles(requests, "ms", by=(by,)).select(F.col(by).alias("_by"), *[F.col(p).alias(f"{p}_ms") for p in ("p50", "p95", "p99")])
    both = counts.join(ranks, F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, "requests", "per_second", "error_rate", "p50_ms", "p95_ms", "p99_ms", "max_ms")


def verdict(report: DataFrame, max_error: float = 0.01, max_p95: float = 0.0, max_growth: float = 10.0) -> DataFrame:
    """Which of the five limits a load test broke. report: one row of soak_error_rate, soak_p95_ms, recovery_error_rate, baseline_p50_ms, recovery_p50_ms, trend."""
    broken = F.array(
        F.when(F.col("soak_error_rate") > max_error, "soak error rate"),
        F.when((F.lit(max_p95) > 0) & (F.col("soak_p95_ms") > max_p95), "soak p95"),
        F.when(F.col("recovery_error_rate") > 0, "recovery errors"),
        F.when((F.col("baseline_p50_ms") > 0) & (F.col("recovery_p50_ms") > 2 * F.col("baseline_p50_ms")), "recovery latency"),
        F.when(F.col("trend") > max_growth, "memory growth"),
    )
    return report.withColumn("problems", F.filter(broken, lambda b: b.isNotNull()))


def outcome(status: Column) -> Column:
    return F.when(status < 400, "success").when(status.isin(401, 403, 429), "denied").otherwise("failure")


# Routes whose requests are recorded.
ROUTES = {
    ("POST", "/auth/register"): "auth.register",
    ("POST", "/auth/login"): "auth.login",
    ("POST", "/auth/logout"): "auth.logout",
    ("POST", "/upload"): "document.upload",
    ("POST", "/ingest"): "document.ingest",
    ("POST", "/ingest/async"): "document.ingest_queued",
    ("POST", "/ingest/jobs/{job_id}/cancel"): "ingest_job.cancel",
    ("POST", "/ingest/jobs/{job_id}/retry"): "ingest_job.retry",
    ("POST", "/query"): "query",
    ("POST", "/query/stream"): "query",
    ("POST", "/chats/{chat_id}/messages"): "query",
    ("GET", "/chunks/{chunk_id}"): "passage.read",
    ("POST", "/chats/import"): "chat.import",
    ("POST", "/chats/{chat_id}/files"): "chat.files_add",
    ("DELETE", "/chats/{chat_id}"): "chat.delete",
    ("POST", "/mcp"): "mcp.request",
}


def audited(requests: DataFrame) -> DataFrame:
    """Requests to recorded routes, and refused ones, with action and outcome."""
    routes = F.create_map(*[F.lit(x) for (m, p), a in ROUTES.items() for x in (f"{m} {p}", a)])
    named = F.try_element_at(routes, F.concat_ws(" ", "method", "path"))
    action = F.coalesce(named, F.when(F.col("status") == 403, "access.denied"))
    return requests.withColumn("action", action).filter("action IS NOT NULL").withColumn("outcome", outcome(F.col("status")))


def request_counts(requests: DataFrame, by: tuple[str, ...], value: str, edges: tuple[float, ...]) -> DataFrame:
    """Counts and a cumulative histogram of `value` by label columns."""
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(value).alias("total"), *[F.count_if(F.col(value) <= e).alias(f"le_{e:g}".replace(".", "_")) for e in edges])


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage (id, model, prompt_tokens, completion_tokens) with its price by the longest matching model pattern ('*' for any text) of a price table; unknown models cost nothing."""
    # few models stand in many rows: patterns meet the distinct names only
    models = usage.select("model").distinct()
    priced = models.join(prices, F.expr("model RLIKE concat('^', replace(replace(pattern, '.', '\\\\.'), '*', '.*'), '$')"), "left")
    best = priced.groupBy("model").agg(F.max_by(F.struct("prompt_price", "completion_price"), F.length("pattern")).alias("p"))
    total = (F.col("prompt_tokens") * F.col("p.prompt_price") + F.col("completion_tokens") * F.col("p.completion_price")) / 1000
    return usage.join(best, "model", "left").select("id", "model", F.coalesce(total, F.lit(0.0)).alias("cost"))


# Upper bounds of the attempts and seconds of a repaired answer.
ATTEMPT_EDGES, SECOND_EDGES = (1, 2, 3, 4, 5, 6), (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def healing_counters(answers: DataFrame) -> DataFrame:
    """Repaired answers (status, failures, attempts, rewrites) as counters: (counter, label, value), histograms cumulative."""
    def counted(rows: DataFrame, counter: str) -> DataFrame:
        return rows.groupBy("label").agg(F.count("*").alias("value")).select(F.lit(counter).alias("counter"), "label", "value")

    out = counted(answers.select(F.col("status").alias("label")), "outcome")
    out = out.unionByName(counted(answers.select(F.explode("failures").alias("label")), "failure"))
    edges = answers.agg(*[F.count_if(F.col("attempts") <= e).alias(str(e)) for e in ATTEMPT_EDGES], F.sum(F.size("rewrites")).alias("rewrites"), F.count("*").alias("n"))
    names = [str(e) for e in ATTEMPT_EDGES]
    histogram = edges.select(F.inline(F.array(*[F.struct(F.lit("attempts_le").alias("counter"), F.lit(e).alias("label"), F.col(e).alias("value")) for e in names], F.struct(F.lit("attempts_le").alias("counter"), F.lit("+Inf").alias("label"), F.col("n").alias("value")), F.struct(F.lit("rewrites").alias("counter"), F.lit("").alias("label"), F.coalesce("rewrites", F.lit(0)).alias("value")))))
    return out.unionByName(histogram)
