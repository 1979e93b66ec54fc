"""Streams with state of their own on RocksDB: exact attempt limits, lockouts that end, job states, and ingest in steps.

The operators are stateful processors in event time. A watermark tells when a key's state can no longer matter, a timer
takes it away then; nothing waits for the wall clock, so a query over what is there (`availableNow`) ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from braidwork.operators.chunking import chunk_documents
from braidwork.operators.ingest import flagged, without_suspected
from braidwork.sources.sinks import FINISHED, exists, write_chunks, write_parents

SECOND = 1_000_000


def on_rocksdb(spark: SparkSession) -> None:
    """State on local disk with change logs in the checkpoint: it may outgrow an executor's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Keyed(StatefulProcessor):
    """What the processors share: one timer a key, moved to when its state ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def until(self, micros: int, timers: Any) -> None:
        """The key's state ends once the watermark has passed micros."""
        due = max(micros // 1000 + 1, timers.getCurrentWatermarkInMs() + 1)
        for old in list(self.handle.listTimers()):
            if old != due:
                self.handle.deleteTimer(old)
        self.handle.registerTimer(due)


class _Attempts(_Keyed):
    """Times of a key's attempts: all that an event not yet too late can still see in its window."""

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getMapState("times", "t long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([batch["t"] for batch in rows]).to_numpy()
        seen = {t[0]: n[0] for t, n in self.times.iterator()} if self.times.exists() else {}
        stale = timerValues.getCurrentWatermarkInMs() * 1000 - self.width
        for t in [t for t in seen if t <= stale]:
            self.times.removeKey((t,))
            del seen[t]
        came = pd.Series(fresh).value_counts().to_dict()
        merged, counts = sorted({*seen, *came}), dict(seen)
        inside, first, out = 0, 0, []
        for t in merged:
            while merged[first] <= t - self.width:
                inside -= counts.get(merged[first], 0)
                first += 1
            counts[t] = counts.get(t, 0) + came.get(t, 0)
            inside += counts[t]
            out.extend([(key[0], t, inside, inside >= self.most)] * came.get(t, 0))
        for t, n in came.items():
            self.times.updateValue((int(t),), (int(seen.get(t, 0) + n),))
        self.until(merged[-1] + self.width, timerValues)
        yield pd.DataFrame(out, columns=["key", "t", "in_window", "blocked"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())


class _Locks(_Keyed):
    """Failures in a row, and when the lock ends."""

    def __init__(self, failures: int, width: int, forget: int):
        self.failures, self.width, self.forget = failures, width, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "count int, locked_until long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values(["t", "ok"])
        count, until, last = self.held.get() if self.held.exists() else (0, -(1 << 62), 0)
        out, when = [], 0
        for when, good in zip(fresh["t"].tolist(), fresh["ok"].tolist(), strict=True):
            locked = when < until
            if not locked:
                count = 0 if good else count + 1 if count and when - last <= self.forget else 1
                last = last if good else when
                if count >= self.failures:
                    count, until = 0, when + self.width
            out.append((key[0], when, locked))
        if count or until > when:
            self.held.update((count, until, last))
            self.until(max(last + self.forget if count else 0, until), timerValues)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["key", "t", "locked"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())


class _Jobs(_Keyed):
    """The state of a job that is not over, or of one that is until no late change can come."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, at long, done_at long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, at, done_at, last = self.job.get() if self.job.exists() else (None, None, None, None)
        for batch in rows:
            for new, when in zip(batch["status"].tolist(), batch["at"].tolist(), strict=True):
                over = new in FINISHED
                if over and (done_at is None or (when, new) < (done_at, status)):
                    status, done_at = new, when
                elif done_at is None and (at is None or (when, new) > (at, status)):
                    status, at = new, when
                last = when if last is None else max(last, when)
        self.job.update((status, at, done_at, last))
        if done_at is not None:
            self.until(last + self.keep, timerValues)
        yield pd.DataFrame([(key[0], status, last)], columns=["job_id", "status", "updated_at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter(())


def limited_stream(events: DataFrame, most: int = 20, seconds: float = 300.0, late: str = "10 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """events -> key, t, in_window, blocked: the attempts of a key in the `seconds` up to each one, as the batch limiter counts them.

    A key's state is the times that an event no later than `late` can still count, each with its number, however many
    there are; it goes when the watermark has passed its last attempt by a window. Events later than `late` are
    dropped. Events of a key are put in order within a step: an event that comes in a later step than one it precedes
    is counted itself, and does not change what was given out. A null key is a key.
    """
    on_rocksdb(events.sparkSession)
    rows = events.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_micros(F.col(at)).alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(_Attempts(most, int(seconds * SECOND)), "key string, t long, in_window long, blocked boolean", "Append", "EventTime")


def lockouts(events: DataFrame, failures: int = 5, seconds: float = 300.0, forget: float = 86_400.0, late: str = "10 minutes", key: str = "user_id", at: str = "ts", ok: str = "ok") -> DataFrame:
    """events (key, ts, ok) -> key, t (microseconds), locked: after `failures` failed attempts in a row a key is locked for `seconds`; success clears the count.

    Failures more than `forget` seconds after the last one count anew. A null ok is a failure; of events of one time and
    step failures come first. The state goes with the lock, or once the watermark is `forget` seconds past the last
    failure; a key whose last attempt succeeded has none.
    """
    on_rocksdb(events.sparkSession)
    good = F.coalesce(F.col(ok), F.lit(False)).alias("ok")
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_micros(F.col(at)).alias("t"), good)
    return rows.groupBy("key").transformWithStateInPandas(_Locks(failures, int(seconds * SECOND), int(forget * SECOND)), "key string, t long, locked boolean", "Append", "EventTime")


def job_stream(changes: DataFrame, keep: float = 3600.0, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """changes (job_id, status, ts) -> job_id, status, updated_at (microseconds): a row per job and step, its newest state.

    The first finished state stays, whatever comes after it, as in `job_states`; ties go to the status last in order
    while a job runs, and to the first when it is over. The state of a finished job goes `keep` seconds after its last
    change; of an open one it stays.
    """
    on_rocksdb(changes.sparkSession)
    rows = changes.withWatermark(at, late).select(F.col("job_id").cast("string").alias("job_id"), F.col(at), "status", F.unix_micros(F.col(at)).alias("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(int(keep * SECOND)), "job_id string, status string, updated_at long", "Update", "EventTime")


def ingest_stream(docs: DataFrame, home: str, stop: Callable[[], bool] = lambda: False, strategy: str = "recursive", size: int = 800, overlap: int = 150, progress: Callable[[dict[str, int]], None] | None = None) -> StreamingQuery:
    """Documents (doc_id, content, pages, filetype) into home/parents and home/chunks, a step at a time.

    A step screens its sections, leaves out those that look like instructions with their chunks, and writes parents
    before chunks: a chunk is never there without its section. Ids that are stored are not stored again, so a step
    that runs again adds nothing. stop is asked before every step; progress hears the rows of each.
    """
    def step(batch: DataFrame, number: int) -> None:
        if stop():
            raise InterruptedError(f"stopped before step {number}")
        rows = chunk_documents(batch, strategy, size, overlap)
        parents, chunks = rows.filter("kind = 'parent'"), rows.filter("kind = 'chunk'")
        chunks, parents = without_suspected(chunks, flagged(parents, pii=False))
        write_parents(parents, f"{home}/parents")
        write_chunks(chunks, f"{home}/chunks")
        if progress is not None:
            progress({"step": number, "documents": batch.count(), "chunks": batch.sparkSession.read.parquet(f"{home}/chunks").count() if exists(batch.sparkSession, f"{home}/chunks") else 0})

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
