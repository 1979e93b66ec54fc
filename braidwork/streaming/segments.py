"""A keyword index as a log of segments: steps append, deletes leave marks, merges fold segments together.

A segment is a folder of its own with documents, postings and marks of deleted ids; it counts once the manifest names
it. The manifest is a small file per version, put in place by one rename: a reader sees a step whole or not at all, and
what a torn step left is never read. A step looks up its ids in the parts of the segments that can hold them; it reads
no other lengths, and no postings.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.operators.index import Index, build
from braidwork.sources.sinks import exists

#: Parts that a segment's documents are dealt to by a hash of their id.
PARTS = 64
#: Segments of one size class that are merged into one of the next.
FAN = 4
#: Deleted ids that are broadcast at most.
SMALL = 200_000


class Changed(RuntimeError):
    """Another writer has put a manifest in place meanwhile; the change was not made, and may be tried again."""


@dataclass
class Manifest:
    version: int = 0
    #: seq, name, docs and marks of every segment, oldest first.
    segments: list[dict[str, Any]] = field(default_factory=list)
    #: The last step of each stream that is in.
    steps: dict[str, int] = field(default_factory=dict)


@dataclass
class SegmentStore:
    """The index under a folder of any file system that Spark writes to."""

    spark: SparkSession
    home: str

    def _fs(self, path: str) -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifest(self) -> Manifest:
        fs, where = self._fs(f"{self.home}/manifest")
        if not fs.exists(where):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        last = max((n for n in names if n.startswith("v") and n.endswith(".json")), default=None)
        return Manifest(**json.loads(self.spark.read.text(f"{self.home}/manifest/{last}", wholetext=True).first()[0])) if last else Manifest()

    def _switch(self, before: Manifest, segments: list[dict[str, Any]], steps: dict[str, int]) -> None:
        """Puts the next version in place, unless another writer has."""
        after = Manifest(before.version + 1, segments, steps)
        fs, draft = self._fs(f"{self.home}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(vars(after)).encode()))
        out.close()
        _, there = self._fs(f"{self.home}/manifest/v{after.version:012d}.json")
        if fs.exists(there) or not fs.rename(draft, there):
            fs.delete(draft, False)
            raise Changed(f"version {after.version} is there")

    # --- reading ---------------------------------------------------------------------------------------------------

    def _part(self, segments: list[dict[str, Any]], name: str, schema: str) -> DataFrame:
        paths = [f"{self.home}/segments/{s['name']}/{name}" for s in segments if s["marks" if name == "marks" else "docs"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(path) for path in paths])  # merges keep them few

    def _id(self, manifest: Manifest) -> str:
        return manifest.segments[0]["id"] if manifest.segments else "long"

    def _alive(self, rows: DataFrame, segments: list[dict[str, Any]], kind: str) -> DataFrame:
        """Rows (id, seq) that no later mark takes away."""
        if not any(s["marks"] for s in segments):
            return rows
        marks = self._part(segments, "marks", f"id {kind}, seq long").groupBy("id").agg(F.max("seq").alias("_gone"))
        side = F.broadcast(marks) if sum(s["marks"] for s in segments) <= SMALL else marks
        return rows.join(side, "id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("seq"))).drop("_gone")

    def lengths(self, parts: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """id, dl of the documents that are in; with parts, of those that stand in them."""
        now = manifest or self.manifest()
        kind = self._id(now)
        rows = self._part(now.segments, "docs", f"id {kind}, dl long, seq long, part int")
        rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
        return self._alive(rows.select("id", "dl", "seq"), now.segments, kind).select("id", "dl")

    def index(self) -> Index:
        """The index of all documents that are in: its statistics follow from the rows."""
        now = self.manifest()
        kind = self._id(now)
        postings = self._part(now.segments, "postings", f"term string, id {kind}, tf long, seq long")
        return Index(self._alive(postings, now.segments, kind).select("term", "id", "tf"), self.lengths(manifest=now))

    # --- writing ---------------------------------------------------------------------------------------------------

    def _segment(self, now: Manifest, docs: DataFrame | None, postings: DataFrame | None, marks: DataFrame | None, seq: int, kind: str) -> dict[str, Any]:
        name = uuid.uuid4().hex
        at = f"{self.home}/segments/{name}"
        held = gone = 0
        if docs is not None:
            docs.withColumn("seq", F.lit(seq).cast("long")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{at}/docs")
            written = self.spark.read.schema(f"id {kind}, dl long, seq long, part int").parquet(f"{at}/docs") if exists(self.spark, f"{at}/docs") else None
            held = written.count() if written is not None else 0
            if held:
                postings.join(written.select("id"), "id", "left_semi").select("term", "id", "tf").withColumn("seq", F.lit(seq).cast("long")).repartition("term").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        if marks is not None:
            marks.select("id").distinct().withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{at}/marks")
            gone = self.spark.read.parquet(f"{at}/marks").count()
        return {"seq": seq, "name": name, "docs": held, "marks": gone, "id": kind}

    def add(self, docs: DataFrame, stream: str = "", step: int | None = None, key: str = "doc_id", text: str = "text") -> bool:
        """Puts in the documents whose id is not in; of rows that share an id one. A step of a stream that is in already is left out, so a step that runs again changes nothing."""
        now = self.manifest()
        if step is not None and now.steps.get(stream, -1) >= step:
            return False
        rows = docs.filter(F.col(key).isNotNull()).dropDuplicates([key])
        kind = dict(rows.dtypes)[key].replace("bigint", "long")
        fresh = build(rows, key, text)
        parts = [r.part for r in rows.select(F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]
        lengths = fresh.lengths if not now.segments else fresh.lengths.join(self.lengths(parts, now).select("id"), "id", "left_anti")
        made = self._segment(now, lengths, fresh.postings, None, now.version + 1, kind)
        steps = now.steps | ({stream: step} if step is not None else {})
        if made["docs"] or steps != now.steps:
            self._switch(now, now.segments + ([made] if made["docs"] else []), steps)
        return bool(made["docs"])

    def delete(self, ids: DataFrame, key: str = "id") -> None:
        """Takes documents out by id; they may be put in again later. Nothing is rewritten."""
        now = self.manifest()
        made = self._segment(now, None, None, ids.select(F.col(key).alias("id")).filter("id IS NOT NULL"), now.version + 1, self._id(now))
        if made["marks"]:
            self._switch(now, [*now.segments, made], now.steps)

    @staticmethod
    def due(segments: list[dict[str, Any]], fan: int = FAN) -> tuple[int, int] | None:
        """The first run of at least `fan` neighbours of one size class or smaller ones, as a range, for the smallest class that has one: sizes of a class differ by less than `fan` times."""
        def size_class(s: dict[str, Any]) -> int:
            n, k = max(1, s["docs"] + s["marks"]), 0
            while n >= fan:
                n, k = n // fan, k + 1
            return k

        classes = [size_class(s) for s in segments]
        for top in sorted(set(classes)):
            start = 0
            for at in range(len(classes) + 1):
                if at == len(classes) or classes[at] > top:
                    if at - start >= fan:
                        return start, at
                    start = at + 1
        return None

    def merge(self, fan: int = FAN) -> bool:
        """Folds one run of like segments into one, if there is any: what is deleted goes, and marks stay while older segments may hold their ids."""
        now = self.manifest()
        run = self.due(now.segments, fan)
        if run is None:
            return False
        old, kind = now.segments[run[0] : run[1]], self._id(now)
        docs = self._alive(self._part(old, "docs", f"id {kind}, dl long, seq long, part int").select("id", "dl", "seq"), old, kind).select("id", "dl")
        postings = self._alive(self._part(old, "postings", f"term string, id {kind}, tf long, seq long"), old, kind)
        marks = self._part(old, "marks", f"id {kind}, seq long") if run[0] and any(s["marks"] for s in old) else None
        made = self._segment(now, docs, postings, marks, old[-1]["seq"], kind)
        kept = [made] if made["docs"] or made["marks"] else []
        self._switch(now, now.segments[: run[0]] + kept + now.segments[run[1] :], now.steps)
        return True

    def vacuum(self) -> int:
        """Removes the folders of segments that the newest manifest does not name; how many. Not while others read older versions or write."""
        named = {s["name"] for s in self.manifest().segments}
        fs, where = self._fs(f"{self.home}/segments")
        old = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in named] if fs.exists(where) else []
        for path in old:
            fs.delete(path, True)
        return len(old)


def segment_stream(docs: DataFrame, home: str, checkpoint: str, name: str = "documents", fan: int = FAN) -> StreamingQuery:
    """Documents (doc_id, text) into the index under home, a segment a step, with merges as they fall due."""
    def step(batch: DataFrame, number: int) -> None:
        store = SegmentStore(batch.sparkSession, home)
        store.add(batch, name, number)
        while store.merge(fan):
            pass

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
