"""The segmented index against a batch build."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators.index import bm25_top, build
from braidwork.streaming import ingest as streams
from braidwork.streaming.segments import Changed, SegmentStore, segment_stream


def made(spark, ids, extra=""):
    return spark.createDataFrame([(i, f"word{i % 3} common {extra}" + "x " * (i % 5)) for i in ids], "doc_id long, text string")


def same(store, docs):
    got, want = store.index(), build(docs)
    assert sorted(map(tuple, got.lengths.collect())) == sorted(map(tuple, want.lengths.collect()))
    assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, want.postings.collect()))


def test_adds_deletes_and_adds_again(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "ix"))
    assert store.index().lengths.collect() == []
    store.add(made(spark, range(20)))
    assert not store.add(made(spark, range(10), "other"))  # ids that are in stay as they are
    store.delete(spark.createDataFrame([(3,), (4,), (99,)], "id long"))
    same(store, made(spark, [i for i in range(20) if i not in (3, 4)]))
    store.add(made(spark, [3, 30], "again "))
    same(store, made(spark, [i for i in range(20) if i not in (3, 4)]).union(made(spark, [3, 30], "again ")))
    asked = spark.createDataFrame([(0, "again")], "qid int, query string")
    assert {r.id for r in bm25_top(store.index(), asked, 5).collect()} == {3, 30}


def test_merges_keep_what_is_alive(spark, tmp_path):
    """Random adds and deletes with a merge after each, against a plain set."""
    chance = random.Random(2)
    store, alive = SegmentStore(spark, str(tmp_path / "ix")), {}
    for step in range(7):
        ids = chance.sample(range(25), 6)
        if step % 3 == 2:
            store.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
            alive = {i: e for i, e in alive.items() if i not in ids}
        else:
            store.add(made(spark, ids, f"s{step} "))
            alive |= {i: f"s{step} " for i in ids if i not in alive}
        while store.merge(2):
            pass
    docs = spark.createDataFrame([(i, f"word{i % 3} common {e}" + "x " * (i % 5)) for i, e in alive.items()], "doc_id long, text string")
    same(store, docs)
    assert len(store.manifest().segments) <= 3 and store.vacuum() > 0
    same(store, docs)


def test_torn_steps_and_other_writers(spark, tmp_path):
    home = str(tmp_path / "ix")
    store = SegmentStore(spark, home)
    store.add(made(spark, range(5)), "s", 0)
    before = store.manifest()
    store._segment(before, build(made(spark, range(5, 9))).lengths, build(made(spark, range(5, 9))).postings, None, 9, "long")  # written, never named
    same(store, made(spark, range(5)))
    assert not store.add(made(spark, range(5, 9)), "s", 0)  # that step is in
    store.add(made(spark, range(5, 9)), "s", 1)
    same(store, made(spark, range(9)))
    with pytest.raises(Changed):
        store._switch(before, [], {})
    assert store.vacuum() == 1
    same(store, made(spark, range(9)))


def test_a_step_reads_only_its_parts(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "ix"))
    store.add(made(spark, range(200)))
    plan = store.lengths([5, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:80]
    assert 0 < store.lengths([5, 7]).count() < 30


def test_stream_equals_batch(spark, tmp_path):
    docs = made(spark, range(30))
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    landing = streams.document_stream(spark, str(tmp_path / "in"), docs.schema, 1)
    segment_stream(landing, str(tmp_path / "ix"), str(tmp_path / "cp"), fan=2).awaitTermination()
    docs.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    segment_stream(landing, str(tmp_path / "ix"), str(tmp_path / "cp"), fan=2).awaitTermination()
    store = SegmentStore(spark, str(tmp_path / "ix"))
    same(store, docs)
    assert len(store.manifest().segments) < 5 and store.lengths().agg(F.countDistinct("id")).first()[0] == 30
