import datetime as dt
import json
import random

from pyspark.sql import functions as F

from braidwork.sources import files
from braidwork.streaming import ingest as streams
from braidwork.streaming import jobs


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "sub" / "b.MD").write_text("# T")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "big.json").write_text("1" * 50)
    docs, refused = files.scan_files(spark, str(tmp_path), max_bytes=20)
    assert {r.filename: r.content for r in docs.collect()} == {"a.txt": "café �", "b.MD": "# T"}
    assert [(r.filename, r.reason) for r in refused.collect()] == [("big.json", "too large")]


def test_golden_ids_and_pages(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps({"question": "q?"}) + "\n\n" + json.dumps({"question": "r?", "id": "own"}) + "\n")
    assert sorted(len(r.id) for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()) == [3, 12]
    docs = spark.createDataFrame([("x", ["a", "", "b"], None), ("y", None, "t")], "id string, pages array<string>, content string")
    assert {r.id: r.content for r in files.paged(docs).collect()} == {"x": "a\n\n\n\nb", "y": "t"}


def test_html(spark):
    page = "<html><head><title>t</title></head><body><p>A &amp; B</p><script>x()</script><div>C</div></body></html>"
    assert spark.createDataFrame([(page,)], "h string").select(files.html_text(F.col("h")).alias("t")).first().t == "A & B\nC"


def test_index_stream_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(30)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    landing = streams.document_stream(spark, str(tmp_path / "in"), docs.schema, 1)
    streams.index_stream(landing, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    docs.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    streams.index_stream(landing, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    got = streams.read_index(spark, str(tmp_path / "ix"))
    assert got.lengths.count() == 30 and got.postings.count() == 60
    assert streams.compacted(spark, str(tmp_path / "ix"), str(tmp_path / "small"), 2).postings.count() == 60


def drained(stream, name, at, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.sql(f"select * from {name}").collect()


def landed(spark, rows, schema, path, steps=1):
    """rows as files of a landing folder, one for each step, in order."""
    size = -(-len(rows) // steps)
    for k in range(steps):
        made = spark.createDataFrame(rows[k * size : (k + 1) * size], schema).withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_lockouts(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:00:0{i}", False) for i in range(6)] + [("v", "2024-01-01 00:00:00", True)]
    got = drained(jobs.lockouts(landed(spark, rows, "user_id string, ts string, ok boolean", str(tmp_path / "ev"))), "locks", tmp_path)
    assert sum(r.locked for r in got if r.key == "u") == 1 and len(got) == 7


def plain_locks(rows, failures, seconds):
    state, out = {}, []
    for key, ts, ok in rows:
        count, until = state.get(key, (0, dt.datetime.min))
        locked = ts < until
        if not locked:
            count = 0 if ok else count + 1
            if count >= failures:
                count, until = 0, ts + dt.timedelta(seconds=seconds)
        state[key] = (count, until)
        out.append((key, locked))
    return out


def test_lockouts_over_steps_end_and_forget(spark, tmp_path):
    made = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(made.choice("abc"), start + dt.timedelta(seconds=40 * i), made.random() < 0.15) for i in range(120)]
    stream = jobs.lockouts(landed(spark, [(k, str(t), ok) for k, t, ok in rows], "user_id string, ts string, ok boolean", str(tmp_path / "ev"), 4), failures=3, seconds=300)
    got = [(r.key, r.locked) for r in sorted(drained(stream, "locks2", tmp_path), key=lambda r: r.t)]
    assert got == plain_locks(rows, 3, 300) and any(locked for _, locked in got)
    # failures that are further apart than the state is kept do not add up
    far = [("u", f"2024-01-{day:02d} 00:00:00", False) for day in (1, 2)] + [("w", "2024-01-20 00:00:00", True)] + [("u", "2024-01-21 00:00:00", False), ("u", "2024-01-21 00:00:01", False)]
    stream = jobs.lockouts(landed(spark, far, "user_id string, ts string, ok boolean", str(tmp_path / "far"), 5), failures=3, seconds=300, forget=86_400)
    assert not any(r.locked for r in drained(stream, "locks3", tmp_path))


def test_limits_have_no_cap_and_state_ends(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("k", start + dt.timedelta(milliseconds=20 * i)) for i in range(12_000)]
    stream = jobs.limited_stream(landed(spark, [(k, str(t)) for k, t in rows], "user_id string, ts string", str(tmp_path / "ev"), 2), most=20, seconds=300)
    got = sorted(drained(stream, "limits2", tmp_path), key=lambda r: r.t)
    assert [r.in_window for r in got] == list(range(1, 12_001))


def test_job_stream_equals_batch(spark, tmp_path):
    made = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(str(made.randrange(8)), made.choice(["pending", "running", "running", "completed", "failed"]), start + dt.timedelta(seconds=i)) for i in range(60)]
    stream = jobs.job_stream(landed(spark, [(j, s, str(t)) for j, s, t in rows], "job_id string, status string, ts string", str(tmp_path / "ch"), 3))
    last = {}
    for r in drained(stream, "jobs2", tmp_path, "update"):
        last[r.job_id] = (r.updated_at, r.status) if r.job_id not in last or last[r.job_id][0] <= r.updated_at else last[r.job_id]
    batch = spark.createDataFrame([(j, s, int(t.timestamp() * 1e6)) for j, s, t in rows], "job_id string, status string, at long")
    assert {j: s for j, (_, s) in last.items()} == {r.job_id: r.status for r in streams.job_states(batch).collect()}


def test_job_states(spark):
    rows = spark.createDataFrame([(1, "pending", 1), (1, "completed", 2), (1, "running", 3), (2, "running", 1)], "job_id int, status string, at int")
    assert {r.job_id: r.status for r in streams.job_states(rows).collect()} == {1: "completed", 2: "running"}
