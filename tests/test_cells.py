"""Near vectors and the cell index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.operators import cells, ingest, retrieval


def table(spark, x, labels=None, extra=()):
    rows = [(i, [float(a) for a in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), "id long, embedding array<double>, label int")


def clustered(n, dim, spread=0.05, seed=1):
    made = np.random.default_rng(seed)
    middle = made.normal(size=(n // 8, dim))
    x = middle[made.integers(0, len(middle), n)] + spread * made.normal(size=(n, dim))
    x[n // 2 : n // 2 + 40] = x[0]  # equal vectors
    return x, made.integers(0, 3, n)


def cosines(x):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return u @ u.T


ODD = [(9000, None, 0), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0, 2.0], 2), (9004, [], 0)]


@pytest.mark.parametrize("least", [0.985, 0.4])
def test_near_join_equals_brute_force(spark, monkeypatch, least):
    x, labels = clustered(600, 16)
    if least > 0.9:  # split cells on both sides
        monkeypatch.setattr(cells, "BLOCK_BYTES", 16 * 8 * 10)
    df = table(spark, x, labels, ODD)
    got = {r.qid: (r.id, round(r.score, 9)) for r in cells.near_join(df.select(F.col("id").alias("qid"), F.col("embedding").alias("v"), "label"), df.select("id", F.col("embedding").alias("v"), "label"), least, "label", others_only=True).collect()}
    score = np.round(cosines(x), 12)
    want = {}
    for i in range(len(x)):
        others = [(score[i, j], j) for j in range(len(x)) if j != i and labels[j] == labels[i] and score[i, j] >= least]
        if others:
            want[i] = (max(others)[1], round(float(max(others)[0]), 9))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_near_join_compares_few_pairs():
    """Of vectors in many groups a tight threshold meets a small share; a loose one gets no copies of queries."""
    made = np.random.default_rng(2)
    x = made.normal(size=(400, 64))[made.integers(0, 400, 6000)] + 0.1 * made.normal(size=(6000, 64)) @ np.diag(0.9 ** np.arange(64))
    x = x @ np.diag(0.9 ** np.arange(64))  # as in real tables, some directions vary more than others
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    radius = float(np.sqrt(2 - 2 * 0.985))
    planes = cells.Planes.fitted(x, 1_000_000, radius)
    own = np.bincount(planes.cells(x), minlength=1 << len(planes.cuts))
    _, met = planes.within(x, radius)
    assert own[met].sum() < 0.05 * len(x) ** 2
    assert len(cells.Planes.fitted(x, 6000, float(np.sqrt(2 - 2 * 0.4))).cuts) == 0


def test_planes_miss_nothing():
    made = np.random.default_rng(3)
    x = made.normal(size=(300, 8))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    for radius in (0.0, 0.2, 0.7, 2.0):
        planes = cells.Planes(np.linalg.qr(made.normal(size=(8, 8)))[0][:6], made.normal(size=6) * 0.1)
        who, cell = planes.within(x, radius)
        reach = set(zip(who.tolist(), cell.tolist(), strict=True))
        far = np.sqrt(np.maximum(0, 2 - 2 * cosines(x)))
        own = planes.cells(x)
        assert all((i, own[j]) in reach for i, j in zip(*np.nonzero(far <= radius), strict=True))


def test_index_is_exact_and_skips_cells(spark, tmp_path):
    x, labels = clustered(800, 16, spread=0.2)
    built = cells.VectorIndex.build(table(spark, x, labels, ODD))
    built.save(str(tmp_path / "ix"))
    index = cells.VectorIndex.load(spark, str(tmp_path / "ix"))
    ask = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(0, 800, 40)] + [(9001, [0.0] * 16), (9002, None), (9003, [1.0] * 5)], "qid long, query_vector array<double>")
    score = np.round(cosines(x), 9)

    def best(i, k, among):
        return [j for _, j in sorted((-score[i, j], j) for j in among)[:k]]

    hits, read = index.search(ask, 10)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert 9003 not in got and 9001 not in got
    assert got == {i: best(i, 10, range(800)) for i in range(0, 800, 40)}


def test_index_with_filter_and_probes(spark):
    x, labels = clustered(800, 16, spread=0.1)
    index = cells.VectorIndex.build(table(spark, x, labels))
    ask = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(0, 800, 40)], "qid long, query_vector array<double>")
    score = np.round(cosines(x), 9)
    hits, read = index.search(ask, 5, where=F.col("label") == 1)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {i: [j for _, j in sorted((-score[i, j], j) for j in range(800) if labels[j] == 1)[:5]] for i in range(0, 800, 40)}
    hits, read = index.search(ask, 10, probes=4)
    found = {(r.qid, r.id) for r in hits.collect()}
    right = sum(sum(1 for _, j in sorted((-score[i, j], j) for j in range(800))[:10] if (i, j) in found) for i in range(0, 800, 40))
    assert right >= 0.9 * 10 * 20
    assert all(r.cells <= 4 and r.n < r.all_rows for r in read.collect())
    exact = index.search(ask, 10)[1].agg(F.sum("n").alias("n"), F.sum("all_rows").alias("of")).first()
    assert exact.n < 0.6 * exact.of


def test_many_queries_are_dealt_to_blocks(spark, monkeypatch):
    x, labels = clustered(300, 16)
    df = table(spark, x, labels, ODD)
    ask = df.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    plain = retrieval.vector_top(ask, df, 4).orderBy("qid", "rank").select("qid", "id", "rank").collect()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1000)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 16 * 8 * 50)
    assert retrieval.vector_top(ask, df, 4).orderBy("qid", "rank").select("qid", "id", "rank").collect() == plain


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>, owner string, document_key string")
    some = spark.createDataFrame([(1, [1.0, 0.0], "o", "d")], none.schema)
    assert ingest.near_duplicates(none, some).collect() == [] and ingest.near_duplicates(some, none).collect() == []
    assert cells.VectorIndex.build(none.drop("owner")).search(some.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector")), 3)[0].collect() == []


def even(n, dim=64, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def test_near_join_copies_a_query_a_bounded_number_of_times(spark, monkeypatch):
    """Vectors that point evenly in all directions, and a table of any size: what is sent stays in proportion, and a stored query is one row."""
    x = even(2000)
    for rows in (1e3, 1e6, 1e9):
        planes = cells.Planes.fitted(x, rows, float(np.sqrt(2 - 2 * 0.985)))
        assert len(planes.within(x, float(np.sqrt(2 - 2 * 0.985)))[0]) <= 1.2 * cells.COPIES * len(x)
    monkeypatch.setattr(cells, "COPY", 1)
    stored = {}
    monkeypatch.setattr(cells, "written", lambda df, name, write=cells.written: stored.setdefault(name, write(df, name)))
    x[1000:] = x[:1000]
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id int, v array<double>, label int")
    got = {r.qid: r.id for r in cells.near_join(df.withColumnRenamed("id", "qid"), df, 0.985, "label", others_only=True).collect()}
    assert got == {i: (i + 1000) % 2000 for i in range(2000)} and stored["near-queries"].count() == 2000


def peak(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def listed(x):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def test_a_task_of_dealt_vectors_holds_few_scores(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    caught = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, work, schema: caught.append(work))
    rows = spark.createDataFrame([(0, [1.0] * 64, 0)], "id int, v array<double>, cell int")
    cells.dealt(rows.withColumnRenamed("id", "qid"), rows, ["cell"], 64, 1, 0.4, others_only=True, digits=12, larger=True)
    x = even(8000)
    left, right = (pa.table({c: pa.array(np.arange(len(x))), "v": listed(x)}) for c in ("qid", "id"))
    out = []
    assert peak(lambda: out.append(caught[0](left, right))) < 40
    score = x @ x.T
    np.fill_diagonal(score, -1)
    want = {(i, int(j)) for i, j in enumerate(score.argmax(axis=1)) if score[i, j] >= 0.4}
    assert want and set(zip(out[0]["qid"].to_pylist(), out[0]["id"].to_pylist(), strict=True)) == want


def test_a_task_of_searched_vectors_holds_few_scores():
    from braidwork.operators import retrieval

    x, q = even(8000), even(4000, seed=6)
    run = retrieval._searcher(pa.table({"qid": pa.array(np.arange(len(q))), "v": listed(q)}), 64, 5, None, None, False)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), listed(x)], names=["id", "v"])]
    out = []
    assert peak(lambda: out.extend(run(iter(batches)))) < 45
    got = pa.Table.from_batches(out)
    want = {(i, int(j)) for i, s in enumerate(q @ x.T) for j in np.argpartition(s, -5)[-5:]}
    assert set(zip(got["qid"].to_pylist(), got["id"].to_pylist(), strict=True)) == want
