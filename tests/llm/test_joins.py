"""Mixing, nearest neighbours, Jaccard components and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import ann, jaccard
from braidwork.llm.mixing import mix_sources, word_count
from tests.llm import brute


def family():
    random.seed(1)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(random.randint(0, 4)):
            words[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 300):
        words = [f"y{random.randrange(10**6)}" for _ in range(random.randint(20, 300))]
        j = random.randrange(len(words))
        rows.append((i, " ".join(words[:j] + passage + words[j:])))
    tail = [None, "", "a b", "A b", "a b c", "  \n", "a b c d", "a b c d", "a", "K b c d", "k b c d"]
    return rows + list(enumerate(tail, 300))


@pytest.mark.parametrize("percent, k", [(85, 4), (80, 5)])
def test_components(spark, monkeypatch, percent, k):
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 5)
    monkeypatch.setattr(jaccard, "CELL", 32)
    rows = family()
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, n int, node string").repartition(4)
    got = sorted(map(tuple, jaccard.jaccard_components(docs, percent, k).collect()))
    assert got == sorted(brute.components(rows, k, percent))


def test_components_of_documents_and_repeated_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = jaccard.jaccard_components(docs.union(docs.filter("doc_id < 20")))
    assert sorted(set(map(tuple, got.collect()))) == sorted(brute.components(rows, 4, 85))
    assert got.count() == len(rows) + sum(i < 20 for i, _ in rows)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rng.random(200) < rng.uniform(0.8, 1)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    column = jaccard._bitmaps(np.concatenate(sets), sizes)
    order = np.argsort(sizes, kind="stable")
    bits = jaccard.Bits(column.take(__import__("pyarrow").array(order)))
    n = sizes[order]
    x, y = jaccard.group_pairs(np.zeros(60, np.int64), n, np.arange(60), bits, 85)
    found = {tuple(sorted((int(a), int(b)))) for a, b in zip(x, y, strict=True)}
    for a in range(60):
        for b in range(a):
            s, t = sets[order[a]], sets[order[b]]
            both = len(np.intersect1d(s, t))
            if 100 * both >= 85 * (len(s) + len(t) - both):
                assert (b, a) in found


def test_mixing(spark):
    random.seed(2)
    rows = [(i, random.choice(["b", "b", "b", "a", None, "ä", "tiny"]), "w " * random.randint(0, 200)) for i in range(400)] + [(400, "empty", ""), (401, "empty", None), (402, "tiny", "x")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, size int").repartition(5)
    got = mix_sources(docs, word_count(F.col("text"))).collect()
    sizes, taken = {}, {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute.water_fill(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mix_sources(docs.repartition(2), word_count(F.col("text"))).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    assert mix_sources(docs.limit(0), word_count(F.col("text"))).count() == 0


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\t\nc\x0b\x0c\rd ", "\xa0 x", "a\x1cb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 4, 2, 1]


def neighbours(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest_recall(spark, small, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    truth = neighbours([(r.vec_id, r.embedding) for r in rows.collect()], 10)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(got[q]) & set(t)) / len(t) for q, t in truth.items()]) >= 0.9


def test_nearest_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300, None), (400, [0.0, 0.0]), (500, [float("nan"), 1.0]), (600, [1.0, None]), (700, [3.0, 4.0, 5.0]), (800, [5.0, 6.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: t for q, t in neighbours(rows, 10).items() if t}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from braidwork.llm.common import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "12 34", "en", "src1", 5)], docs.schema)
    docs = written(docs.unionByName(extra), "in")
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = written(stage(spark, docs, small), name)
        assert out.columns == p.COLUMNS
        before, rows = {r.doc_id: r for r in docs.collect()}, out.collect()
        now = {r.doc_id for r in rows}
        assert now <= kept
        if name == "language_id":
            assert kept - now == {900001, 900002}
        if name == "ngram_jaccard_join":
            assert now == {c for _, _, c in brute.components([(r.doc_id, r.text) for r in before.values()], 5, 80)}
            assert len(rows) == len(now)
        if name == "pii":
            assert now == kept and all(not brute.base_spans(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        kept, docs = now, out
    last = p.STAGES[-1][1](spark, docs, small)
    filled = last.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.filter("n > 2048 OR n <> end").isEmpty()


def test_entry_survives_without_the_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "braidwork", tmp_path / "braidwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
