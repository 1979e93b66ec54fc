from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import retrieval, state
from braidwork.plans.search import Library, answer, search


def library(spark):
    rows = [
        ("a1", "Keyword search ranks documents with BM25.", "a.pdf", 1, False, 0, "shared", False),
        ("a2", "Vectors are compared by cosine similarity.", "a.pdf", 2, True, 1, "shared", False),
        ("b1", "Keyword search of a private note.", "b.txt", None, False, 0, "u1", False),
        ("c1", "Restricted keyword search.", "c.txt", None, False, 0, "shared", True),
    ]
    df = spark.createDataFrame(rows, "id string, document string, source string, page int, is_last_page boolean, chunk_index int, owner string, restricted boolean")
    return Library.of(df.withColumn("filename", F.col("source")).withColumn("embedding", retrieval.hashed_embedding(F.col("document"))))


def ids(hits, qid):
    return [r.id for r in hits.filter(F.col("qid") == qid).orderBy("rank").collect()]


def test_search_scope_pages_and_answers(spark):
    books = library(spark)
    asked = spark.createDataFrame([(0, "keyword search"), (1, "What is on page 2?"), (2, "the last page"), (3, "page 9")], "qid int, question string")
    everyone = search(books, asked, 3, ["shared"])
    assert ids(everyone, 0)[0] in {"a1", "c1"} and "b1" not in ids(everyone, 0)
    assert ids(everyone, 1) == ["a2"] and ids(everyone, 2) == ["a2"] and ids(everyone, 3) == []
    assert "b1" in ids(search(books, asked, 3, ["shared", "u1"]), 0)
    assert ids(search(books, asked, 3, ["shared"], {"source": "c.txt"}), 0) == ["c1"]
    best = search(books, asked, 2, ["shared"], rerank=True)
    assert best.filter("qid = 0").count() == 2
    said = {r.qid: r.answer for r in answer(books, asked, 2, owners=["shared"]).collect()}
    assert said[1].startswith("Vectors are compared") and said[1].endswith("Sources:\n[1] a.pdf, p. 2")
    assert said[3] == "I cannot find sufficient information."


def test_a_large_library_answers_alike(spark):
    books = library(spark)
    large = Library.large(books.chunks)
    asked = spark.createDataFrame([(0, "keyword search"), (1, "cosine vectors"), (4, "unheard")], "qid int, question string")
    rows = lambda hits: sorted((r.qid, r.rank, r.id, r.score) for r in hits.select("qid", "rank", "id", "score").collect())
    assert rows(search(large, asked, 3, ["shared"])) == rows(search(books, asked, 3, ["shared"]))


def test_judge_replies(spark):
    replies = ['so {"x": {bad} then {"score": 0.5, "verdict": true} end', "clearly true", "false", None]
    got = [tuple(r.j) for r in spark.createDataFrame([(r,) for r in replies], "r string").select(T.judged(F.col("r")).alias("j")).collect()]
    assert got == [(0.5, True), (None, True), (None, False), (None, False)]


def test_activation(spark):
    active = spark.createDataFrame([("p", "h1"), ("q", "h2")], "name string, hash string")
    log = spark.createDataFrame([], "name string, from_hash string, to_hash string, at int, actor string")
    changes = spark.createDataFrame([("p", "h9"), ("q", "h2"), ("r", "h3")], "name string, hash string")
    now, events = state.activated(active, changes, log, F.lit(1), "me")
    assert sorted(map(tuple, now.collect())) == [("p", "h9"), ("q", "h2"), ("r", "h3")]
    assert sorted((e.name, e.from_hash or "") for e in events.collect()) == [("p", "h1"), ("r", "")]


def test_password_change_ends_sessions(spark):
    users = spark.createDataFrame([(1, "a", 5, 9.0), (2, "b", 1, None)], "id int, password_hash string, failed_logins int, locked_until double")
    sessions = spark.createDataFrame([("t1", 1), ("t2", 2)], "token_hash string, user_id int")
    out, left = state.password_changed(users, sessions, spark.createDataFrame([(1, "new")], "id int, password_hash string"))
    assert sorted(map(tuple, out.collect())) == [(1, "new", 0, None), (2, "b", 1, None)]
    assert [r.token_hash for r in left.collect()] == ["t2"]


def test_a_library_shuffles_no_postings_and_scores_alike(spark, monkeypatch):
    from braidwork.operators import index

    rows = [(i, " ".join(f"w{(i * j * j) % 371}" for j in range(1, 12)) + (" É ÀB" if i % 3 else "")) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "id int, document string").withColumn("owner", F.lit("shared"))
    asked = spark.createDataFrame([(0, "w12 w45 w36 w99 àb"), (1, "w16 w16 w4 é"), (2, "unheard")], "qid int, query string")
    whole = index.top(index.scores(index.build(df, "id", "document"), asked).filter("score > 0").withColumn("_r", F.round("score", 9)), 5, score="_r")
    want = sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in whole.collect())
    monkeypatch.setattr(index.scoring, "postings", None)  # no posting is made
    got = Library.of(df).keyword_top(asked, 5, df.select("id", "document"))
    assert sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in got.collect()) == want and want
    some = Library.of(df).keyword_top(asked, 5, df.filter("id % 2 = 0").select("id", "document")).collect()
    assert {r.id % 2 for r in some} == {0} and all(any(abs(r.score - s) < 1e-9 for *_, s in want) for r in some if (r.qid, r.id) in {(q, i) for q, _, i, _ in want})


def test_embeddings_of_a_table_are_those_of_the_column(spark):
    texts = [None, "", "one One ONE two", "ÀÉ ɏ x1 İstanbul ǅ K" + chr(0x212A), "# - .", "long " * 5000, "a\nb\tc\x0bd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, document string").repartition(2)
    got = {r.id: r.embedding for r in retrieval.embedded(rows, "document").collect()}
    assert got == {r.id: r.e for r in rows.select("id", retrieval.hashed_embedding(F.col("document")).alias("e")).collect()}


def test_a_large_library_answers_plans(spark):
    from braidwork.plans.search import planned

    books = Library.large(library(spark).chunks)
    plan = [(0, "keyword search", ["keyword search", "cosine"], 3, 2, True, False, 0.3)]
    asked = spark.createDataFrame(plan, "qid int, question string, queries array<string>, fetch_k int, final_k int, use_hybrid boolean, use_reranker boolean, alpha double")
    assert len(planned(books, asked).first().documents) == 2
