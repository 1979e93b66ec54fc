"""Prefix scans, exact ranks, pruned keyword search, folder tables, language profiles and case folding against plain versions."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import blockmax, evaluation, filters, index, languages, monitoring, retrieval, scans


def skewed(spark, n=900):
    """One key holds nine tenths of the rows, with ties; some keys and values are null."""
    chance = random.Random(1)
    rows = [("hot" if chance.random() < 0.9 else chance.choice(["a", "b", None]), chance.randrange(300), chance.randrange(5)) for _ in range(n)]
    return spark.createDataFrame(rows, "k string, t long, v long").repartition(3)


# --- scans ---------------------------------------------------------------------------------------------------------


def test_running_totals_equal_a_window(spark):
    rows = skewed(spark).withColumn("t", F.col("t") * 1000 + F.monotonically_increasing_id() % 1000)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("s", F.sum("v").over(w)).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("a"))
    ordered = scans.Ordered.of(rows, ["k"], ["t"], parts=7)
    assert ordered.rows.filter("k = 'hot'").select("_part").distinct().count() > 3
    got = ordered.total(F.col("v"), "s").result().groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("a"))
    key = lambda r: str(r.k)
    # rows that tie in t may come in either order: totals at the last of them agree
    last = lambda rows: {r.k: {x.t: x.s for x in r.a} for r in sorted(rows, key=key)}
    assert last(got.collect()) == last(want.collect())


def test_running_totals_without_a_key_and_before(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.id: (r.upto, r.before, r.last) for r in scans.Ordered.of(rows, [], ["id"], parts=6).total(F.col("v"), "upto").total(F.col("v"), "before", before=True).previous("id", "last").result().collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got[i] == (total, total - i % 7, i - 1 if i else None)


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "k string, t long, v long")
    assert scans.Ordered.of(none, ["k"], ["t"]).total(F.col("v"), "s").previous("t", "p").result().collect() == []
    assert scans.exact_ranks(none, "v", {"p": F.lit(0)}, ("k",)).collect() == []


def test_error_spans_with_and_without_a_key(spark):
    rows = skewed(spark).select("k", F.timestamp_micros(F.col("t") * 1_000_000).alias("ts"))
    for by in ("k", None):
        got = sorted((str(r.k) if by else "", r.started, r.ended, r.failures) for r in monitoring.error_windows(rows, F.lit(True), 2.0, by).collect())
        groups = {}
        for r in rows.collect():
            groups.setdefault(str(r.k) if by else "", []).append(r.ts)
        want = []
        for k, times in groups.items():
            times.sort()
            start = 0
            for i in range(1, len(times) + 1):
                if i == len(times) or (times[i] - times[i - 1]).total_seconds() > 2:
                    want.append((k, times[start], times[i - 1], i - start))
                    start = i
        assert got == sorted(want)


def test_limiter_equals_one_window_a_key(spark):
    rows = skewed(spark).select("k", "v", F.timestamp_micros(F.col("t") * 1_000_000).alias("ts"))
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-20_000_000 + 1, 0)
    want = rows.withColumn("in_window", F.count("*").over(w)).select("k", "ts", "in_window")
    got = monitoring.limited(rows, 5, 20.0, key="k").select("k", "ts", "in_window")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_budgets_equal_short_ones(spark):
    rows = spark.createDataFrame([(q, i, "x" * (i % 50)) for q in range(3) for i in range(200)], "qid int, rank int, document string")
    for budget in (0, 500, 4000):
        assert sorted(retrieval.within_long_budget(rows, budget).collect()) == sorted(retrieval.within_budget(rows, budget).collect())


# --- ranks ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [10, 65_536])
def test_ranks_equal_sorting(spark, few):
    chance = random.Random(3)
    rows = [("tail", 10.0 ** chance.uniform(-200, 200)) for _ in range(1500)] + [("two", float(chance.random() < 0.3)) for _ in range(800)] + [("one", 5.0)] + [(None, float(i)) for i in range(50)] + [("none", None)]
    rows += [("same", 1.0)] * 700 + [("neg", -float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: r for r in scans.exact_ranks(df, "v", {f"p{i}": F.greatest(F.ceil(F.col("n") * s) - 1, F.lit(0)) for i, s in enumerate(shares)}, ("k",), few=few).collect()}
    want = {r.k: r for r in df.filter("v IS NOT NULL").groupBy("k").agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY v)").alias(f"p{i}") for i, s in enumerate(shares)]).collect()}
    assert got == want and len(got) == 6


def test_ranks_without_a_group(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert tuple(monitoring.percentiles(df, "v").first()) == (499, 949, 989)
    assert tuple(monitoring.floor_percentiles(df, "v").first()) == (500, 950)
    assert tuple(scans.exact_ranks(df, "v", {"m": F.lit(123)}, few=5).first()) == (123,)


# --- pruned search -------------------------------------------------------------------------------------------------


def corpus(spark, n=1200):
    chance = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(chance.choices(words, weights, k=chance.choice([3, 10, 40, 200])))) for i in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pruned_search_equals_a_full_scan(spark, tmp_path):
    docs = corpus(spark)
    blockmax.BlockIndex.build(docs, size=16).save(str(tmp_path / "ix"))
    ix = blockmax.BlockIndex.load(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame([(0, "w5 w40 w200"), (1, "w0 w1 w2"), (2, "w299 w299 nothing"), (3, "nothing"), (4, "w7")], "qid int, query string")
    rank = lambda hits: {(r.qid, r.rank): (r.id, round(r.score, 6)) for r in hits.collect()}
    whole = index.top(index.scores(index.build(docs), asked).filter("score > 0").withColumn("_r", F.round("score", 9)), 10, score="_r")
    hits, read = ix.search(asked, 10)
    assert rank(hits) == rank(whole)
    of = {r.qid: r for r in read.collect()}
    assert of[4].blocks < 0.5 * of[4].all_blocks and all(r.blocks <= r.all_blocks for r in of.values())
    allowed = docs.filter("doc_id % 7 = 3").select(F.col("doc_id").alias("id"))
    kept = index.top(index.scores(index.build(docs), asked).filter("score > 0").join(allowed, "id").withColumn("_r", F.round("score", 9)), 10, score="_r")
    assert rank(ix.search(asked, 10, allowed)[0]) == rank(kept)


def test_pruned_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert blockmax.BlockIndex.build(none).search(spark.createDataFrame([(0, "a")], "qid int, query string"), 3)[0].collect() == []


def test_term_counts_of_long_texts(spark):
    """A text of many different words is counted in one pass, and as often as it says them."""
    docs = spark.createDataFrame([(1, " ".join(f"t{i} t{i}" for i in range(4000))), (2, "t1 other"), (3, "t5"), (4, "x y")], "doc_id long, text string")
    asked = docs.filter("doc_id < 3").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    got = {(r.qid, r.id): round(r.score, 9) for r in index.bm25_scores(docs, asked).collect()}
    want = {(r.qid, r.id): round(r.score, 9) for r in index.scores(index.build(docs), asked).collect()}
    assert got == want


# --- the rest ------------------------------------------------------------------------------------------------------


def test_calibration_equals_the_fused_rankings(spark):
    chance = random.Random(8)
    ranking = lambda: spark.createDataFrame([(q, i, r) for q in range(9) for r, i in enumerate(chance.sample(range(30), 8))], "qid int, id int, rank int")
    dense, sparse = ranking(), ranking()
    sources = spark.createDataFrame([(i, f"s{i % 6}") for i in range(28)], "id int, source string")
    asked = spark.createDataFrame([(q, [f"s{q % 6}", f"s{(q + 1) % 6}", "zz"], q % 4) for q in range(9)], "qid int, expected array<string>, relevant_in_corpus int")
    got = {(r.alpha, r.rrf_k): tuple(r[m] for m in evaluation.METRICS) for r in evaluation.calibration(dense, sparse, asked, sources, 5).collect()}
    assert len(got) == 44
    for alpha, rrf in ((0.0, 10), (0.3, 60), (0.6, 60), (1.0, 100)):
        hits = retrieval.weighted_rrf(dense, sparse, 5, alpha, rrf).join(sources, "id")
        one = evaluation.mean_scores(evaluation.query_scores(hits, asked, 5)).first()
        assert got[alpha, rrf] == pytest.approx(tuple(one[m] for m in evaluation.METRICS), abs=1e-4)


def test_folder_tables(spark):
    rules = spark.createDataFrame([("a", 1), ("a//b/", 2), ("./a/b/c", 3), ("zz", 9)], "folder string, value int")
    rows = spark.createDataFrame([(p,) for p in ("a/b/x", "a/b/c/d/e", "ab/c", "/a/./b", "q", None, "", "a/b/c")], "path string")
    assert {r.path: r.value for r in filters.folder_values(rows, rules, 0).collect()} == {"a/b/x": 2, "a/b/c/d/e": 3, "ab/c": 0, "/a/./b": 2, "q": 0, None: 0, "": 0, "a/b/c": 3}
    root = filters.folder_values(rows, rules.union(spark.createDataFrame([("", 7)], rules.schema)), 0)
    assert {r.path: r.value for r in root.collect() if r.path in ("q", "ab/c", None)} == {"q": 7, "ab/c": 7, None: 0}
    many = spark.range(100_000).select(F.concat(F.lit("d"), "id").alias("folder"), F.col("id").alias("value"))
    found = filters.folder_values(spark.createDataFrame([("d77777/x",)], "path string"), many, -1)
    assert found.first().value == 77777 and "d77777" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_language_profiles(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    told = languages.by_profile(docs.filter("doc_id % 2 = 1"), languages.profiles(docs.filter("doc_id % 2 = 0")))
    right = told.join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "ɸɸɸ")], "doc_id long, text string")
    assert {r.lang for r in languages.by_profile(odd, languages.profiles(docs)).collect()} == {"en"}


def test_case_folding_of_every_character(spark):
    """Every character that this Python knows (Java may know more), 64 of them to a text."""
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(f"{chr(c)}B" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.casefolded(F.col("t")).alias("f"))
    wrong = [r.i for r in rows.collect() if r.f != texts[r.i].casefold()]
    assert wrong == []


# --- the best hits of a task ---------------------------------------------------------------------------------------


def test_questions_that_say_how_many_hits_they_want_get_the_best_of_all(spark, monkeypatch):
    from braidwork.operators import scoring

    docs = corpus(spark).unionByName(spark.range(5000, 5400).select(F.col("id").alias("doc_id"), F.lit("w3 copy of w9").alias("text"))).repartition(5)
    asked = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 300}" for j in range(1, 2 + i % 40))) for i in range(60)] + [(98, "nothing"), (99, None)], "qid long, query string")
    monkeypatch.setattr(scoring, "STEP", 50)
    monkeypatch.setattr(scoring, "ENTRIES", 300)  # several blocks of questions
    monkeypatch.setattr(scoring, "WIDE", 4000)
    best = lambda hits: {(r.qid, r.rank): (r.id, round(r.score, 7)) for r in index.top(hits.filter("score > 0").withColumn("_r", F.round("score", 9)), 7, score="_r").collect()}
    few = index.bm25_scores(docs, asked.withColumn("k", F.lit(7)))
    assert best(few) == best(index.scores(index.build(docs), asked))
    # what leaves a task is bounded by the questions, not by the documents that share a word with them
    assert few.count() <= few.rdd.getNumPartitions() * 7 * 62
    assert "HashAggregate" not in few._jdf.queryExecution().executedPlan().toString()


def test_statistics_count_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " ., "), (5, "B Übel ÀÉ_x")], "doc_id long, text string")
    terms, totals = index.statistics(docs, lambda df, name: df)
    assert {r.term: r.df for r in terms.collect()} == {"a": 1, "b": 2, "übel": 1, "àé": 1, "x": 1}
    assert tuple(totals.first()) == (5, 7)


def test_postings_are_made_where_a_text_is_read(spark):
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else f"a{i % 9} b a{i % 9} É{i}, x_y") for i in range(600)], "doc_id long, text string").repartition(2)
    made = index.build(docs).postings
    got = {(r.term, r.id): r.tf for r in made.collect()}
    want = {(r.term, r.id): r.tf for r in docs.select(F.col("doc_id").alias("id"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")).collect()}
    assert got == want
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_pruned_search_shuffles_blocks_once_and_no_row_per_question_and_window(spark):
    docs = corpus(spark, 600)
    ix = blockmax.BlockIndex.build(docs, size=8)
    asked = spark.createDataFrame([(i, "w0 w1 w2 w3 " + f"w{i}") for i in range(40)], "qid int, query string")
    written = []
    hits, read = ix.search(asked, 5, write=lambda df, name: written.append(df.localCheckpoint()) or written[-1])
    whole = index.top(index.scores(index.build(docs), asked).filter("score > 0").withColumn("_r", F.round("score", 9)), 5, score="_r")
    rank = lambda hits: {(r.qid, r.rank): (r.id, round(r.score, 6)) for r in hits.collect()}
    assert rank(hits) == rank(whole)
    found = written[-1]
    assert found.count() <= found.rdd.getNumPartitions() * 40 * 6
    of = {r.qid: r for r in read.collect()}
    assert len(of) == 40 and all(0 < r.blocks <= r.all_blocks and r.n <= r.all_n for r in of.values())


def test_language_profiles_beside_the_texts_tell_what_joined_ones_do(spark, monkeypatch):
    """Odd texts, keys that repeat or are null, letters beyond the first plane; and no row per text and word is stored."""
    said = [
        (1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, "la maison et le jardin", "fr"), (4, "Ωμέγα дом \U00010400\U00010428x", "xx"), (5, None, "en"), (6, "the das", None), (7, "12 34 -", "de"),
        (8, "the", None), (8, "garten garten", None), (None, "das Haus", None), (9, "", "fr"), (10, "zq́a İstanbul K", "en"), (11, "\U00010428X дом", None),
    ]
    rows = spark.createDataFrame(said, "doc_id int, text string, lang string").repartition(3)
    stored = []
    monkeypatch.setattr(languages, "written", lambda df, name, write=languages.written: stored.append(name) or write(df, name))
    profile = languages.profiles(rows)
    plain = {}
    for _, text, lang in said:
        for word in spark.createDataFrame([(text,)], "t string").select(F.explode(languages.words(F.col("t"))).alias("w")).collect() if lang else ():
            marked = f"_{word.w}_"
            for i in range(len(word.w)):
                plain[lang, marked[i : i + 3]] = plain.get((lang, marked[i : i + 3]), 0) + 1
    every = {g for _, g in plain}
    total = {x: sum(n for (y, _), n in plain.items() if y == x) for x in {x for x, _ in plain}}
    assert {(r.gram, r.lang): round(r.logp, 9) for r in profile.collect()} == {(g, x): round(math.log((plain.get((x, g), 0) + 1) / (total[x] + len(every))), 9) for g in every for x in total}
    some = profile.filter("lang <> 'fr' OR gram <> '_ma'")  # a profile need not hold every trigram
    for given in (profile, some, profile.filter("false")):
        stored.clear()
        told = sorted(map(str, languages.by_profile(rows.select("doc_id", "text"), given).collect()))
        assert "said" not in stored and len(told) == 12
        monkeypatch.setattr(languages, "HELD", -1)
        assert told == sorted(map(str, languages.by_profile(rows.select("doc_id", "text"), given).collect()))
        monkeypatch.setattr(languages, "HELD", 1 << 20)
