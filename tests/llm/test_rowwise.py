"""Operators that treat every row by itself: counts, spans, scores, languages, licences."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.llm import language, licenses, pii, quality
from braidwork.llm.repetition import repetition
from tests.llm import brute

ODD = [
    None, "", " ", "\n\n", "one", "a b c", "a b c a b c", "x\nx\nx y\n", "é ñ #*$ |<>&%", "w " * 400, "\x1c \xa0 b\x0bc", "line one here\n" * 60,
    "a@b.c.d@e.f", "a@b.c_d@e.f x", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "001.002.003.0000255", "4041894974608795", "4041 8949-7460 8795", "1 4041894974608795",
    "+1 (348) 555-3032", "+1+1 23456789", "é😀+49 30 1234567 x@y.zz", "+12", "call (348) 555-3032 now", "on 2024-05-12 and", "9" * 3000, "a" * 20000 + "@b.co", "1." * 3000, "+1" * 500 + "234567", "a.b@c.d," * 50,
    "4041894974608795 4041894974608795", "\n+1 234 567 890\n", "-".join("12345" * 40), "tail 1.1.1.1",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(0, None, "clash", 1)], "doc_id long, text string, kept string, n_words int")


def test_repetition_counts(odd):
    rows = repetition(odd).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute.repetition(ODD[r.doc_id]), ODD[r.doc_id]
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.base_failed and r.kept)


def test_repetition_verdict(spark):
    random.seed(3)
    fresh = " ".join(f"w{random.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(0, fresh), (1, (fresh + " ") + (passage + " ") * 40), (2, fresh.replace(" ", "\n") + "\n" + "the same line again\n" * 80)], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in repetition(docs).collect()} == {0: True, 1: False, 2: False}
    twice = spark.createDataFrame([(0, fresh + "\n" + fresh[:200] + "\n" + fresh[:200])], "doc_id int, text string")
    assert repetition(twice).first().kept


def test_repetition_verdict_beside_the_base(spark):
    fresh, passage = [f"w{i:04}" for i in range(300)], " ".join(f"p{i:04}" for i in range(30))
    thrice = " ".join([*fresh[:100], passage, *fresh[100:200], passage, *fresh[200:], passage])
    sentence = " ".join(f"s{i:04}" for i in range(12))
    twice = " ".join([sentence, *fresh[:60], sentence])
    rows = repetition(spark.createDataFrame([(0, thrice), (1, twice)], "doc_id int, text string")).collect()
    assert not any(r.base_failed for r in rows)
    assert {r.doc_id: r.kept for r in rows} == {0: False, 1: True}


def test_repetition_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in repetition(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.repetition(texts[r.doc_id])


def test_base_spans(odd):
    for r in pii.find_spans(odd).select("doc_id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s")).collect():
        assert r.b == brute.base_spans(ODD[r.doc_id]), ODD[r.doc_id][:60]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_added_spans_and_redaction(spark):
    texts = ["call (348) 555-3032 now", "mail anna.k [at] mail [dot] com", "on 2024-05-12 and", "x +1 (348) 555-3032 a@b.co", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.t for r in pii.find_spans(df).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: "call [PHONE] now", 1: "mail [EMAIL]", 2: "on 2024-05-12 and", 3: "x [PHONE] [EMAIL]", 4: "plain", 5: None}


def test_bracketed_at_before_a_plain_dot(spark):
    texts = ["contact: maria42[at]example.com", "anna.k [at] mail.com", "write to b_lee(at)post9.org now", "he was at home.The next"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.t for r in pii.find_spans(df).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: "contact: [EMAIL]", 1: "[EMAIL]", 2: "write to [EMAIL] now", 3: texts[3]}


def test_pii_runs_no_python(odd):
    plan = pii.find_spans(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_quality_held_out(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from braidwork.llm.common import crc_bucket

    sample = quality.labelled_sample(docs, labels.filter(crc_bucket(F.col("doc_id"), 5) != 0), "quality", 3000)
    model = quality.train(sample.column(0).to_pylist(), sample.column(1).to_pylist())
    held = quality.score(docs.select("doc_id", "text"), model, 1).join(labels, "doc_id").filter(crc_bucket(F.col("doc_id"), 5) == 0)
    right = held.select(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_quality_odd_rows(odd, spark):
    model = quality.train(["good words here and there", "spam spam spam spam"] * 5, [1, 0] * 5)
    rows = quality.score(odd, model, 1).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in quality.score(odd, model, 7).collect())
    assert quality.score(spark.createDataFrame([], odd.schema), model, 1).count() == 0


def test_language_held_out(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    from braidwork.llm.common import crc_bucket

    tagger = language.train(*language.language_sample(docs.filter(crc_bucket(F.col("doc_id"), 4) != 2), 60))
    held = language.identify(docs.filter(crc_bucket(F.col("doc_id"), 4) == 2), tagger, keep_text=True)
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_sample_takes_every_language(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 70}") for i in range(210)], "doc_id long, text string, lang string")
    assert set(language.language_sample(docs)[1]) == {f"l{i}" for i in range(70)}


def test_language_odd_rows_and_switching(odd, spark):
    tagger = language.train(["the of and with the words"] * 30 + ["der die und mit dem wort"] * 30, ["en"] * 30 + ["de"] * 30)
    for r in language.identify(odd, tagger).collect():
        text = ODD[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1
    words = language.words_of(["the of and with the words der die und mit dem wort"])
    best = tagger.marginals(words, 1).argmax(axis=1)
    assert [tagger.languages[b] for b in best] == ["en"] * 6 + ["de"] * 6
    nothing = language.train([], [])
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_chunked_forward_backward_is_exact():
    import numpy as np

    tagger = language.train(["the of and with the words"] * 30 + ["der die und mit dem wort"] * 30, ["en"] * 30 + ["de"] * 30)
    words = language.words_of(["the of der die " * 50, "und", "mit and " * 17])
    got, z, move = tagger.marginals(words, 3), tagger.scores(words), np.exp(tagger.moves)
    for d in range(3):
        e, ahead, a = np.exp(z[words.owner == d]), [], np.full(2, 0.5)
        for row in e:
            a = (a @ move) * row
            a /= a.sum()
            ahead.append(a)
        b, out = np.ones(2), []
        for t in range(len(e) - 1, -1, -1):
            p = ahead[t] * b
            out.append(p / p.sum())
            b = move @ (e[t] * b)
            b /= b.sum()
        assert np.abs(np.array(out[::-1]) - got[words.owner == d]).max() < 1e-9


def test_licences(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = [f"Some words first.\n{mit}\nand more", mit.upper() + "!", "Nothing of the kind", None, "", licenses.TEMPLATES["mit-permission"].replace(", ", ",\n"), "licensed under something else entirely"]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, license_id string")).collect()
    assert {r.doc_id: r.license_id for r in rows} == {0: "mit", 1: "mit", 2: None, 3: None, 4: None, 5: "mit-permission", 6: None}
    assert all(r.license_score == 1.0 for r in rows if r.license_id)


def test_licences_inside_passages_and_whole_texts(spark):
    isc, mit = licenses.TEXTS["isc-text"], licenses.TEXTS["mit-text"]
    texts = ["Copyright 2020 Jane Roe. Released under the MIT License, see LICENSE.", "word " * 300 + isc.replace(" ", "\n", 9) + " other" * 200, f"so {mit} more", "The MIT License is one of many", isc[:200]]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.license_id for r in rows} == {0: "mit", 1: "isc-text", 2: "mit-text", 3: None, 4: None}
    assert {r.doc_id: r.license_ids for r in rows}[2] == ["mit-permission", "mit-text"]
