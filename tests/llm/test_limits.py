"""Hard inputs: texts that cancel out in polynomial hashes, long texts, large families, empty and odd tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import ann, common, jaccard, kernels, language, licenses, packing, pii, quality, tokens
from braidwork.llm.registry import tokenizer_path
from braidwork.llm.repetition import repetition
from tests.llm import brute


def morse(n):
    """Two strings of n characters that a polynomial hash modulo 2**64 does not tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 2048, 4096])
def test_hashes_tell_cancelling_texts_apart(n):
    a, b = (x.encode() for x in morse(n))
    data = np.frombuffer(a + b, np.uint8)
    h = kernels.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    assert (kernels.span_hashes(np.frombuffer(b"xx" + a, np.uint8), np.array([2]), np.array([n + 2])) == h[:1]).all()


@pytest.mark.parametrize("n", [2048, 4096])
def test_operators_tell_cancelling_texts_apart(spark, n):
    a, b = morse(n)
    words = " ".join(a[i : i + 8] for i in range(0, n, 8)), " ".join(b[i : i + 8] for i in range(0, n, 8))
    rows = [(1, a), (2, b), (3, a + "\n" + b), (4, words[0]), (5, words[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    e = tokens.Encoder(tokenizer_path())
    want = {i: [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got = {}
    for r in tokens.token_pieces(docs, tokenizer_path(), 2048, 0).collect():
        got.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in got.items()} == want
    assert {r.doc_id: r.n_dup_lines for r in repetition(docs).collect()}[3] == 0
    assert sorted(map(tuple, jaccard.jaccard_components(docs).collect())) == sorted(brute.components(rows, 4, 85))


def test_a_unit_of_another_text_is_never_reused(monkeypatch):
    """Were all hashes equal, ids would still be right."""
    monkeypatch.setattr(tokens, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    e = tokens.Encoder(tokenizer_path())
    for text in ("one two three", "other words here", "one"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert e.encode(raw, np.array([0, len(raw)]))[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [(500, 1000, 2000)])
def test_near_copies_cost_in_proportion(spark, monkeypatch, sizes):
    """A family made of a text that is not in the table: many pairs are alike, few links come out."""
    counts = []
    links, members = jaccard._tree_links, jaccard._tree_members
    monkeypatch.setattr(jaccard, "_tree_links", lambda *a: (lambda df: counts.append(df.count()) or df)(links(*a)))
    monkeypatch.setattr(jaccard, "_tree_members", lambda *a: (lambda df: counts.append(df.count()) or df)(members(*a)))
    out = []
    for n in sizes:
        random.seed(n)
        base, rows = [f"w{i}" for i in range(150)], []
        for i in range(n):
            words = list(base)
            for _ in range(random.randint(1, 4)):
                words[random.randrange(150)] = f"x{random.randrange(10**9)}"
            rows.append((i, " ".join(words)))
        counts.clear()
        got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85, 4).collect()))
        if n <= 1000:
            assert got == sorted(brute.components(rows, 4, 85))
        out.append(list(counts))
    for n, (paired, linked) in zip(sizes, out, strict=True):
        assert linked <= n and paired <= n * max(2, 2 * -(-n // jaccard.CELL))


def test_packing_goes_through_the_program(monkeypatch):
    calls = []
    plain = packing.fractional
    monkeypatch.setattr(packing, "fractional", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(0)
    demand = np.zeros(2049, np.int64)
    for l in np.concatenate([rng.integers(1, 2048, 400), rng.integers(1, 200, 800)]):
        demand[l] += 1
    used = packing.solve(demand, 2048)
    least = -(-int((demand * np.arange(2049)).sum()) // 2048)
    assert calls and least <= sum(used.values()) <= min(least + 1, sum(packing._best_fit(demand, 2048).values()))


def test_quality_equals_plain_means(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    model = quality.train(texts[:40], [i % 2 for i in range(40)], epochs=2)

    def hashed(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        at, share, edges = quality.buckets(raw, np.array([0, len(raw)]))
        assert edges[-1] == len(at) and (not len(at) or abs(share.sum() - 1) < 1e-4)
        words = len(brute.re.findall(brute.BLANKS, text))
        grams = [max(0, len(raw) - g + 1) for g in quality.GRAMS]
        out, k = [], 0
        for n in [words, words, *grams]:
            out.append(at[k : k + n].tolist())
            k += n
        return out

    odd = ["", " ", "a", "one two", "word " * 500]
    for text in texts[40:] + odd:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.probabilities(raw, np.array([0, len(raw)]))[0]
        assert np.abs(got - brute.quality(model, text, quality.BITS, hashed)).max() < 1e-4


def test_repetition_verdict_equals_the_plain_one(spark):
    random.seed(5)
    rows = []
    for i in range(120):
        fresh = [f"w{random.randrange(10**6)}" for _ in range(random.randint(40, 300))]
        passage = [f"p{random.randrange(10**6)}" for _ in range(random.randint(3, 60))]
        for _ in range(random.randint(0, 4)):
            j = random.randrange(len(fresh))
            fresh[j:j] = passage
        sep = random.choice([" ", "\n", " "])
        rows.append((i, sep.join(fresh)))
    got = {r.doc_id: r.kept for r in repetition(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: brute.verdict(t) for i, t in rows} and 10 < sum(got.values()) < 110


def seconds(work):
    began = time.monotonic()
    work()
    return time.monotonic() - began


def test_long_texts_of_spans_take_time_in_proportion(spark):
    def mails(n):
        text = " ".join(f"user{i}@mail{i % 7}.example.com (348) 555-{1000 + i % 9000}" for i in range(n))
        return spark.createDataFrame([(1, text)], "doc_id int, text string")

    def found(n):
        row = pii.find_spans(mails(n)).select(F.size("spans").alias("n"), pii.redacted(F.col("text"), F.col("spans")).alias("t")).first()
        assert row.n == 2 * n and row.t == " ".join(["[EMAIL] [PHONE]"] * n)

    found(100)
    short, long = seconds(lambda: found(4_000)), seconds(lambda: found(32_000))
    assert long < 8 * max(short, 1.0)


def test_added_spans_of_one_stretch(spark):
    texts = ["call (348) 555-3032, tel. (349) 555-3032", "visa 378282246310005 call 378-282-2463", "a@b.co call (348) 555-3032 1.2.3.4 +49 30 1234567"]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        base = {(s.start, s.end) for s in r.base}
        places = sorted((s.start, s.end) for s in r.spans)
        assert base <= set(places) and [s for s in r.spans] == sorted(r.spans)
        extra = [p for p in places if p not in base]
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in extra for b in places if a != b), t


@pytest.mark.parametrize("operator", ["licenses", "pii", "repetition", "language", "tokens", "pieces", "quality"])
def test_empty_repeated_and_very_long_rows(spark, operator, tmp_path):
    long = " ".join(f"word{i % 977} of the text" for i in range(60_000)) + " Released under the MIT License. a@b.co"
    rows = [(1, long, "clash"), (2, "short a@b.co", "clash"), (2, "short a@b.co", "clash"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    tagger = language.train(["the of and with the words"] * 30 + ["der die und mit dem wort"] * 30, ["en"] * 30 + ["de"] * 30)
    model = quality.train(["good words here", "spam spam"] * 5, [1, 0] * 5)

    def run(df, k):
        if operator == "licenses":
            return licenses.scan_licenses(df).drop("license_ids")
        if operator == "pii":
            return pii.find_spans(df).select("doc_id", pii.spelled(F.col("spans")).alias("s"))
        if operator == "repetition":
            return repetition(df).drop("dup_gram_chars")
        if operator == "language":
            return language.identify(df, tagger)
        if operator == "quality":
            return quality.score(df, model, 1)
        if operator == "pieces":
            return tokens.token_pieces(df, tokenizer_path(), 2048, 0)
        tokens.write_tokens(df, str(tmp_path / f"t{k}"), tokenizer_path(), 2)
        return tokens.read_tokens(spark, str(tmp_path / f"t{k}")).drop("start")

    assert run(docs.limit(0), 0).count() == 0
    got = run(docs, 1).collect()
    if operator == "pieces":
        assert sum(r.doc_id == 1 for r in got) > 50 and sum(r.doc_id == 2 for r in got) == 2
        return
    assert len(got) == 4
    two = [tuple(r) for r in got if r.doc_id == 2]
    assert len(two) == 2 and two[0] == two[1]
    if operator == "licenses":
        assert [r.license_id for r in got if r.doc_id == 1] == ["mit"]
    if operator == "pii":
        assert [r.s for r in got if r.doc_id == 1] == [f"email:{len(long) - 6}:{len(long)}"]


def test_repeated_vector_keys(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (1, [5.0, 5.0]), (2, [1.0, 0.2]), (3, [9.0, 9.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, query_id int, score string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_seventy_languages(spark):
    random.seed(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(random.choices(letters, k=6)) for _ in range(12)] for k in range(70)}
    texts = [(" ".join(random.choices(w, k=40)), lang) for lang, w in words.items() for _ in range(6)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    tagger = language.train(*language.language_sample(docs, 5))
    held = language.identify(docs, tagger, keep_text=True)
    assert len(tagger.languages) == 70
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_rows_in_the_mix_are_taken_as_the_plan_says(spark):
    from braidwork.llm.common import WORD
    from braidwork.llm.mixing import mix_sources, mixed, word_count

    random.seed(4)
    rows = [(i, random.choice(["a", "a", "b", None, "c"]), random.choice(["", "w " * random.randint(1, 90)]), 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int").repartition(4)
    got = {r.doc_id: (r.text, r.size, r._copies) for r in mixed(docs, word_count(F.col("text")), F.col("text").rlike(WORD)).collect()}
    want = {r.doc_id: r.copies for r in mix_sources(docs, word_count(F.col("text"))).collect()}
    assert got.keys() == want.keys() and all(got[i][2] == pytest.approx(want[i]) for i in want)
    assert all(got[i][:2] == (t, 1) for i, _, t, _ in rows)


# --- samples -------------------------------------------------------------------------------------------------------


def test_shares_of_huge_tables_are_not_empty(spark):
    """Of any number of rows the share of a sample of 150 is hit: nested in that of larger shares, and near its size."""
    keys = spark.range(1 << 20).select("id")
    count = lambda share: keys.filter(common.sampled(F.col("id"), "language", F.lit(share))).count()
    assert keys.filter(common.sampled(F.col("id"), "language", F.lit(1.0))).count() == 1 << 20
    assert 400 < count(500 / (1 << 20)) < 600
    # a share that no bucket of 2 ** 20 can give: 150 of 10 ** 8 rows
    assert 90 < spark.range(10**8).filter(common.sampled(F.col("id"), "language", F.lit(150 / 10**8))).count() < 220


def test_samples_stay_small_whatever_keys_repeat(spark):
    """Rows without an id, and rows that share one, are all taken or none: the sample is cut to twice its size."""
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    texts, langs = language.language_sample(docs, 20)
    assert len(texts) <= 2 * 20 * 2 and len(texts) == len(langs)
    other = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("en").alias("lang"))
    assert 5 <= len(language.language_sample(other, 20)[0]) <= 40
    long = other.withColumn("text", F.repeat("text", 20_000))
    assert language.language_sample(long, 20) == ([], [])
    labels = spark.range(4000).select((F.col("id") % 5).alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.labelled_sample(other, labels, "quality", 50).num_rows <= 100


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, none, "quality", 10)
    model = quality.train(sample.column(0).to_pylist(), sample.column(1).to_pylist())
    assert [r.score for r in quality.score(docs, model, 1).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("dim", [768, 2048])
def test_wide_vectors_are_scored_in_steps(spark, dim):
    made = np.random.default_rng(dim)
    x = made.normal(size=(300, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(300) if i != q)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [s for s, _ in want])
