"""Removed repeats, spelling variants and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork.llm import merkle, registry, repeats, spelling
from braidwork.llm.common import crc_bucket


# --- plain versions ------------------------------------------------------------------------------------------------


def plain_removal(docs, least):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(b[s : s + least] for b in texts for s in range(len(b) - least + 1))
    out = []
    for (i, _), b in zip(docs, texts, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = [True] * least
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def plain_variants(docs):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def edits(w):
        letters = {c for x in words for c in x}
        for k in range(len(w) + 1):
            yield w[:k] + w[k + 1 :]
            for c in letters:
                yield w[:k] + c + w[k:]
                yield w[:k] + c + w[k + 1 :]

    near = {w: {x for x in edits(w) if x in words and x != w} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    rows = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def plain_manifest(rows):
    """rows (key, tree, leaf, claimed) in any order."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def tree(nodes):
        """The root, and every node's levels of siblings."""
        ways, of = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            up = []
            for at in range(0, len(nodes), 8):
                run = nodes[at : at + 8]
                for k, _ in enumerate(ways):
                    if at <= of[k] < at + 8:
                        ways[k].append(("".join(run[: of[k] - at]), "".join(run[of[k] - at + 1 :])))
                up.append(digest("".join(run)))
            nodes, of = up, [x // 8 for x in of]
        return nodes[0], ways

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inside = {}
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        inside[t] = tree([r[2] for r in trees[t]])
    root, over = tree([inside[t][0] for t in order])
    out = []
    for t, above in zip(order, over, strict=True):
        for row, own in zip(trees[t], inside[t][1], strict=True):
            h = row[3]
            for before, after in own + above:
                h = digest(before + h + after)
            out.append((row[0], row[2], inside[t][0], root, digest("".join(b + a for b, a in own + above)), h, h == root))
    return sorted(out, key=repr)


# --- repeats -------------------------------------------------------------------------------------------------------


def made_texts(seed, n=60):
    made = random.Random(seed)
    words = ["".join(made.choice("abcdeé") for _ in range(made.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(made.choice(words) for _ in range(made.randint(10, 60))) for _ in range(4)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(made.randint(0, 4)):
            kind = made.random()
            if kind < 0.3:
                text += made.choice(passages)
            elif kind < 0.5:
                changed = list(made.choice(passages))
                changed[made.randrange(len(changed))] = "x"
                text += "".join(changed)
            elif kind < 0.7:
                text += made.choice(["a", "ab", "\0"]) * made.randint(1, 120)
            else:
                text += " ".join(made.choice(words) for _ in range(made.randint(1, 40)))
        docs.append((i if made.random() < 0.9 else None, text if made.random() < 0.95 else None))
    return docs + docs[:5]


@pytest.mark.parametrize(("seed", "most"), [(1, repeats.MOST), (2, 3)])
def test_removal_equals_plain(spark, seed, most):
    """Shared and changed passages, periodic texts, null ids and texts, repeated rows; large buckets are cut into bands."""
    docs = made_texts(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("h", F.lit("x"))
    got = sorted([tuple(r) for r in repeats.remove_repeats(df, 60, most=most).collect()], key=repr)
    want = plain_removal(docs, 60)
    assert got == want and sum(r[2] for r in want) > 1000


def test_removal_query_equals_plain(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op11_repeats"](spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_removal(docs, 200)


def test_removal_of_long_texts_in_steps(spark, monkeypatch):
    """A text longer than a hashing step, with a passage across the edge of one, and one that repeats inside itself."""
    monkeypatch.setattr(repeats, "STEP", 1 << 12)
    made = random.Random(4)
    passage = "".join(made.choice("abcdefgh ") for _ in range(700))
    noise = lambda n: "".join(made.choice("abcdefghijklmnop") for _ in range(n))
    docs = [(1, noise(3900) + passage + noise(9000)), (2, noise(10) + passage), (3, noise(500) + passage[:199]), (4, noise(300) + "q" * 500), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted([tuple(r) for r in repeats.remove_repeats(df, 200).collect()], key=repr) == plain_removal(docs, 200)


def test_removal_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none, 200).collect() == []


def test_interval_tree_gives_maximal_repeats():
    """Against all maximal repeats of a text, found by trying every string."""
    made = random.Random(7)
    for _ in range(40):
        text = "".join(made.choice("ab") for _ in range(made.randint(2, 24))) + "$"
        order = sorted(range(len(text)), key=lambda s: text[s:])
        common = lambda a, b: next(k for k in range(len(text) + 1) if text[a : a + k + 1] != text[b : b + k + 1])
        shared = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
        owner, found = repeats.interval_tree(shared, [ord(text[s - 1]) if s else repeats.DIVERSE for s in order])
        want = set()
        for s in range(len(text)):
            for e in range(s + 1, len(text)):
                at = [i for i in range(len(text)) if text.startswith(text[s:e], i)]
                if len(at) > 1 and len({text[i - 1] if i else f"edge{i}" for i in at}) > 1 and len({text[i + e - s] for i in at}) > 1:
                    want.add((text[s:e], len(at)))
        assert {(text[order[first] : order[first] + length], n) for length, n, first, _ in found} == want
        for i, g in enumerate(owner):  # every suffix is in the smallest of its repeats, and in all above it
            mine = {k for k, (_, n, first, _) in enumerate(found) if first <= i < first + n}
            above = set()
            while g >= 0:
                above.add(g)
                g = found[g][3]
            assert above == mine


def test_repeats_are_groups_with_all_occurrences(spark):
    """Three texts with one passage, two of them with more around it: a group of three, and inside it one of two."""
    made = random.Random(9)
    noise = lambda n: "".join(made.choice("abcdefghijklmnop") for _ in range(n))
    core, wide = noise(80), noise(40)
    docs = [(1, noise(50) + wide + core + noise(50)), (2, noise(70) + wide + core + noise(20)), (3, noise(30) + core + noise(90))]
    _, _, places, found = repeats.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 60)
    groups = {r.occurrences for r in found.collect()}
    assert groups == {2, 3} and places.select("node", "node2").distinct().count() == 3
    parents = found.filter("occurrences = 2 AND parent IS NOT NULL").join(found.select(F.col("repeat").alias("parent"), F.col("occurrences").alias("above")).distinct(), "parent")
    assert all(r.above == 3 for r in parents.collect())


# --- spelling ------------------------------------------------------------------------------------------------------


def test_variants_equal_plain(spark):
    made = random.Random(3)
    words = ["".join(made.choice("abcé") for _ in range(made.randint(5, 9))) for _ in range(60)] + ["Straßen", "STRASSEN", "aaaaaa", "aaaaaaa", "aaaaaab", "ÀÀÀÀÀÀ", "àààààà"]
    docs = [(made.choice([i, None]), " ".join(made.choice(words) for _ in range(made.randint(0, 80)))) for i in range(120)] + [(1, None), (2, ""), (3, "ab 12 é")]
    docs += [(500 + i, "aaaaaa " * 40) for i in range(9)] + docs[:4]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0))
    got = sorted(tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_variants(docs)
    assert got == want and any(r[1] for r in want)


def test_variants_query_equals_plain(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op12_spelling"](spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in got) == plain_variants(docs)


def test_variants_of_nothing_and_of_one_long_run(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "abcdefgh" * 2000
    rows = spelling.spelling_variants(spark.createDataFrame([(i, long) for i in range(6)], "doc_id long, text string")).collect()
    assert all(r.form is None and r.root == r.word and len(r.word) >= len(long) - 1 for r in rows)


def test_roots_follow_forms_to_the_end(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w11"} and len(got) == 12


# --- manifest ------------------------------------------------------------------------------------------------------


def leaves(seed, n, trees):
    made = random.Random(seed)
    rows = []
    for i in range(n):
        h = hashlib.sha256(str(made.randrange(10**9)).encode()).hexdigest()
        rows.append((made.choice([i, i, i, None, 7]), made.choice(trees), h, h if made.random() < 0.7 else h[::-1]))
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "trees", "levels", "top"), [(300, ["b", "a", None, "é"], 1, 6), (700, ["x"], 2, 100), (150, [str(i) for i in range(40)], 1, 8), (1, ["a"], 4, 4096), (9, ["a", "b"], 4, 4096)])
def test_manifest_equals_plain(spark, n, trees, levels, top):
    """Blocks over blocks, more trees than the driver may hold, single leaves, ties, null keys and trees, repeated rows."""
    rows = leaves(n, n, trees)
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, claimed string").withColumn("pos", F.lit(0)).withColumn("key", F.lit("k"))
    got = [tuple(r) for r in merkle.manifest(df, levels=levels, top=top).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, lang string, leaf string, claimed string")).collect() == []


def test_leaves_of_documents(spark):
    docs = spark.createDataFrame([(3, "Äb C", "en", "web", 4), (None, None, None, None, None), (1, "same", "é", "", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.leaf, r.claimed) for r in merkle.document_leaves(docs, crc_bucket(F.col("doc_id"), 3) >= 0).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[None] == (digest("-----"),) * 2
    assert got[3] == (digest("1:33:web2:en1:45:Äb C"), digest("1:33:web2:en1:45:Äb c"))
    assert got[1] == (digest("1:10:2:é1:44:same"),) * 2
