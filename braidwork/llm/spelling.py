"""Spelling variants: words one edit apart, each traced to the form it most likely stands for.

One insertion, deletion or replacement touches at most two bigrams of a word. So of a word's three rarest bigrams one at
least stands in its neighbour too, among the three rarest there, at the same place or one beside it. Bigrams are put in
one order by frequency, and words are joined by the three alone, with limits on place and length; the pairs are then
verified. Nothing but built-in functions runs over words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import SMALL, written
from braidwork.llm.merkle import LOWER, UPPER

#: Words of at least so many code points, at least so often.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form stands at least so many times as often as the word.
TIMES = 5
#: Bigrams by which a word is joined: two more than one edit can touch, less one.
RAREST = 3


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """word: every run of letters of at least LEAST_LENGTH, A-Z lower-cased, one character left out where `every` divides its hash with the key."""
    letters = rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
    found = docs.select(F.col(key).cast("string").alias("_key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(letters), F.lit(0))).alias("_run"))
    found = found.select("_key", F.translate("_run", UPPER, LOWER).alias("w"))
    h = F.crc32(F.concat(F.coalesce("_key", F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
    at = (h % F.length("w")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return found.select(F.when(h % every == 0, cut).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of all documents that are long and frequent enough; counted in each task first."""
    counted = runs(docs, key, text).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _half(word: Column, length: Column, front: bool) -> Column:
    """The first or the last half of a word as if it had that length: one edit leaves one of the two as it was."""
    h = F.floor(length / 2).cast("int")
    n = F.length(word)
    return F.substring(word, F.lit(1), h) if front else F.substring(word, n - (length - h) + 1, length - h)


def _sides(rows: DataFrame, name: str, length: Column) -> DataFrame:
    """rows with side and half: two a row."""
    both = F.array(*[F.struct(F.lit(front).alias("side"), F.xxhash64(_half(F.col(name), length, front)).alias("half")) for front in (True, False)])
    return rows.withColumn("_s", F.explode(both)).select("*", "_s.side", "_s.half").drop("_s")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every pair of different words that are one edit apart, once.

    Two words of one length share one of their rarest bigrams at one place; a longer one has it there or one further.
    Both share a half of the shorter word, too, which keeps the groups of a common bigram small.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select("word", F.explode(places).alias("place")).withColumn("gram", F.substring("word", F.col("place"), F.lit(2)))
    # at most as many grams as pairs of letters: 116 * 116
    frequency = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("often")))
    ranked = grams.join(frequency, "gram").groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))), 1, RAREST).alias("rarest"))
    rare = written(ranked.select("word", F.length("word").alias("n_chars"), F.explode("rarest").alias("r")).select("word", "n_chars", "r.gram", "r.place"), "rarest")
    own = _sides(rare, "word", F.col("n_chars"))
    same = own.select(F.col("word").alias("a"), "gram", "place", "n_chars", "side", "half")
    # a word seen from one that is a character shorter: its bigrams may stand one further
    shorter = F.explode(F.array(F.col("place"), F.col("place") - 1)).alias("place")
    longer = _sides(rare.withColumn("n_chars", F.col("n_chars") - 1), "word", F.col("n_chars")).select(F.col("word").alias("b"), "gram", shorter, "n_chars", "side", "half", F.lit(True).alias("longer"))
    other = own.select(F.col("word").alias("b"), "gram", "place", "n_chars", "side", "half", F.lit(False).alias("longer")).unionByName(longer)
    keys = ["gram", "place", "n_chars", "side", "half"]
    met = same.join(other, keys).filter(F.col("longer") | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _few(rows: DataFrame) -> DataFrame:
    """The side of a join that is broadcast if its counted words are few: words have no bound on their length, so fewer than of numbers."""
    return F.broadcast(rows) if rows.count() * len(rows.columns) * 10 <= SMALL else rows


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) -> word, root: the last of the forms that follow one another. The way doubles with every round, and a form stands TIMES as often as its word, so rounds are few."""
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = _few(step.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        further = written(step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        step = further.select("word", "root")
        if further.filter("_moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order) if it stands at least TIMES as often as
    the word, else null; root is where the forms lead. Null and empty texts and texts without a long run have no words;
    repeated rows count as often as they stand; a null key is hashed as an empty one. Texts of any length are read
    whole, and a run of any length is a word. Empty tables give empty ones; further columns are not read.
    """
    words = written(vocabulary(docs, key, text), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    # of the largest n the smallest word: the least of (-n, word)
    best = both.join(counts, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("_top", -F.col("best.less"))
    good = F.col("_top") >= TIMES * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, F.col("_top")).alias("form_n")), "forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
