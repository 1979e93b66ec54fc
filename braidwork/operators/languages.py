"""The language of texts without a language column, from profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators import scoring
from braidwork.sources.shared import written

#: Rows of a side that is broadcast, and of profiles that go along with the texts or are gathered by a task.
SMALL, HELD = 200_000, 1 << 20
DEFAULT = "en"


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def trigrams(word: Column) -> Column:
    """The trigrams of a word with its edges marked."""
    chars = F.split(F.concat(F.lit("_"), word, F.lit("_")), "")
    return F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.concat(chars[i], chars[i + 1], chars[i + 2]))


def _grams(said: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of words with their edges marked, 21 bits a character, and the place of each one's word."""
    size = np.asarray(pc.utf8_length(said), np.int64)
    c = np.frombuffer(("_" + "__".join(said.to_pylist()) + "_").encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.arange(size.sum()) + 2 * np.repeat(np.arange(len(size)), size)  # two marks for each word before
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2], np.repeat(np.arange(len(size)), size)


def _spelled(codes: np.ndarray) -> pa.Array:
    """Trigrams as strings."""
    text = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _said(lowered: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Steps of texts: from and up to which, and for every word its text in the step and its place among the step's distinct words, which come last."""
    for s, e in scoring.slices(lowered):
        flat, size = scoring.words(lowered.slice(s, e - s), r"\P{L}+")
        coded = flat.dictionary_encode()
        yield s, e, np.repeat(np.arange(e - s), size), np.asarray(coded.indices, np.int64), coded.dictionary


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, lang, c of a task's rows (lang, lower-cased text): a step's words are counted first, trigrams of each word once."""
    parts: list[pa.Table] = []
    held, kind = 0, pa.string()
    fold = lambda: pa.concat_tables(parts).group_by(["code", "lang"]).aggregate([("c", "sum")]).rename_columns(["code", "lang", "c"])
    for batch in batches:
        kind = batch.column(0).type
        langs = batch.column(0).dictionary_encode()
        of = np.asarray(langs.indices, np.int64)
        for s, e, row, word, distinct in _said(batch.column(1)):
            pair, n = np.unique(of[s:e][row] * max(1, len(distinct)) + word, return_counts=True)
            lang, word = np.divmod(pair, max(1, len(distinct)))
            code, _ = _grams(distinct)
            size = np.asarray(pc.utf8_length(distinct), np.int64)
            first, size = (np.cumsum(size) - size)[word], size[word]
            which = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            made = pa.table({"code": code[which], "lang": langs.dictionary.take(pa.array(np.repeat(lang, size))), "c": np.repeat(n, size).astype(np.int64)})
            parts.append(made.group_by(["code", "lang"]).aggregate([("c", "sum")]).rename_columns(["code", "lang", "c"]))
            held += len(parts[-1])
            if held > HELD:
                parts[:] = [fold()]
                held = len(parts[0])
    for batch in fold().to_batches(1 << 16) if parts else ():
        yield pa.RecordBatch.from_arrays([_spelled(batch.column("code").to_numpy()), batch.column("lang").cast(kind), batch.column("c")], names=["gram", "lang", "c"])


def profiles(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """gram, lang, logp of rows with a language, for every trigram of any of them: log((times + 1) / (all of the language + distinct trigrams)). They are counted where a text is read: what is shuffled are a task's trigrams."""
    counted = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.lower(text)).mapInArrow(_times, "gram string, lang string, c long")
    times = written(counted.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "trigrams")
    totals = times.groupBy("lang").agg(F.sum("c").alias("total"))
    grams = times.select("gram").distinct()
    every = grams.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(grams.agg(F.count("*").alias("v"))))  # a row per trigram and language
    return every.join(times, ["lang", "gram"], "left").select("gram", "lang", F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("total") + F.col("v"))).alias("logp"))


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def by_profile(rows: DataFrame, profile: DataFrame, key: str = "doc_id", text: str = "text", default: str = DEFAULT) -> DataFrame:
    """key, lang: the language of largest likelihood under the profiles (gram, lang, logp), by all trigrams of a text that some profile has.

    Profiles of up to HELD rows, counted, go along with the texts, and a row's sums are made where it is read; larger
    ones are joined. Every distinct word is looked up once, whatever the texts' lengths; texts then add up their words.
    Rows of one key are one text. Texts without a letter, without a known trigram, or with two best languages are of
    the default: the same text always goes the same way.
    """
    profile = written(profile.select("gram", "lang", "logp"), "profile")
    if profile.count() <= HELD:
        return _with_profiles(rows, profile.toArrow(), key, text, default)
    return _joined(rows, profile, key, text, default)


def _with_profiles(rows: DataFrame, profile: pa.Table, key: str, text: str, default: str) -> DataFrame:
    """by_profile with profiles that every task holds: one row a text leaves it, with a sum for each language."""
    profile = profile.filter(pc.equal(pc.utf8_length(profile.column("gram")), 3)).combine_chunks()
    langs = sorted(set(profile.column("lang").to_pylist()) - {None})
    gram = profile.column("gram").combine_chunks().dictionary_encode()
    c = np.frombuffer("".join(gram.dictionary.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
    code = c[:, 0] << 42 | c[:, 1] << 21 | c[:, 2]
    order = np.argsort(code)
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code))
    logp, known = np.zeros((len(langs), len(code))), np.zeros((len(langs), len(code)))
    number = np.asarray(pc.index_in(profile.column("lang"), pa.array(langs, pa.string())).combine_chunks(), np.int64)
    at = place[np.asarray(gram.indices, np.int64)]
    np.add.at(logp, (number, at), profile.column("logp").to_numpy())
    known[number, at] = 1
    given = rows.sparkSession.sparkContext.broadcast((code[order], logp, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logp, known = given.value
        for batch in batches:
            for s, e, row, word, distinct in _said(batch.column(1)):
                found, of = _grams(distinct)
                near = np.minimum(np.searchsorted(codes, found), max(0, len(codes) - 1))
                hit = codes[near] == found if len(codes) else np.zeros(len(found), bool)
                near, of = near[hit], of[hit]
                sums = []
                for p, k in zip(logp, known, strict=True):
                    score, n = (np.bincount(row, weights=np.bincount(of, weights=x[near], minlength=len(distinct))[word], minlength=e - s) for x in (p, k))
                    sums.append(pa.array(score, mask=n == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *sums], names=["key", *[f"s{i}" for i in range(len(langs))]])

    kind = rows.schema[key].dataType.simpleString()
    each = rows.select(F.col(key).alias("key"), F.lower(text)).mapInArrow(run, ", ".join([f"key {kind}", *[f"s{i} double" for i in range(len(langs))]]))
    total = each.groupBy("key").agg(F.array(*[F.round(F.sum(f"s{i}"), 6) for i in range(len(langs))]).cast("array<double>").alias("s"))
    first = F.filter(F.arrays_zip("s", F.lit(langs).cast("array<string>").alias("lang")), lambda x: x["s"] == F.array_max("s"))
    lang = F.when(F.col("key").isNotNull() & (F.size(first) == 1), first[0]["lang"])
    return total.select(F.col("key").alias(key), F.coalesce(lang, F.lit(default)).alias("lang"))


def _joined(rows: DataFrame, profile: DataFrame, key: str, text: str, default: str) -> DataFrame:
    """by_profile with profiles of any size."""
    said = written(rows.select(F.col(key).alias("key"), F.explode(words(F.col(text))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n")), "said")
    grams = said.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    scores = written(grams.join(_few(profile), "gram").groupBy("word", "lang").agg(F.sum("logp").alias("score")), "words")
    total = said.join(_few(scores), "word").groupBy("key", "lang").agg(F.round(F.sum(F.col("n") * F.col("score")), 6).alias("score"))
    best = total.groupBy("key").agg(F.max("score").alias("score"))
    first = total.join(best, ["key", "score"]).groupBy("key").agg(F.when(F.count("*") == 1, F.min("lang")).alias("lang"))
    keys = rows.select(F.col(key).alias("key")).distinct()
    return keys.join(first, "key", "left").select(F.col("key").alias(key), F.coalesce("lang", F.lit(default)).alias("lang"))
