"""Text functions as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token characters, stopwords, question markers, refusal markers.
TOKEN = "[a-zA-Z0-9À-ɏ]+"
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have how i if in into is it its me my "
    "of on or our should so than that the their them then there these they this those to was we were what when where "
    "which who whom why will with would you your about also any each just more most much not only other some such "
    "very explain describe tell give list name show please define "
    "der die das und ist sind ein eine einer eines wie was wer warum wo welche welcher mit von zu im in den dem des "
    "nicht auch für auf "
    "el la los las un una unos unas y es son como qué que quien por para con de del en al se cual cuales cómo"
).split()
QUESTION_TYPES = (
    ("comparative", ("differ", "difference", "compare", "versus", " vs ", "better than")),
    ("procedural", ("how do", "how does", "how can", "how to", "steps", "process")),
    ("causal", ("why",)),
    ("definition", ("what is", "what are", "define", "meaning of")),
    ("enumeration", ("list", "name ", "which ", "examples")),
)
REFUSALS = (
    "cannot find sufficient information",
    "could not find any relevant information",
    "can't find sufficient information",
    "does not contain sufficient information",
    "doesn't contain sufficient information",
    "do not contain sufficient information",
    "not enough information",
    "insufficient information",
    "keine ausreichenden informationen",
    "keine relevanten informationen",
    "información suficiente",
    "ninguna información relevante",
)
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
CITATION = r"\[(\d+(?:\s*[,;]\s*\d+)*)\]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def content_terms(text: Column) -> Column:
    """Ordered distinct tokens over one character that are no stopwords."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))])
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def squeezed(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that Unicode's full case folding changes: those that become one other, in order, what they become, and those that become several."""
    changed = {c: c.casefold() for c in map(chr, range(0x110000)) if c != c.casefold()}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


@functools.cache
def _near(characters: str) -> str:
    """A character class of a few ranges that hold the characters, and others between them: wide ones are quick to test."""
    points, ranges = sorted(map(ord, characters)), []
    for c in points:
        if ranges and c - ranges[-1][1] < 256:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def casefolded(text: Column) -> Column:
    """Unicode's full case folding, as str.casefold: lower case, then what that leaves, such as a sharp or a long s. Few texts hold a character that becomes several; only those are looked at for each."""
    single, into, several = _folding()

    def spread(value: Column) -> Column:
        for c, f in several.items():
            value = F.replace(value, F.lit(c), F.lit(f))
        return value

    low = F.lower(text)
    some = F.when(low.rlike(_near("".join(several))), spread(low)).otherwise(low)
    return F.translate(some, single, into)


def fingerprint(text: Column) -> Column:
    """sha256 of the squeezed text in full case folding."""
    return F.sha2(casefolded(squeezed(text)), 256)


def snippet(text: Column, limit: int = 180) -> Column:
    """The squeezed text, cut at a word where it is longer than limit."""
    flat = squeezed(text)
    cut = F.substring(flat, 1, limit - 1)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_word = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space >= limit // 2), cut.substr(F.lit(1), space)).otherwise(cut)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(at_word, "[ ,;:]+$", ""), F.lit("…")))


def question_type(question: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = F.lit("other")
    for name, markers in reversed(QUESTION_TYPES):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(padded, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def is_vague(question: Column) -> Column:
    return F.size(content_terms(question)) < 2


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    return F.exists(F.array(*[F.lit(m) for m in REFUSALS]), lambda m: F.contains(low, m))


def citation_markers(answer: Column) -> Column:
    """Every cited source number in order."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda n: n.cast("int"))))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def term_hits(terms: Column, vocabulary: Column, cut: int | None = None) -> Column:
    """Terms found in the vocabulary, as they are or, from four characters, as the start of a word (their first `cut` characters if given)."""
    def found(t: Column) -> Column:
        head = F.substring(t, 1, cut) if cut else t
        return F.array_contains(vocabulary, t) | ((F.length(t) >= 4) & F.exists(vocabulary, lambda v: F.startswith(v, head)))

    return F.filter(terms, found)


def term_coverage(terms: Column, vocabulary: Column) -> Column:
    """Share of terms in the vocabulary; 1 without terms."""
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(term_hits(terms, vocabulary)) / F.size(terms))


def missing_terms(terms: Column, vocabulary: Column) -> Column:
    return F.array_except(terms, term_hits(terms, vocabulary))


def lexical_overlap(sentence: Column, reference: Column) -> Column:
    """Share of the sentence's content terms in the reference, tolerant after four characters; 1 without terms."""
    terms, vocabulary = content_terms(sentence), F.array_distinct(tokens(reference))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(term_hits(terms, vocabulary, 4)) / F.size(terms))


def normalised_query(text: Column) -> Column:
    return squeezed(F.lower(text))


def routed_language(lang: Column, supported: tuple[str, ...] = ("de", "en", "es")) -> Column:
    """The language's collection; anything unsupported goes to en."""
    return F.when(lang.isin(*supported), lang).otherwise(F.lit("en"))


#: Words by which a text's language is told where nothing else tells it.
LANGUAGE_WORDS = {
    "de": "der die das und ist nicht mit ein eine für auf von zu den dem werden auch sich".split(),
    "en": "the of and to in is that for with as this are was not be from by on".split(),
    "es": "el la los las y de que en un una con por para no se del es lo".split(),
}


def detected_language(text: Column, default: str = "en") -> Column:
    """The language whose common words a text has most of; ties and texts without any go to the default."""
    words = tokens(text)

    def voted(said: Column) -> Column:
        counts = F.array(*[F.struct(F.size(F.filter(said, _one_of(words_))).alias("n"), F.lit(lang).alias("lang")) for lang, words_ in sorted(LANGUAGE_WORDS.items())])
        best = F.array_max(F.transform(counts, lambda c: c["n"]))
        first = F.filter(counts, lambda c: c["n"] == best)
        return F.when((best > 0) & (F.size(first) == 1), F.element_at(first, 1)["lang"]).otherwise(F.lit(default))

    return let(words, voted)


def _one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def stream_pieces(answer: Column) -> Column:
    """Pieces of an answer as they are streamed: a word with the blanks behind it, or leading blanks."""
    return F.regexp_extract_all(answer, F.lit(r"\S+\s*|\s+"), F.lit(0))


def placeholders(prompt: Column) -> Column:
    """Sorted distinct {names} of a template."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\{(\w+)\}"), F.lit(1))))


def prompt_valid(prompt: Column, required: Column) -> Column:
    """A template must name exactly the fields it declares."""
    return placeholders(prompt) == F.array_sort(F.array_distinct(required))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, when no tokenizer is at hand."""
    return F.floor(F.length(text) / 4).cast("long")


def normalised_verdicts(verdicts: Column, n: Column) -> Column:
    """Verdicts cut or padded with false to n."""
    given = F.coalesce(verdicts, F.array().cast("array<boolean>"))
    return F.slice(F.concat(given, F.array_repeat(F.lit(False), n)), 1, n)


def json_object(reply: Column) -> Column:
    """The first balanced {...} of a judge's reply that parses as JSON, null where there is none. Replies are short: the work is a brace's times a reply's length."""
    def depths(chars: Column) -> Column:
        steps = F.transform(chars, lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
        return F.aggregate(steps, F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))

    def found(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(x["chars"])), lambda i: F.element_at(x["chars"], i) == "{")
        end = lambda i: F.try_element_at(F.filter(F.sequence(i, F.size(x["chars"])), lambda j: F.get(x["depth"], j) < F.get(x["depth"], i)), F.lit(1))
        return F.try_element_at(F.filter(F.transform(at, lambda i: F.substring(reply, i, end(i) - i + F.lit(1))), lambda o: F.get_json_object(o, "$").isNotNull()), F.lit(1))

    chars = F.filter(F.split(reply, ""), lambda c: c != "")
    return F.when(F.contains(reply, F.lit("{")), let(chars, lambda c: let(F.struct(c.alias("chars"), depths(c).alias("depth")), found)))


def judged(reply: Column) -> Column:
    """struct<score, verdict> of a judge's reply; without JSON the words true and false decide."""
    parsed = F.from_json(json_object(reply), "score double, verdict boolean")
    low = F.lower(reply)
    guess = F.when(F.contains(low, F.lit("true")) & ~F.contains(low, F.lit("false")), True).otherwise(False)
    return F.struct(parsed["score"].alias("score"), F.coalesce(parsed["verdict"], guess).alias("verdict"))


def localized(messages: DataFrame, catalog: DataFrame, key: str = "message", lang: str = "lang") -> DataFrame:
    """Messages in their language where the catalogue (message, lang, translation) has them, else as they are."""
    return messages.join(catalog.select(key, lang, "translation"), [key, lang], "left").withColumn("text", F.coalesce("translation", F.col(key))).drop("translation")
