"""Metadata filters, row-level scope, folder rules, page references and the metadata contract."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import let

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: ~c.isin(*v),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$contains": lambda c, v: F.array_contains(c, v),
}


def compiled(where: Mapping[str, Any] | None, prefix: str = "") -> Column:
    """A filter tree as a column that Catalyst can push to the scan. A missing value matches nothing."""
    if not where:
        return F.lit(True)
    out = F.lit(True)
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts = [compiled(v, prefix) for v in value]
            both = parts[0]
            for p in parts[1:]:
                both = (both & p) if key == "$and" else (both | p)
            out = out & both
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                out = out & _COMPARE[op](F.col(prefix + key), operand)
        else:
            out = out & (F.col(prefix + key) == value)
    return out


def scoped(rows: DataFrame, owners: list[str] | None = None, unrestricted_only: bool = False, where: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows this reader may search: visible owners, no restricted rows if asked, and the reader's own filter."""
    out = rows.filter(F.col("owner").isin(*owners)) if owners is not None else rows
    if unrestricted_only:
        out = out.filter(F.col("restricted") == False)  # noqa: E712
    return out.filter(compiled(where))


def readable(rows: DataFrame, owners: list[str] | None = None, unrestricted_only: bool = False) -> DataFrame:
    """Rows this reader may fetch by id; where restricted is missing the row is hidden."""
    out = rows.filter(F.col("owner").isin(*owners)) if owners is not None else rows
    return out.filter(~F.coalesce("restricted", F.lit(True))) if unrestricted_only else out


def visible_owners(user: str | None) -> list[str]:
    return ["shared", user] if user else ["shared"]


def folder_value(path: Column, rules: Mapping[str, Any], default: Any = None) -> Column:
    """The value of the longest configured folder, by path components, that the path is in."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    out = F.lit(default)
    depth = {f: [p for p in f.split("/") if p not in ("", ".")] for f in rules}
    for folder in sorted(rules, key=lambda f: len(depth[f])):
        key = depth[folder]
        inside = F.slice(parts, 1, len(key)) == F.array(*[F.lit(p) for p in key]) if key else F.lit(True)
        out = F.when(inside, F.lit(rules[folder])).otherwise(out)
    return out


#: Rules that are broadcast at most.
FEW_RULES = 200_000


def _folder(path: Column) -> Column:
    """The components of a path; empty ones and dots are none."""
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def folder_values(rows: DataFrame, rules: DataFrame, default: Any = None, path: str = "path", folder: str = "folder", value: str = "value") -> DataFrame:
    """rows with the value of the longest folder of a rule table (folder, value) that their path is in, else default.

    A path is looked up by all its leading folders, each distinct path once, so the work does not grow with the rules
    and none stands in the plan. Of rules for one folder the last value in order counts; a null path is in no folder,
    and the empty folder holds every other.
    """
    named = rules.select(F.array_join(_folder(F.col(folder)), "/").alias("_at"), F.col(value).alias("_value")).groupBy("_at").agg(F.max("_value").alias("_value"))
    parts = _folder(F.col(path))
    paths = rows.select(path).distinct().filter(F.col(path).isNotNull()).withColumn("_parts", parts)
    heads = F.transform(F.sequence(F.lit(0), F.size("_parts")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_parts", F.lit(1), n), "/").alias("at")))
    looked = paths.select(path, F.explode(heads).alias("h")).select(path, F.col("h.n").alias("_n"), F.col("h.at").alias("_at"))
    side = F.broadcast(named) if rules.count() <= FEW_RULES else named
    best = looked.join(side, "_at").groupBy(path).agg(F.max_by("_value", "_n").alias("_found"))
    return rows.join(best, path, "left").withColumn(value, F.coalesce("_found", F.lit(default))).drop("_found")


def document_key(owner: Column, path: Column) -> Column:
    """owner:path; an upload is known by its name without the random prefix."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), "^[0-9a-f]{32}_", "")
    return F.concat(owner, F.lit(":"), F.when(path.startswith("uploads/"), F.concat(F.lit("uploads/"), name)).otherwise(path))


#: Fields that every chunk has, and their type; further ones are checked where they have a value.
CONTRACT = {"metadata_schema_version": ("tinyint", "smallint", "int", "bigint"), "document_id": ("string",), "source": ("string",), "owner": ("string",)}
SCHEMA_VERSION = 1


def contract_errors(rows: DataFrame) -> Column:
    """What is wrong with a chunk's metadata: an empty array for a valid row.

    A field that the table lacks, or has in another type, is wrong in every row. document_id must be the row's doc_id
    where the table has that; a page is a whole number from 1, a section is not blank.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tests = []
    for name, types in CONTRACT.items():
        if kinds.get(name) not in types:
            tests.append(F.lit(f"{name} is missing" if name not in kinds else f"{name} is of another type"))
        else:
            held = F.trim(F.col(name)) != "" if types == ("string",) else F.lit(True)
            tests.append(F.when(F.col(name).isNull() | ~held, F.lit(f"{name} is missing")))
    if kinds.get("metadata_schema_version") in CONTRACT["metadata_schema_version"]:
        tests.append(F.when(F.col("metadata_schema_version") != SCHEMA_VERSION, F.lit("unknown schema version")))
    if {"doc_id", "document_id"} <= kinds.keys():
        tests.append(F.when(F.col("document_id").cast("string") != F.col("doc_id").cast("string"), F.lit("document_id is not doc_id")))
    if "page" in kinds:
        whole = kinds["page"] in CONTRACT["metadata_schema_version"]
        tests.append(F.when(F.col("page").isNotNull() & (F.col("page") < 1 if whole else F.lit(True)), F.lit("page is no page number")))
    if "section" in kinds:
        blank = F.trim(F.col("section")) == "" if kinds["section"] == "string" else F.lit(True)
        tests.append(F.when(F.col("section").isNotNull() & blank, F.lit("section is blank")))
    if {"chunk_index", "total_chunks"} <= kinds.keys():
        tests.append(F.when(~F.coalesce(F.col("chunk_index").between(0, F.col("total_chunks") - 1), F.lit(False)), F.lit("chunk_index out of range")))
    return F.filter(F.array(*tests), lambda t: t.isNotNull())


def accepted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their errors."""
    checked = rows.withColumn("errors", contract_errors(rows))
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def valid_question(question: Column, most: int = 2000) -> Column:
    return F.coalesce(F.length(F.trim(question)).between(1, most), F.lit(False))


def guarded(rows: DataFrame, text: str, blocked: list[str], most: int) -> DataFrame:
    """rows with the reason why a text is not let through, null where it is."""
    low = F.lower(F.col(text))
    word = F.lit(None).cast("string")
    for b in reversed(blocked):
        word = F.when(F.contains(low, F.lit(b.lower())), F.lit(f"blocked keyword: {b}")).otherwise(word)
    return rows.withColumn("blocked", F.coalesce(word, F.when(F.length(text) > most, F.lit("too long"))))


# --- page references ---------------------------------------------------------------------------------------------

# Number words, ordinals, and the words of a page reference in three languages.
NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10,
    "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "erste": 1, "zweite": 2, "dritte": 3, "vierte": 4, "fünfte": 5, "sechste": 6, "siebte": 7, "achte": 8, "neunte": 9, "zehnte": 10,
    "primera": 1, "segunda": 2, "tercera": 3, "cuarta": 4, "quinta": 5, "sexta": 6, "séptima": 7, "octava": 8, "novena": 9, "décima": 10,
    "septima": 7, "decima": 10,
}
#: Words for a page, for pages, and short forms with or without a dot; those that need one.
PAGE, PAGES = ("page", "seite", "pagina", "página"), ("pages", "seiten", "paginas", "páginas")
SHORT, DOTTED = ("pg", "pgs", "pag", "pags", "pág", "págs"), ("p", "pp", "s")
#: What may stand between such a word and a number; what joins two ends of a span, or two pages.
MARKS, SHORT_MARKS = ("number", "numero", "número", "#"), ("no", "nr")
UPTO, ALSO = ("-", "–", "—", "to", "through", "thru", "bis", "hasta", "a"), (",", "&", "and", "und", "y")
#: What counts pages from the start, and what names the last one.
FIRST_OF, LAST = ("first", "ersten", "primeras"), ("last", "final", "letzte", "letzten", "letzter", "letztes", "ultima", "última")
#: What a page is a part of without being a place in a document: a page view, a page table.
COMPOUNDS = ("load", "view", "visit", "hit", "rank", "result", "fault", "table", "size")

_TOKEN = r"(?U)\s*(?:[0-9]+|\p{L}+|\S)"
_REFERENCE = "array<struct<first:int,behind:int,low:int,high:int,last:boolean>>"
_SPAN = "array<struct<low:int,high:int,last:boolean>>"


def _table(words: Mapping[str, Any]) -> Column:
    """A literal map, parsed as one expression: quicker than a call for every word."""
    return F.expr("map(" + ", ".join(f"'{k}', " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in words.items()) + ")")


def _words(question: Column) -> Column:
    """The question's words, numbers and signs in order: raw (with the blanks before), w (lower case), apart (from what is before), kind, and what it counts as number, number word or ordinal."""
    kinds = {w: k for k, words in (("page", PAGE), ("pages", PAGES), ("short", SHORT), ("dotted", DOTTED), ("mark", MARKS), ("no", SHORT_MARKS), ("upto", UPTO), ("also", ALSO), ("first", FIRST_OF), ("last", LAST)) for w in words}
    ordinals = {w + e: n for w, n in ORDINALS.items() for e in ("", "n", "r", "s")}
    raw = F.regexp_extract_all(question, F.lit(_TOKEN), F.lit(0))

    def told(r: Column) -> Column:
        w = F.lower(F.regexp_replace(r, r"(?U)^\s+", ""))
        return F.struct(r.alias("raw"), w.alias("w"), r.rlike(r"(?U)^\s").alias("apart"), F.try_element_at(_table(kinds), w).alias("kind"), F.when(w.rlike("^[0-9]{1,6}$"), w.cast("int")).alias("number"), F.try_element_at(_table(NUMBERS), w).alias("spelled"), F.try_element_at(_table(ordinals), w).alias("ordinal"))

    return F.transform(raw, told)


def _references(words: Column) -> Column:
    """Page references in one pass over the words: first and last word of each, and the pages it names.

    At every word it is asked what stands around it. A number belongs to a page word before it, or carries on the list
    that the number two words before it ended; an ordinal, a count from the start, a spelled number or a word for the
    end need a page word beside them.
    """
    def at(i: Column) -> Column:
        return F.get(words, i)

    def step(state: Column, i: Column) -> Column:
        one, before, behind = at(i), at(i - 1), at(i + 1)
        begins = lambda k: (k == 0) | at(k)["apart"] | ~at(k - 1)["w"].rlike(r"(?U)^[\p{L}0-9_.]")
        place = lambda k: ~(at(k)["apart"] & at(k)["w"].rlike(f"^(?:{'|'.join(COMPOUNDS)})"))
        known = lambda c: F.coalesce(c, F.lit(False))
        kind = lambda k: F.coalesce(at(k)["kind"], F.lit(""))
        dot = lambda k: known((at(k)["w"] == ".") & ~at(k)["apart"])
        # the place of the page word that ends right before word k, null where none does
        label = lambda k: F.when(kind(k - 1).isin("page", "pages", "short"), k - 1).when(dot(k - 1) & kind(k - 2).isin("short", "dotted"), k - 2)
        whole = known(one["number"].isNotNull()) & ~known(~behind["apart"] & behind["w"].rlike(r"(?U)^[\p{L}_]"))
        marked = F.when(kind(i - 1).isin("mark", "no"), label(i - 1)).when(dot(i - 1) & (kind(i - 2) == "no"), label(i - 2))
        named = F.coalesce(label(i), marked)
        numbered = whole & named.isNotNull() & known(begins(named))
        listed = whole & (state["number"] == i - 2) & kind(i - 1).isin("upto", "also")
        n = one["number"]

        def ref(first: Column, last: Column, low: Column, high: Column, end: bool = False) -> Column:
            return F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("behind"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(end).alias("last")))

        refs, none = state["refs"], F.lit(None)
        longer = F.element_at(refs, -1)
        many = F.coalesce(behind["number"], behind["spelled"])
        suffixed = known(~behind["apart"] & behind["w"].isin("st", "nd", "rd", "th"))
        ends = known(before["w"] != "to") | (i == 0)
        found = (
            F.when(numbered, F.concat(refs, ref(named, i, n, n)))
            .when(listed & (kind(i - 1) == "upto"), F.concat(F.slice(refs, 1, F.size(refs) - 1), ref(longer["first"], i, longer["low"], n)))
            .when(listed, F.concat(refs, ref(i - 1, i, n, n)))
            .when(known(begins(i)) & (kind(i) == "first") & many.isNotNull() & (kind(i + 2) == "pages"), F.concat(refs, ref(i, i + 2, F.lit(1), many)))
            .when(known(begins(i)) & one["ordinal"].isNotNull() & (kind(i + 1) == "page") & known(F.coalesce(place(i + 2), F.lit(True))), F.concat(refs, ref(i, i + 1, one["ordinal"], one["ordinal"])))
            .when(known(begins(i)) & n.isNotNull() & suffixed & (kind(i + 2) == "page") & known(F.coalesce(place(i + 3), F.lit(True))), F.concat(refs, ref(i, i + 2, n, n)))
            .when(known(begins(i)) & (kind(i) == "page") & behind["spelled"].isNotNull() & known(F.coalesce(place(i + 2), F.lit(True))), F.concat(refs, ref(i, i + 1, behind["spelled"], behind["spelled"])))
            .when(known(begins(i)) & ends & (((kind(i) == "last") & (kind(i + 1) == "page")) | (one["w"].isin("pagina", "página") & known(behind["w"] == "final"))) & known(F.coalesce(place(i + 2), F.lit(True))), F.concat(refs, ref(i, i + 1, none, none, True)))
            .otherwise(refs)
        )
        return F.struct(F.when(numbered | listed, i).otherwise(state["number"]).cast("int").alias("number"), found.cast(_REFERENCE).alias("refs"))

    start = F.struct(F.lit(-9).alias("number"), F.array().cast(_REFERENCE).alias("refs"))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["refs"])


def page_parts(question: str | Column) -> Column:
    """struct<spans, rest>: the page spans a question names, in order, each once, and the question without them; both from one look at its words."""
    question = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))

    def parts(words: Column) -> Column:
        def told(refs: Column) -> Column:
            spans = F.transform(refs, lambda r: F.struct(F.least(r["low"], r["high"]).alias("low"), F.greatest(r["low"], r["high"]).alias("high"), r["last"].alias("last")))
            rest = F.transform(words, lambda w, i: F.when(F.exists(refs, lambda r: i.between(r["first"], r["behind"])), F.lit(" ")).otherwise(w["raw"]))
            return F.struct(F.array_distinct(spans).cast(_SPAN).alias("spans"), F.trim(F.regexp_replace(F.array_join(rest, ""), r"(?U)\s+", " ")).alias("rest"))

        return let(_references(words), told)

    return let(_words(question), parts)


def page_filter(question: str | Column) -> Column:
    """array<struct<low, high, last>>: the page spans a question names; empty for none."""
    return page_parts(question)["spans"]


def on_pages(spans: Column, page: Column, is_last: Column) -> Column:
    """True where a row's page is in any of the spans."""
    return F.exists(spans, lambda s: F.coalesce(F.when(s["last"], is_last).otherwise(page.between(s["low"], s["high"])), F.lit(False)))


def without_pages(question: str | Column) -> Column:
    """The question without its page references; null for null."""
    question = F.col(question) if isinstance(question, str) else question
    return F.when(question.isNotNull(), page_parts(question)["rest"])
