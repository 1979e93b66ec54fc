"""Sections and chunks of documents, with stable ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARENT_MAX = 4000
#: Documents of which the pieces are made at once.
ROWS = 64
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def chunk_id(doc_id: Column, index: Column, content: Column) -> Column:
    return F.md5(F.concat(doc_id.cast("string"), F.lit("::chunk-"), index.cast("string"), F.lit("::"), F.substring(content, 1, 50)).cast("binary"))


def parent_id(doc_id: Column, index: Column) -> Column:
    return F.md5(F.concat(doc_id.cast("string"), F.lit("::parent-"), index.cast("string")).cast("binary"))


def fixed_chunks(docs: DataFrame, size: int = 800, overlap: int = 150, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of `size` characters every size - overlap, all in built-in functions. Empty texts give none."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int")))
    rows = docs.withColumn("chunk_index", F.explode(starts)).withColumn("content", F.col(text).substr(F.col("chunk_index") * step + 1, F.lit(size)))
    return rows.withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk_index"), F.col("content"))).drop(text)


def merged(segments: list[str], size: int, overlap: int) -> list[str]:
    """Segments packed greedily; a new chunk starts with the last `overlap` characters of the one before, as far as they are whole segments or the end of one."""
    out: list[str] = []
    held: list[str] = []
    for segment in segments:
        if held and sum(map(len, held)) + len(segment) > size:
            out.append("".join(held))
            tail = "".join(held)[-overlap:] if overlap > 0 else ""
            held = [tail] if tail else []
        held.append(segment)
    return [*out, "".join(held)] if held else out


def recursive_split(text: str, size: int, overlap: int) -> list[str]:
    return [text] if len(text) <= size else merged(re.split(r"\n\s*\n", text), size, overlap)


def sentence_split(text: str, size: int, overlap: int) -> list[str]:
    return merged(re.split(r"(?<=[.!?])\s+", text), size, overlap)


def fixed_split(text: str, size: int, overlap: int) -> list[str]:
    return [text[a : a + size] for a in range(0, len(text), size - overlap)]


STRATEGIES: dict[str, Callable[[str, int, int], list[str]]] = {"recursive": recursive_split, "sentence": sentence_split, "fixed": fixed_split}


def markdown_sections(text: str) -> Iterator[tuple[str | None, str]]:
    """(path of headings, section) in order; headings inside fences are text. Blank sections go, but the last one stays."""
    path: dict[int, str] = {}
    lines: list[str] = []
    title, fenced = None, False
    for line in text.splitlines(keepends=True):
        fenced ^= bool(re.match(r"[ \t]*(```|~~~)", line))
        head = None if fenced else re.match(r"(#{1,6})[ \t]+(.+?)[ \t#]*$", line.rstrip("\r\n"))
        if head:
            if "".join(lines).strip():
                yield title, "".join(lines)
            level = len(head[1])
            path = {k: v for k, v in path.items() if k < level} | {level: head[2].strip()}
            title, lines = " > ".join(path[k] for k in sorted(path)), []
        lines.append(line)
    yield title, "".join(lines)


def capped(section: str, most: int = PARENT_MAX) -> list[str]:
    """The section in pieces of at most `most` characters, cut at empty lines where that goes."""
    if len(section) <= most:
        return [section]
    out, held = [], ""
    for part in re.split(r"(\n\s*\n)", section):
        if held.strip() and len(held) + len(part) > most:
            out.append(held)
            held = ""
        whole, rest = divmod(len(part), most)
        whole -= rest == 0 and whole > 0
        out += [part[i * most : (i + 1) * most] for i in range(whole)]
        held += part[whole * most :]
    return out + [held] if held.strip() else out


def sections(content: str, pages: list[str] | None, filetype: str | None) -> Iterator[tuple[int | None, str | None, str]]:
    """(page, title, text): pages if there are any, else Markdown sections, else the whole text."""
    if pages is not None and len(pages):
        yield from ((n, None, t) for n, t in enumerate(pages, 1))
    elif filetype == ".md":
        yield from ((None, title, t) for title, t in markdown_sections(content))
    else:
        yield None, None, content


SCHEMA = "doc_id string, kind string, parent_index int, chunk_index int, total_chunks int, page int, section string, is_last_page boolean, content string, parent_id string, id string"


def chunk_documents(docs: DataFrame, strategy: str = "recursive", size: int = 800, overlap: int = 150) -> DataFrame:
    """docs (doc_id, content, pages, filetype) -> parent and chunk rows, told apart by kind.

    Chunks never cross a parent; total_chunks counts blank pieces; is_last_page marks the last page with text. Null
    content counts as empty.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    split = STRATEGIES[strategy]

    def rows(doc_id: str, content: str, pages: list[str] | None, filetype: str | None) -> Iterator[tuple]:
        parents, pieces = [], []
        for page, title, text in sections(content or "", pages, filetype):
            for part in capped(text):
                if part.strip():
                    at = len(parents)
                    parents.append((page, title or None, part.strip()))
                    pieces += [(at, page, title or None, piece.strip()) for piece in split(part, size, overlap)]
        last = max((p for _, p, _, piece in pieces if p is not None and piece), default=None)
        for at, (page, title, part) in enumerate(parents):
            yield doc_id, "parent", at, None, None, page, title, None, part
        for i, (at, page, title, piece) in enumerate(pieces):
            if piece:
                yield doc_id, "chunk", at, i, len(pieces), page, title, page == last if page is not None else None, piece

    kinds = [ARROW[column.split(" ")[1]] for column in SCHEMA.split(", ")[:9]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few documents at a time: what is held besides a batch does not grow with it
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                out = [r for d in batch.slice(s, ROWS).to_pylist() for r in rows(d["doc_id"], d["content"], d["pages"], d["filetype"])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[column.split(" ")[0] for column in SCHEMA.split(", ")[:9]])

    given = {f: docs[f] for f in docs.columns}
    ready = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "content",
        given.get("pages", F.lit(None).cast("array<string>")).alias("pages"),
        given.get("filetype", F.lit(None).cast("string")).alias("filetype"),
    )
    made = ready.mapInArrow(run, SCHEMA.rsplit(", parent_id", 1)[0])
    parent = parent_id(F.col("doc_id"), F.col("parent_index"))
    own = F.when(F.col("kind") == "chunk", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content"))).otherwise(parent)
    return made.withColumn("parent_id", parent).withColumn("id", own)
