"""Repetition coverage: how much of a text stands inside n-grams and lines that the text repeats.

Every text is read whole. Rolling hashes of several n-gram lengths are made in numpy over all texts of a slice
at once; two windows are equal where their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidwork.llm.kernels import U, blocks, gram_hashes, mix, per_text, span_hashes, word_spans

#: Largest share of a text's word characters that may stand in n-grams that repeat an earlier one, by n-gram length. A sentence of 12 words said twice in a text of 84 stays under it; 30 words said three times among 300 others do not.
GRAM_LIMITS = dict.fromkeys(range(5, 11), 0.15)
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_gram_chars array<long>, base_failed boolean, kept boolean"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(words: np.ndarray, doc: np.ndarray, salt: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Marks words inside an n-word window that its text has twice or more, in the first such window too if `first`."""
    h, at = gram_hashes(words, doc, n)
    edge = np.zeros(len(words) + 1, np.int32)
    if len(h):
        keys = mix(h ^ salt[doc[at]])
        rows = np.flatnonzero(_repeated(keys))
        if not first and len(rows):
            rows = np.delete(rows, np.unique(keys[rows], return_index=True)[1])
        again = at[rows]
        np.add.at(edge, again, 1)
        np.add.at(edge, again + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: Sequence[int]) -> dict[str, np.ndarray]:
    """Counts for each text of a slice."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    salt = mix(np.arange(1, n + 1, dtype=U) * U(0xD6E8FEB86659FD93))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    words = span_hashes(data, starts, ends)
    out = {"n_words": per_text(np.ones(len(doc), np.int64), doc, n), "word_chars": per_text(chars, doc, n)}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    at = np.flatnonzero(symbol[data]) if len(data) else np.zeros(0, np.int64)
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n)
    # lines end at \n and at the end of their text
    breaks = np.flatnonzero(data == 10) if len(data) else np.zeros(0, np.int64)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[owner + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, owner = line_start[has_word], line_end[has_word], owner[has_word]
    keys = mix(span_hashes(data, line_start, line_end) ^ salt[owner]) if len(owner) else np.zeros(0, U)
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    out["n_dup_lines"] = per_text(later.astype(np.int64), owner, n)
    word_points = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=word_points[1:])
    in_line = word_points[np.searchsorted(starts, line_end)] - word_points[np.searchsorted(starts, line_start)]
    out["dup_line_chars"] = per_text(in_line * later, owner, n)
    out["n_repeat_words"] = per_text(_covered(words, doc, salt, 3, True).astype(np.int64), doc, n)
    grams = [per_text(chars * _covered(words, doc, salt, k, False), doc, n) for k in lengths]
    out["dup_gram_chars"] = np.stack(grams, axis=1) if grams else np.zeros((n, 0), np.int64)
    return out


def repetition(docs: DataFrame, text: str = "text", gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """docs without the text, with repetition counts, base_failed and the verdict kept.

    A null or empty text has counts of 0 and fails for having under 50 words. Rows are independent: repeated rows
    get equal results, an empty table gives an empty one, and columns of the input win no clash: those named as an
    output are replaced.
    """
    limits = gram_limits or GRAM_LIMITS
    lengths = sorted(limits)
    names = [part.rsplit(" ", 1)[0] for part in SCHEMA.split(", ")]
    carried = [c for c in docs.columns if c != text and c not in names]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, text):
            m = measure(data, offsets, lengths)
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            total = np.maximum(m["word_chars"], 1)
            good = m["dup_line_chars"] <= line_limit * total
            for k, n in enumerate(lengths):
                good &= m["dup_gram_chars"][:, k] <= limits[n] * total
            grams = m.pop("dup_gram_chars")
            columns = [part.column(part.schema.get_field_index(c)) for c in carried]
            columns += [pa.array(m[c], pa.int64()) for c in names[:6]]
            columns += [pa.ListArray.from_arrays(np.arange(0, grams.size + 1, max(len(lengths), 1), dtype=np.int32)[: len(grams) + 1], pa.array(grams.ravel(), pa.int64()))]
            columns += [pa.array(failed), pa.array(good & ~failed)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *names])

    return docs.select(*carried, text).mapInArrow(run, schema)
