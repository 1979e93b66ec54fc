"""Quality classifier: supervised subword embeddings, averaged per text, with a softmax on top.

Words and character n-grams are hashed to buckets; every bucket has a learned vector. So have pairs of words by how far
back in their text each stood last, whatever the words: text that goes round in circles is told by these. A text is
the mean of its buckets' vectors, each kind of bucket with an equal share. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts. The output is linear in the mean, so for scoring the layers fold into one number per bucket and class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import LONGEST, needed, sampled
from braidwork.llm.kernels import U, Rolling, blocks, word_spans

BITS = 17
GRAMS = (3, 5)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' words and n-grams in a row, ordered by text, each one's share of its text, and where each text's begin and end."""
    starts, ends, doc = word_spans(data, offsets)
    rolling = Rolling(data)
    n = len(offsets) - 1
    words = rolling.spans(starts, ends)
    found, owners = [words, recency_pairs(words, doc) * U(0xD6E8FEB86659FD93)], [doc, doc]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for g in GRAMS:
        if len(data) >= g:
            at = np.flatnonzero(owner[: len(data) - g + 1] == owner[g - 1 :])
            found.append((rolling.sums[at + g] - rolling.sums[at]) * rolling.down[at] * U(0xD6E8FEB86659FD93))
            owners.append(owner[at])
    # every kind is in text order already: each goes to its place behind the kinds before it
    counts = np.array([np.bincount(o, minlength=n) for o in owners])
    edges = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out, share = np.zeros(edges[-1], np.int32), np.zeros(edges[-1], np.float32)
    part = (1 / np.maximum(counts, 1) / np.maximum((counts > 0).sum(axis=0), 1)).astype(np.float32)
    ahead = np.zeros(n, np.int64)
    for k, (h, o) in enumerate(zip(found, owners, strict=True)):
        salt = U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        rank = np.arange(len(o)) - np.repeat(np.cumsum(counts[k]) - counts[k], counts[k])
        place = edges[o] + ahead[o] + rank
        out[place], share[place] = ((h ^ salt) >> U(64 - BITS)).astype(np.int32), part[k][o]
        ahead += counts[k]
    return out, share, edges


def recency_pairs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of every word and the one before it, the number of bits of the distance to where the word stood last in its text: 0 where it is new, 10 at most."""
    order = np.lexsort((words, doc))
    same = (words[order][1:] == words[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    back = np.zeros(len(words), np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    level = np.minimum(np.frexp(back.astype(np.float64))[1], 10)
    before = np.concatenate([level[:1] * 0, level[:-1]])
    before[1:][doc[1:] != doc[:-1]] = 11
    return (16 * level + before + 1).astype(U)


@dataclass
class Model:
    """weights: per bucket and class; bias: per class; classes: the learned labels."""

    weights: np.ndarray
    bias: np.ndarray
    classes: list

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Softmax for every text; a text without features gets the bias alone. No column where nothing was learned."""
        if not self.classes:
            return np.zeros((len(offsets) - 1, 0))
        at, share, edges = buckets(data, offsets)
        sums = np.concatenate([np.zeros((1, len(self.bias))), np.cumsum(self.weights[at] * share[:, None], axis=0, dtype=np.float64)])
        z = sums[edges[1:]] - sums[edges[:-1]] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list, dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent with per-coordinate step sizes, one text a step, in a seeded order."""
    classes = sorted(set(labels))
    target = np.array([classes.index(y) for y in labels])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    seen, seen_out, seen_bias = np.full(1 << BITS, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    docs = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        found, share, _ = buckets(raw, np.array([0, len(raw)]))
        at, which = np.unique(found, return_inverse=True)
        docs.append((at, np.bincount(which, weights=share, minlength=len(at)).astype(np.float32)))
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            at, share = docs[d]
            rows = vectors[at]
            hidden = share @ rows
            z = hidden @ out + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[target[d]] -= 1
            back = out @ error
            g = np.outer(hidden, error)
            seen_out += g * g
            seen_bias += error * error
            # the vectors' steps: the mean passes a share of the error to each bucket
            seen[at] += share * share * float(back @ back)
            vectors[at] = rows - (rate * share / np.sqrt(seen[at]))[:, None] * back
            out -= rate * g / np.sqrt(seen_out)
            bias -= rate * error / np.sqrt(seen_bias)
    return Model((vectors @ out).astype(np.float32), bias, classes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> pa.Table:
    """About `most` labelled rows (text, label), by a hash of the key, and never more than twice as many; rows without a label or text, and texts of over LONGEST characters, are not used. Without any the sample is empty."""
    labels = labels.filter(F.col(label).isNotNull()).select(key, label)
    n = labels.count()
    chosen = labels.filter(sampled(F.col(key), "sample", F.lit(min(1.0, most / max(n, 1)))))
    chosen = needed(chosen, "labels")
    rows = docs.select(key, text).filter(F.col(text).isNotNull() & (F.length(text) <= LONGEST)).join(chosen, key)
    return rows.orderBy(key, F.xxhash64(text), label).limit(2 * most).select(text, label).toArrow()


def score(docs: DataFrame, model: Model, positive, text: str = "text", name: str = "score") -> DataFrame:
    """docs without the text, with the probability of the positive class.

    Whole texts are scored, however long. Null texts count as empty; rows are independent, repeated ones alike; a model
    that never saw the positive class, or learned nothing, gives 0. An empty table gives an empty one. A column already
    called `name` is replaced.
    """
    carried = [c for c in docs.columns if c not in (text, name)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"{name} double"])
    place = model.classes.index(positive) if positive in model.classes else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches, text, 1 << 20):
            p = model.probabilities(data, offsets)
            value = p[:, place] if place >= 0 else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in carried], pa.array(value)], names=[*carried, name])

    return docs.select(*carried, text).mapInArrow(run, schema)
