"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features, hashed to buckets; a learned transition table links
neighbours. Forward-backward gives each word's distribution over languages, so code-switched text is labelled word
by word; a text gets the language with the largest mean. Long texts are cut into chunks whose transfer matrices are
combined exactly, so that no recursion runs word by word over a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.common import LONGEST, sampled
from braidwork.llm.kernels import U, Rolling, blocks, release, word_spans

BITS = 17
CHUNK = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@dataclass
class Words:
    """Words of many texts: features of word w are items[edges[w]:edges[w + 1]] with their weights; owner is the text."""

    items: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters, lower-cased, with their features."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    blank = np.where(_letters()[codes], np.uint8(65), np.uint8(32)) if len(codes) else np.zeros(0, np.uint8)
    start, end, owner = word_spans(blank, offsets)
    rolling = Rolling(codes)
    n, size = len(start), end - start
    kinds = [(np.arange(n), rolling.spans(start, end), np.ones(n))]
    for k in (1, 2, 3):
        at = np.flatnonzero(size >= k)
        kinds.append((at, rolling.spans(start[at], start[at] + k), np.ones(len(at))))
        kinds.append((at, rolling.spans(end[at] - k, end[at]), np.ones(len(at))))
    for k in (2, 3):
        per = np.maximum(size - k + 1, 0)
        word = np.repeat(np.arange(n), per)
        at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
        kinds.append((word, rolling.spans(at, at + k), 2.0 / per[word]))
    counts = np.array([np.bincount(w, minlength=n) for w, _, _ in kinds])
    edges = np.concatenate([[0], np.cumsum(counts.sum(axis=0))]).astype(np.int64)
    items, weights, ahead = np.zeros(edges[-1], np.int32), np.zeros(edges[-1], np.float32), np.zeros(n, np.int64)
    for kind, (word, h, weight) in enumerate(kinds):
        place = edges[word] + ahead[word] + np.arange(len(word)) - np.repeat(np.cumsum(counts[kind]) - counts[kind], counts[kind])
        items[place] = ((h * U(2 * kind + 1 | 0x9E3779B97F4A7C00)) >> U(64 - BITS)).astype(np.int32)
        weights[place] = weight
        ahead += counts[kind]
    return Words(items, weights, edges, owner, start, end)


def _in_parts(texts: list[str], most: int = 100_000) -> Words:
    """words_of for many texts, made of parts of about `most` characters: what is needed besides the result stays small."""
    parts, at = [], 0
    while at < len(texts) or not parts:
        to, size = at + 1, 0
        while to < len(texts) and size < most:
            size += len(texts[to])
            to += 1
        w = words_of(texts[at:to])
        parts.append(Words(w.items, w.weights, np.diff(w.edges), w.owner + at, w.starts, w.ends))
        at = to
    joined = {f: np.concatenate([getattr(p, f) for p in parts]) for f in ("items", "weights", "edges", "owner", "starts", "ends")}
    return Words(**joined | {"edges": np.concatenate([[0], np.cumsum(joined["edges"])])})


def _normal(x: np.ndarray, axes: int = 1) -> np.ndarray:
    return x / x.sum(axis=tuple(range(x.ndim - axes, x.ndim)), keepdims=True)


@dataclass
class Tagger:
    """weights: score per bucket and language; moves: score of a language after another."""

    weights: np.ndarray
    moves: np.ndarray
    languages: list[str]

    def scores(self, words: Words) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.weights[words.items] * words.weights[:, None], axis=0, dtype=np.float64)])
        return sums[words.edges[1:]] - sums[words.edges[:-1]]

    def marginals(self, words: Words, n: int) -> np.ndarray:
        """Each word's distribution over languages, by forward-backward over its whole text."""
        z = self.scores(words)
        total, L = len(z), len(self.languages)
        if not total:
            return z
        emit, move = np.exp(z - z.max(axis=1, keepdims=True)), np.exp(self.moves)
        sizes = np.bincount(words.owner, minlength=n)
        per = -(-sizes // CHUNK)
        first = np.cumsum(per) - per
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chunk, k = first[words.owner] + within // CHUNK, within % CHUNK
        C = int(per.sum())
        cells, real = np.ones((CHUNK, C, L)), np.zeros((CHUNK, C), bool)
        cells[k, chunk], real[k, chunk] = emit, True
        # what each chunk does to a distribution before it
        through = np.broadcast_to(np.eye(L), (C, L, L)).copy()
        for t in range(CHUNK):
            live = np.flatnonzero(real[t])
            through[live] = _normal((through[live] @ move) * cells[t, live, None, :], 2)
        before, after = np.full((C, L), 1 / L), np.full((C, L), 1 / L)
        for j in range(1, int(per.max())):
            at = first[per > j] + j
            before[at] = _normal((before[at - 1, None, :] @ through[at - 1])[:, 0])
        for j in range(int(per.max()) - 2, -1, -1):
            at = first[per > j + 1] + j
            after[at] = _normal((through[at + 1] @ after[at + 1, :, None])[:, :, 0])
        ahead = np.zeros((CHUNK, C, L))
        a = before
        for t in range(CHUNK):
            live = real[t][:, None]
            a = np.where(live, _normal((a @ move) * cells[t]), a)
            ahead[t] = a
        b = after
        for t in range(CHUNK - 1, -1, -1):
            ahead[t] *= b
            b = np.where(real[t][:, None], _normal((cells[t] * b) @ move.T), b)
        return _normal(ahead[k, chunk])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and mean probability of every text."""
        words = words_of(texts)
        p = self.marginals(words, len(texts))
        sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        edges = np.searchsorted(words.owner, np.arange(len(texts) + 1))
        n = np.diff(edges)
        mean = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        score = np.where(n > 0, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist(), strict=True)], score


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.5, length: int = 64, batch: int = 64, seed: int = 5) -> Tagger:
    """Stochastic gradient ascent on the likelihood of code-switched sequences: seeded stretches of the texts' words, put together across languages."""
    languages = sorted(set(labels))
    L, rng = len(languages), np.random.default_rng(seed)
    weights, moves = np.zeros((1 << BITS, L), np.float32), np.zeros((L, L))
    if L < 2:
        return Tagger(weights, moves, languages)
    words = _in_parts(texts)
    release()
    truth = np.array([languages.index(y) for y in labels])[words.owner]
    # stretches of 8 to 40 words in a random order
    cuts = np.unique(np.concatenate([[0, len(truth)], np.cumsum(rng.integers(8, 41, max(1, len(truth) // 8)))]))
    cuts = cuts[cuts <= len(truth)]
    order = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in rng.permutation(len(cuts) - 1)])
    order = order[: len(order) // length * length].reshape(-1, length)
    seen, seen_moves = np.full((1 << BITS, L), 1e-6, np.float32), np.full((L, L), 1e-6)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(order)), max(1, len(order) // batch)):
            w = order[rows].T  # place, sequence
            y = truth[w]
            size = words.edges[w.ravel() + 1] - words.edges[w.ravel()]
            owner = np.repeat(np.arange(w.size), size)
            at = words.edges[w.ravel()][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            items, share = words.items[at], words.weights[at]
            z = np.zeros((w.size, L))
            for l in range(L):
                z[:, l] = np.bincount(owner, weights=weights[items, l] * share, minlength=w.size)
            z = z.reshape(*w.shape, L)
            emit, move = np.exp(z - z.max(axis=2, keepdims=True)), np.exp(moves)
            f = np.zeros_like(emit)
            a = np.full((w.shape[1], L), 1 / L)
            for t in range(length):
                a = _normal((a @ move) * emit[t])
                f[t] = a
            pairs, p = np.zeros((L, L)), np.zeros_like(f)
            b = np.full((w.shape[1], L), 1 / L)
            for t in range(length - 1, -1, -1):
                p[t] = _normal(f[t] * b)
                if t:
                    pairs += _normal(f[t - 1][:, :, None] * move * (emit[t] * b)[:, None, :], 2).sum(axis=0)
                b = _normal((emit[t] * b) @ move.T)
            p[np.arange(length)[:, None], np.arange(w.shape[1]), y] -= 1
            g = p.reshape(-1, L)
            step = np.stack([np.bincount(items, weights=g[owner, l] * share, minlength=1 << BITS) for l in range(L)], axis=1) / len(rows)
            seen += (step * step).astype(np.float32)
            weights -= (rate * step / np.sqrt(seen)).astype(np.float32)
            np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
            pairs /= len(rows)
            seen_moves += pairs * pairs
            moves -= 0.1 * pairs / np.sqrt(seen_moves)
    return Tagger(weights, moves, languages)


def language_sample(docs: DataFrame, most: int = 150, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of about `most` rows of each language, by a hash of the key, and never more than twice as many.

    Every language of the table has rows in it, however large it is. Rows that share a key, or have none, are taken or
    left together, the smallest texts by hash of those that are too many. Texts of over LONGEST characters are left out.
    An empty table gives empty lists.
    """
    held = docs.filter(F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in held.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, most / n))]), F.col(lang))
    chosen = held.filter(sampled(F.col(key), "language", share) & F.col(text).isNotNull() & (F.length(text) <= LONGEST))
    w = Window.partitionBy(lang).orderBy(F.xxhash64(key), F.xxhash64(text))
    chosen = chosen.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * most)
    rows = chosen.orderBy(key, F.xxhash64(text)).select(text, lang).toArrow()
    return rows.column(0).to_pylist(), rows.column(1).to_pylist()


def identify(docs: DataFrame, tagger: Tagger, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """docs with the predicted language and its mean probability; the text goes unless keep_text.

    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned. Rows
    are independent, repeated ones alike; of languages with one probability the first in code-point order wins. Texts
    of any length are read whole; an empty table gives an empty one. Columns named as an output are replaced.
    """
    carried = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [f"{names[0]} string", f"{names[1]} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in blocks(batches, text, 1 << 17):
            texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            found, score = tagger.predict(texts) if tagger.languages else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in carried], pa.array(found, pa.string()), pa.array(score)], names=[*carried, *names])

    return docs.select(*dict.fromkeys([*carried, text])).mapInArrow(run, schema)
