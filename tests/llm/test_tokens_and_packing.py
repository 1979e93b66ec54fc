import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwork.llm import packing, tokens
from braidwork.llm.registry import tokenizer_path

TEXTS = [None, "", " ", "  ", " a", "a  b", "a \n b", "a\n\n b  ", "x<|endoftext|>y z", "it's  'll  \t'we", "\xa0a \xa0b", "tab\t tab \t x", "a\x1c b \x1cc", "é ñ  ß '​ x ​q", "12 345  6", "'s 's  's", "a᠎ ᠎b", "a \x85b", " \x0bq", "　 x 　y", "end.\nThe next, one!\n\nit'stop", "word " * 3000, "one", "one"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "lost", "y"), (3, "again", "z")], "doc_id long, text string, ids string").repartition(3)


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@example(["\n\nT", "a\n\nT", "\nT", "a\nT", "a \nT.\n\n b"])
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sT.,;\n\t  \xa0é😀1-")), max_size=30), min_size=1, max_size=5))
def test_units_give_the_library_ids(texts):
    e = tokens.encoder(tokenizer_path())
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, sizes = e.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(e.tokenizer, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.just(0)), max_size=1500))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    assert (tokens.unpack_ids(tokens.pack_ids(ids)) == ids).all()


def test_token_files(spark, docs, tokenizer, tmp_path):
    tokens.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), 2)
    rows = tokens.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(rows) == docs.count()
    keys = [r.doc_id for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    at = 0
    by_id = {i * 3: t for i, t in enumerate(TEXTS)}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2
        if r.doc_id not in (None, 3):
            assert ids[:-1] == plain(tokenizer, by_id[r.doc_id])
        at += len(ids)
    with pytest.raises(ValueError):
        tokens.unpack_ids(b"nope")


def test_packing(spark, docs, tokenizer):
    capacity = 100
    pieces = tokens.token_pieces(docs, tokenizer_path(), capacity, 0).withColumn("crc", F.crc32("ids"))
    rows = packing.pack(pieces, capacity).collect()
    assert len(rows) == pieces.count()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.crc and len(r.ids) == 4 * r.length
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 3 * 21)
    assert all(length == capacity for _, length in long[1:]) and long[0][1] == (3001 % capacity or capacity) or long
    whole = sum(r.length for r in rows)
    assert len(held) <= -(-whole // capacity) + 1
    assert packing.pack(pieces.limit(0), capacity).count() == 0


def test_one_length_of_most_rows_is_spread(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 60).otherwise(40).cast("long").alias("length"))
    got = packing.pack(rows, 100)
    assert got.select("sequence_id").distinct().count() == 1500
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 100").isEmpty()
    with pytest.raises(ValueError):
        packing.pack(rows.withColumn("length", F.lit(101)), 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 40)), min_size=1, max_size=12))
def test_solver_places_everything(pairs):
    demand = np.zeros(51, np.int64)
    for length, n in pairs:
        demand[length] += n
    used = packing.solve(demand, 50)
    placed = Counter()
    for config, n in used.items():
        assert sum(config) <= 50 and n > 0
        for length in config:
            placed[length] += n
    assert all(placed[length] == demand[length] for length in range(51))
    least = -(-int((demand * np.arange(51)).sum()) // 50)
    assert least <= sum(used.values()) <= sum(packing._best_fit(demand, 50).values())
