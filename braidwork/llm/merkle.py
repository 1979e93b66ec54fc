"""A Merkle manifest of a table: leaves by row, a tree for each language, one root, and a proof for every row.

Blocks of eight to some power of consecutive leaves are reduced where they lie, each in one task. Their roots are
reduced again in the same way until no more are left than the driver may hold; it builds the small top tree and sends
every block the path from its root to the root of all. The executors finish the proofs: the siblings inside the block,
then the path that came from above, and fold every row from its leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from braidwork.llm.common import SMALL, written

#: Nodes of a run.
FAN = 8
#: Levels that a block reduces: 4,096 leaves.
LEVELS = 4
#: Block roots that the driver holds at most; a path is at most 8 kB, ten levels and ten over languages.
TOP = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"

#: A node's way up: for each level what its run holds before it and after it.
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def runs_up(nodes: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """The nodes one level up, and what stands before and after each node in its run."""
    up, beside = [], []
    for at in range(0, len(nodes), FAN):
        run = "".join(nodes[at : at + FAN])
        up.append(digest(run))
        beside.extend((run[:k], run[k + 64 :]) for k in range(0, len(run), 64))
    return up, beside


def climb(nodes: list[str], most: int | None = None, alone: bool = True) -> tuple[list[str], list[Path]]:
    """The nodes after `most` levels, or at the single one if they are alone in their tree, and every node's path there."""
    paths: list[Path] = [[] for _ in nodes]
    width, level = 1, 0
    while (len(nodes) > 1 or not alone) and (most is None or level < most):
        nodes, beside = runs_up(nodes)
        for i, path in enumerate(paths):
            path.append(beside[i // width])
        width, level = width * FAN, level + 1
    return nodes, paths


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in their tree, and n, how many rows the tree has, from one sort by ranges.

    Rows of a partition are numbered where they lie; how many of a tree lie in the partitions before is a table of one
    row per partition and tree. The number a row had when it was read comes last in the order, so equal rows are no hot key.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(F.asc_nulls_first(tree), *order, "_row").sortWithinPartitions(F.asc_nulls_first(tree), *order, "_row").drop("_row")
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sorted")
    parts = rows.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(tree, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(Window.partitionBy(tree)).alias("n")), "parts")
    joined = rows.withColumnRenamed(tree, "_t").join(_few(parts), F.col("_t").eqNullSafe(F.col(tree)) & (rows["_part"] == parts["_part"]))
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_t", "_part", "_at", "_shift")


def _few(rows: DataFrame) -> DataFrame:
    """The side of a join that is broadcast if its counted values are few."""
    return F.broadcast(rows) if rows.count() * len(rows.columns) <= SMALL else rows


def blocks(rows: DataFrame, levels: int) -> DataFrame:
    """rows (tree, pos, n, node, ...) gathered by block, in order: one row per block with its root and its rows."""
    kept = [c for c in rows.columns if c not in ("tree", "pos", "n")]
    size = FAN**levels
    block = rows.withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *kept))).alias("rows"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("rows").flatten().field("node").to_pylist()
            sizes = batch.column("rows").value_lengths().to_pylist()
            roots, at = [], 0
            for n, of in zip(batch.column("n").to_pylist(), sizes, strict=True):
                roots.append(climb(nodes[at : at + of], levels, alone=n <= size)[0][0])
                at += of
            yield batch.append_column("root", pa.array(roots, pa.string()))

    return written(block.mapInArrow(reduce, StructType([*block.schema.fields, StructField("root", StringType())])), "blocks")


def _top(nodes: list[tuple[str | None, int, str]]) -> tuple[str | None, dict[tuple[str | None, int], tuple[str, Path]]]:
    """From the nodes (tree, pos, node) that are left: the root of all, and for each its tree's root and its path to the root of all."""
    trees: dict[str | None, list[tuple[int, str]]] = {}
    for tree, pos, node in nodes:
        trees.setdefault(tree, []).append((pos, node))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inside = {tree: climb([node for _, node in sorted(trees[tree])]) for tree in order}
    root, across = climb([inside[tree][0][0] for tree in order])
    found = {}
    for tree, over in zip(order, across, strict=True):
        for (pos, _), path in zip(sorted(trees[tree]), inside[tree][1], strict=True):
            found[tree, pos] = (inside[tree][0][0], path + over)
    return (root[0] if root else None), found


def _paths(nodes: DataFrame, levels: int, top: int) -> DataFrame:
    """nodes (tree, pos, n, node), the n of a tree being its nodes -> tree, block (the node's pos), subroot, path, root of all.

    At most `top` nodes go to the driver, and their paths of at most 8 kB come back as a broadcast; the paths of more
    nodes are a written table, which the planner joins by its size.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    if count <= top:
        root, found = _top([(r.tree, r.pos, r.node) for r in nodes.collect()])
        rows = [(tree, pos, subroot, [{"before": b, "after": a} for b, a in path], root) for (tree, pos), (subroot, path) in found.items()]
        return F.broadcast(spark.createDataFrame(rows, f"tree string, block long, subroot string, path {PATH}, root string"))
    if nodes.filter("n > 1").isEmpty():  # more trees than the driver may hold: one tree over their roots
        trees = placed(nodes.select(F.lit("").alias("all"), F.col("tree").alias("of"), "node"), "all", [F.asc_nulls_first("of")])
        trees = trees.select(F.lit("").alias("tree"), "pos", "n", "node", F.col("of"))
        above = _paths_of(trees, levels, top)
        return above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "path", F.col("subroot").alias("root"))
    return _paths_of(nodes, levels, top).select("tree", F.col("pos").alias("block"), "subroot", "path", "root")


def _paths_of(nodes: DataFrame, levels: int, top: int) -> DataFrame:
    """nodes with the path of each: in its block, then from the block's root on."""
    reduced = blocks(nodes, levels)
    return written(_explained(reduced, _above(reduced, levels, top), levels, nodes, _finish_path), "paths")


def _above(reduced: DataFrame, levels: int, top: int) -> DataFrame:
    size = FAN**levels
    return _paths(reduced.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("node")), levels, top)


def _explained(reduced: DataFrame, above: DataFrame, levels: int, rows: DataFrame, finish) -> DataFrame:
    """Every row of the blocks, with what finish makes of its path to the root of all; above: the blocks' own paths."""
    size = FAN**levels
    above = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "subroot", F.col("path").alias("_path"), F.col("root").alias("_root"))
    joined = reduced.withColumnRenamed("root", "_own").join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    kept = [c for c in rows.columns if c not in ("tree", "pos", "n")]
    extra, made = finish

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                inner = one.column("rows").flatten()
                nodes, n = inner.field("node").to_pylist(), one.column("n")[0].as_py()
                own = climb(nodes, levels, alone=n <= size)[1]
                up = [(p["before"], p["after"]) for p in one.column("_path")[0].as_py()]
                subroot, root = one.column("subroot")[0].as_py(), one.column("_root")[0].as_py()
                base = {"tree": pa.array([one.column("tree")[0].as_py()] * len(nodes), pa.string()), "pos": inner.field("pos"), "n": pa.array([n] * len(nodes), pa.int64())}
                base |= {c: inner.field(c) for c in kept}
                base |= {"subroot": pa.array([subroot] * len(nodes), pa.string()), "root": pa.array([root] * len(nodes), pa.string())}
                yield pa.RecordBatch.from_pydict(base | made(inner, nodes, [p + up for p in own], root))

    kinds = dict(rows.dtypes)
    schema = ", ".join(["tree string", "pos long", "n long", *[f"`{c}` {kinds[c]}" for c in kept], "subroot string", "root string", extra])
    return joined.mapInArrow(run, schema)


def _keep_path(inner: pa.StructArray, nodes: list[str], paths: list[Path], root: str) -> dict[str, pa.Array]:
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return {"path": pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], kind)}


def _prove(inner: pa.StructArray, nodes: list[str], paths: list[Path], root: str) -> dict[str, pa.Array]:
    """The digest of every row's siblings from bottom to top, and the root that the claimed leaf leads to over them."""
    proofs, folded = [], []
    for claimed, path in zip(inner.field("claimed").to_pylist(), paths, strict=True):
        proofs.append(digest("".join(b + a for b, a in path)))
        for before, after in path:
            claimed = digest(before + claimed + after)
        folded.append(claimed)
    return {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())}


_finish_path = (f"path {PATH}", _keep_path)
_finish_proof = ("proof_sha256 string, folded_root string", _prove)


def manifest(leaves: DataFrame, key: str = "doc_id", tree: str = "lang", levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """leaves (key, tree, leaf, claimed) -> key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by key in each tree, a null key first; of rows that share a key the smaller leaf is first, so the
    root does not depend on how rows were read. Equal rows are leaves of their own. Roots of trees are in order of the
    tree's name, null first. claimed is the leaf that a reader holds: verified tells whether it leads to the root over
    the siblings. A single leaf is its tree's root, a single tree's root the root of all, and an empty table has none
    and gives an empty one. Leaves are digests, so texts of any length count alike. Further columns are left out.
    """
    rows = leaves.select(F.col(key).alias("key"), F.col(tree).cast("string").alias("tree"), F.col("leaf").alias("node"), "claimed")
    rows = placed(written(rows, "leaves"), "tree", [F.asc_nulls_first("key"), F.asc("node")])
    rows = rows.select("tree", "pos", "n", "node", "key", "claimed")
    reduced = blocks(rows, levels)
    proved = _explained(reduced, _above(reduced, levels, top), levels, rows, _finish_proof)
    return proved.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf of doc_id, source, lang, n_chars and text, and claimed: the leaf with the text's A-Z lower-cased where tampered holds."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.translate("text", UPPER, LOWER)
    original = leaf([*rest, F.col("text")])
    claimed = F.when(F.coalesce(tampered, F.lit(False)) & (changed != F.col("text")), leaf([*rest, changed])).otherwise(F.col("leaf"))
    return docs.withColumn("leaf", original).select("doc_id", "lang", "leaf", claimed.alias("claimed"))


#: Levels of the trees that the SQL writes out: enough for 8 ** 9 leaves.
_SQL_LEVELS = 9


def oracle() -> str:
    """DuckDB SQL of the query over `documents`: the tree level by level over whole tables, a window for the places."""
    text = "CAST({0} AS VARCHAR)"
    part = lambda c: f"coalesce(CAST(strlen({text.format(c)}) AS VARCHAR) || ':' || {text.format(c)}, '-')"
    joined = lambda last: "sha256(" + " || ".join([*[part(c) for c in ("doc_id", "source", "lang", "n_chars")], part(last)]) + ")"
    # crc32 of the id's digits, bit by bit
    crc = "xor(list_reduce(list_transform(range(len(s) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(s, i, 1)) END::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, o: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, lang, {joined('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {joined(f'''translate(text, '{UPPER}', '{LOWER}')''')} ELSE {joined('text')} END AS claimed FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents))",
        "r0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, claimed AS fold, '' AS sib FROM d)",
        "n0 AS MATERIALIZED (SELECT lang, pos, leaf AS h FROM r0)",
    ]
    for k in range(_SQL_LEVELS):
        steps += [
            f"g{k} AS MATERIALIZED (SELECT lang, pos // {FAN} AS up, string_agg(h, '' ORDER BY pos) AS run, first(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM n{k}) GROUP BY 1, 2)",
            f"n{k + 1} AS MATERIALIZED (SELECT lang, up AS pos, CASE WHEN c > 1 THEN sha256(run) ELSE run END AS h FROM g{k})",
            f"r{k + 1} AS MATERIALIZED (SELECT r.doc_id, r.lang, r.leaf, r.pos // {FAN} AS pos, CASE WHEN c > 1 THEN sha256(substr(run, 1, 64 * (r.pos % {FAN})) || fold || substr(run, 64 * (r.pos % {FAN}) + 65)) ELSE fold END AS fold, CASE WHEN c > 1 THEN sib || substr(run, 1, 64 * (r.pos % {FAN})) || substr(run, 64 * (r.pos % {FAN}) + 65) ELSE sib END AS sib FROM r{k} r JOIN g{k} g ON g.lang IS NOT DISTINCT FROM r.lang AND g.up = r.pos // {FAN})",
        ]
    # the same over the roots of the languages, as one tree
    steps += [
        f"s AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM n{_SQL_LEVELS})",
        f"t0 AS MATERIALIZED (SELECT r.doc_id, r.leaf, s.subroot, s.place AS pos, r.fold, r.sib FROM r{_SQL_LEVELS} r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang)",
        "m0 AS MATERIALIZED (SELECT place AS pos, subroot AS h FROM s)",
    ]
    for k in range(3):
        steps += [
            f"e{k} AS MATERIALIZED (SELECT pos // {FAN} AS up, string_agg(h, '' ORDER BY pos) AS run, first(c) AS c FROM (SELECT *, count(*) OVER () AS c FROM m{k}) GROUP BY 1)",
            f"m{k + 1} AS MATERIALIZED (SELECT up AS pos, CASE WHEN c > 1 THEN sha256(run) ELSE run END AS h FROM e{k})",
            f"t{k + 1} AS MATERIALIZED (SELECT t.doc_id, t.leaf, t.subroot, t.pos // {FAN} AS pos, CASE WHEN c > 1 THEN sha256(substr(run, 1, 64 * (t.pos % {FAN})) || fold || substr(run, 64 * (t.pos % {FAN}) + 65)) ELSE fold END AS fold, CASE WHEN c > 1 THEN sib || substr(run, 1, 64 * (t.pos % {FAN})) || substr(run, 64 * (t.pos % {FAN}) + 65) ELSE sib END AS sib FROM t{k} t JOIN e{k} e ON e.up = t.pos // {FAN})",
        ]
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM t3, m3"
