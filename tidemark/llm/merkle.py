"""Merkle manifest of a dataset with proofs by octopus multiproofs.

Every key value has a tree of its own over its rows in order; the roots of these trees are the leaves of one more
tree. While a level has several nodes, each ``ARITY`` consecutive ones (fewer at the end) become their hash.

Rows get their places by range partitioning, so a key of any size is cut to ranges. Nodes are hashed in blocks of
``ARITY ** LEVELS`` consecutive ones, which gives that many levels at once; the blocks' top nodes are dealt to blocks
again. For proofs, each block of leaves computes which nodes it lacks: the siblings on the paths of all its leaves
that neither are its leaves nor can be derived from them. These are fetched once per block, whatever
the number of its leaves; shared inner nodes are derived in the block and every leaf's proof is expanded there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import in_batches
from tidemark.session import materialize

ARITY = 3
LEVELS = 7


class Manifest(NamedTuple):
    """``leaves``: tree, idx, n (leaves of the tree), doc_id, leaf and what was passed on; ``nodes``: tree, level, idx,
    node (leaves are level 0); ``trees``: tree, n, subroot, at (the tree's place among all); ``root``: one hash, none for an empty table; ``above``: nodes
    of the tree over the trees (level, idx, node) and ``n_trees``."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    above: DataFrame
    n_trees: int
    root: str | None


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Number of nodes of each level, from the leaves to the root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def missing_nodes(known: np.ndarray, sizes: list[int], arity: int = ARITY) -> list[tuple[int, np.ndarray]]:
    """The least set of nodes, by level, that together with the leaves ``known`` (sorted) gives the root."""
    out = []
    for level, size in enumerate(sizes[:-1]):
        parents = np.unique(known // arity)
        children = (parents[:, None] * arity + np.arange(arity)).ravel()
        out.append((level, np.setdiff1d(children[children < size], known, assume_unique=True)))
        known = parents
    return out


def run_of(idx: int, size: int, arity: int = ARITY) -> range:
    first = idx - idx % arity
    return range(first, min(first + arity, size))


def derive(nodes: dict[tuple[int, int], str], leaves: list[int], sizes: list[int], arity: int = ARITY) -> str:
    """Adds to ``nodes`` all nodes above ``leaves``; every level's siblings must be there. Returns the root."""
    known = leaves
    for level, size in enumerate(sizes[:-1]):
        parents = sorted({i // arity for i in known})
        for parent in parents:
            nodes[level + 1, parent] = digest([nodes[level, i] for i in run_of(parent * arity, size, arity)])
        known = parents
    return nodes[len(sizes) - 1, 0]


def path(nodes: dict[tuple[int, int], str], idx: int, sizes: list[int], memo: dict, arity: int = ARITY) -> list[dict]:
    """Siblings to the left and right of each node on the way from leaf ``idx`` to the root."""
    steps, at = [], idx
    for level, size in enumerate(sizes[:-1]):
        if (level, at) not in memo:
            run = run_of(at, size, arity)
            memo[level, at] = {"left": "".join([nodes[level, i] for i in run if i < at]),
                               "right": "".join([nodes[level, i] for i in run if i > at])}
        steps.append(memo[level, at])
        at //= arity
    return steps


def encoded(column: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[str | Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def tree_name(column: str) -> Column:
    """A key that is never null and orders null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place in its tree within the task; rows come in order."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in in_batches(batches):
        places = []
        for tree in batch.column("tree").to_pylist():
            if tree != last:
                last, count = tree, 0
            places.append(count)
            count += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int64()), pa.array(places, pa.int64())],
            [*batch.schema.names, "part", "place"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within ``tree`` by ``order``, and ``n``, the rows of the tree."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialize(ranged.mapInArrow(_number, schema), "places")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part")) - F.col("rows")
    counts = counts.select("tree", "part", before.alias("before"), F.sum("rows").over(tree).alias("n"))
    return ranged.join(counts, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("place")).drop(
        "part", "place", "before")


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in ``names``, which come one after the other."""
    held, last = [], None
    for batch in in_batches(batches):
        keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if held and last != keys[first]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(first, i - first))
                last, first = keys[first], i
    if held:
        yield pa.Table.from_batches(held)


NODES = "tree string, level int, idx long, node string, n long"


def _fold(level: int, levels: int):
    """From the nodes of a block at ``level``: those of the following levels, up to the tree's root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["tree", "block"]):
            n, tree = table["n"][0].as_py(), table["tree"][0].as_py()
            sizes = level_sizes(n)
            nodes = dict(zip(table["idx"].to_pylist(), table["node"].to_pylist(), strict=True))
            out = []
            for up in range(level, min(level + levels, len(sizes) - 1)):
                parents = sorted({i // ARITY for i in nodes})
                nodes = {p: digest([nodes[i] for i in run_of(p * ARITY, sizes[up])]) for p in parents}
                out += [(up + 1, i, x) for i, x in nodes.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int32()),
                 pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
                 pa.array([n] * len(out), pa.int64())], ["tree", "level", "idx", "node", "n"])
    return run


def in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def hashed_up(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (tree, level, idx, node) of the trees over ``leaves`` (tree, idx, n, leaf), and their roots."""
    below = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("node"), "n")
    parts, level = [below], 0
    height = len(level_sizes(leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])) - 1
    while level < height:
        block = F.floor(F.col("idx") / ARITY**LEVELS).cast("long")
        base = below.where(F.col("level") == level).withColumn("block", block)
        below = materialize(in_blocks(base, "idx").mapInArrow(_fold(level, LEVELS), NODES), "nodes")
        parts.append(below)
        level += LEVELS
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    top = Window.partitionBy("tree")  # rows with idx = 0 only, one for each level
    roots = nodes.where("idx = 0").withColumn("top", F.max("level").over(top)).where("level = top")
    return nodes.drop("n"), roots.select("tree", "n", F.col("node").alias("subroot"))


def build(rows: DataFrame) -> Manifest:
    """Manifest of ``rows`` (tree, doc_id, leaf and columns to pass on), ordered by doc_id in each tree.

    Null ids come first; rows with one id are ordered by their leaves, so the root does not depend on the layout.
    Rows that repeat are leaves of their own. An empty table has no root.
    """
    leaves = materialize(placed(rows, ["doc_id", "leaf"]), "leaves")
    nodes, roots = hashed_up(leaves)
    one = materialize(placed(roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"), F.col("n").alias("size")),
        ["name"]), "trees")
    above, root = hashed_up(one)
    above = materialize(above.drop("tree"), "above")
    last = root.first()
    trees = one.select(F.col("name").alias("tree"), F.col("size").alias("n"), F.col("leaf").alias("subroot"),
                       F.col("idx").alias("at"))
    return Manifest(leaves, nodes, trees, above, last["n"] if last else 0, last["subroot"] if last else None)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block of leaves lacks."""
    for table in by_group(batches, ["tree", "block"]):
        tree, block = table["tree"][0].as_py(), table["block"][0].as_py()
        found = missing_nodes(np.unique(table["idx"].to_numpy()), level_sizes(table["n"][0].as_py()))
        level = np.concatenate([np.full(len(x), k, np.int32) for k, x in found] or [np.zeros(0, np.int32)])
        idx = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree] * len(idx), pa.string()), pa.array(np.full(len(idx), block, np.int64)), pa.array(level),
             pa.array(idx)], ["tree", "block", "level", "idx"])


PROOF = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _expand(passed: list[str]):
    """Proofs of the leaves (those rows with kind 1) of each block from fetched nodes (kind 0) and the path of
    the tree's root (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["tree", "block"]):
            kind = table["kind"].to_numpy()
            rows = table.filter(pa.array(kind == 1))
            if not rows.num_rows:
                continue
            sizes = level_sizes(rows["n"][0].as_py())
            fetched = table.filter(pa.array(kind == 0))
            nodes = dict(zip(zip(fetched["level"].to_pylist(), fetched["idx"].to_pylist(), strict=True),
                             fetched["node"].to_pylist(), strict=True))
            own = rows["idx"].to_pylist()
            nodes |= {(0, i): leaf for i, leaf in zip(own, rows["leaf"].to_pylist(), strict=True)}
            subroot = derive(nodes, sorted(set(own)), sizes)
            rest = table.filter(pa.array(kind == 2)).sort_by("level")
            above = [{"left": a, "right": b} for a, b in zip(rest["left"].to_pylist(), rest["right"].to_pylist(), strict=True)]
            memo: dict = {}
            proofs = pa.array([path(nodes, i, sizes, memo) + above for i in own], STEPS)
            rows = rows.select(passed).append_column("subroot", pa.array([subroot] * len(own), pa.string()))
            yield from rows.append_column("proof", proofs).combine_chunks().to_batches()
    return run


def _paths_above(nodes: DataFrame, n_trees: int, trees: DataFrame) -> DataFrame:
    """(tree, level, left, right): the siblings on the way from each tree's root to the root of all."""
    height = len(level_sizes(n_trees)) - 1
    steps = trees.select("tree", F.col("at"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
    steps = steps.withColumn("own", F.floor(F.col("at") / F.pow(F.lit(float(ARITY)), F.col("level"))).cast("long"))
    steps = steps.withColumn("parent", F.floor(F.col("own") / ARITY).cast("long"))
    nodes = nodes.select("level", "idx", "node", F.floor(F.col("idx") / ARITY).cast("long").alias("parent"))
    both = steps.join(nodes, ["level", "parent"])
    side = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(test, F.struct("idx", "node")))), lambda x: x["node"]), "")
    return both.groupBy("tree", "level").agg(side(F.col("idx") < F.col("own")).alias("left"),
                                             side(F.col("idx") > F.col("own")).alias("right"))


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``wanted`` rows of ``manifest.leaves`` (all, if not given) with ``subroot`` and ``proof``: for every level
    from the leaf to the root of all the hashes of the run's other nodes, ``left`` and ``right`` of the own one."""
    leaves = manifest.leaves if wanted is None else wanted
    passed = [c for c in leaves.columns if c not in ("idx", "n", "tree")]
    schema = T.StructType([*[leaves.schema[c] for c in passed], T.StructField("subroot", T.StringType()),
                           T.StructField("proof", PROOF)])
    block = F.floor(F.col("idx") / ARITY**LEVELS).cast("long")
    blocks = leaves.withColumn("block", block)
    asked = in_blocks(blocks.select("tree", "block", "idx", "n"), "idx").mapInArrow(
        _requests, "tree string, block long, level int, idx long")
    fetched = asked.join(manifest.nodes, ["tree", "level", "idx"]).select(
        "tree", "block", "level", "idx", "node", F.lit(0).alias("kind"))
    rows = blocks.withColumn("kind", F.lit(1)).unionByName(fetched, allowMissingColumns=True)
    if manifest.n_trees > 1:
        above = _paths_above(manifest.above, manifest.n_trees, manifest.trees)
        above = blocks.select("tree", "block").distinct().join(above, "tree").withColumn("kind", F.lit(2))
        rows = rows.unionByName(above, allowMissingColumns=True)
    else:
        rows = rows.withColumns({"left": F.lit(None).cast("string"), "right": F.lit(None).cast("string")})
    return in_blocks(rows, "kind", "level", "idx").mapInArrow(_expand(passed), schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def audited(docs: DataFrame, fields: list[str], key: str, id_column: str, other: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf, subroot, proof and the root that its ``other`` content folds to.

    A row's leaf is the hash of ``fields``; its tree is that of ``key``, in the order of ``id_column`` (a long). ``other``
    replaces the value of fields for the audited copy. Returns doc_id, leaf, subroot, root, proof, folded_root and
    verified. A null key has a tree of its own; null values of fields are hashed as such. Rows with null ids
    come first in their tree. Rows that repeat are leaves of their own and have proofs of their own. Long texts are hashed
    whole. Other columns are ignored; an empty table gives no rows.
    """
    other = other or {}
    rows = docs.select(
        tree_name(key).alias("tree"), F.col(id_column).cast("long").alias("doc_id"), leaf_hash(fields).alias("leaf"),
        leaf_hash([other.get(c, c) for c in fields]).alias("audited"))
    manifest = build(rows)
    proofs = prove(manifest)
    out = proofs.select("doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof",
                        folded(F.col("audited"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
