"""Merkle manifest of a table, with inclusion proofs.

Leaves are grouped (``lang``) and ordered by ``doc_id``. Over each group, and
then over the groups' roots, stands a tree in which every eight consecutive
nodes become the hash of their hex digests; the last run of a level may be
shorter, one node included, and a lone node is its own root.

How it scales
-------------
Leaves get their rank by a range partitioning and prefix counts over it. A
tree is cut into aligned subtrees of 4,096 leaves (four levels of eight). One
task row holds one such block: its leaves go in, and what is stored is one
binary in the *van Emde Boas layout*: the block is cut at half its height, the
upper half first, then the lower halves from left to right, each laid out the
same way. ``address`` finds a node by arithmetic on (depth, index); neither
the builder nor the reader follows pointers, and what is near in the tree is
near in storage at every scale. The roots of blocks are the leaves of the next
pass, until a group has one block. Then the paths go down again: a block's
path above it is the same for all its leaves, so it is made once per block and
joined to it, and each leaf reads its siblings in its own block by address.

Defined cases: a null in any column is encoded as ``-``; leaves with equal
(group, doc_id) are ordered by their digest, null doc_ids come first; rows that
are equal in all five columns are folded into one with a count before anything
is ordered, and unfolded afterwards. A null group is a group of its own and
comes first. An empty table has no leaves and no root. Extra columns are not
part of a leaf and are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.llm.tables import ascii_lower, stored

ARITY = 8
EDGES = 4  # levels above the leaves in a full block
BLOCK = ARITY**EDGES
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- layout -------------------------------------------------------------------


def nodes_of(height: int) -> int:
    """Nodes of a full tree of ``height`` levels."""
    return (ARITY**height - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (root: 0) in the van Emde Boas layout of ``height`` levels."""
    at = np.zeros(len(index), np.int64)
    index = np.asarray(index, np.int64)
    while height > 1:
        upper = height // 2
        if depth < upper:
            height = upper
            continue
        lower = height - upper
        per = ARITY ** (depth - upper)  # nodes of that depth in one lower tree
        at += nodes_of(upper) + index // per * nodes_of(lower)
        index = index % per
        depth, height = depth - upper, lower
    return at


def edges_for(leaves: int) -> int:
    """Levels above ``leaves`` leaves until one node remains."""
    edges = 0
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        edges += 1
    return edges


def _hash(hex_digests: list[str]) -> str:
    return hashlib.sha256("".join(hex_digests).encode()).hexdigest()


def build(leaves: list[str], edges: int) -> bytes:
    """Layout of the tree of ``edges`` levels over hex digests; places without a node are zero."""
    height = edges + 1
    out = np.zeros((nodes_of(height), 32), np.uint8)
    level = leaves
    for depth in range(edges, -1, -1):
        raw = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        out[address(depth, np.arange(len(level)), height)] = raw
        if depth:
            level = [_hash(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
    return out.tobytes()


class Tree:
    """Reads a layout; ``leaves`` is the number of leaves in it."""

    def __init__(self, layout: bytes, leaves: int, edges: int):
        self.cells = np.frombuffer(layout, np.uint8).reshape(-1, 32)
        self.edges, self.counts = edges, [leaves]
        for _ in range(edges):
            self.counts.append(-(-self.counts[-1] // ARITY))

    def root(self) -> str:
        return self.cells[0].tobytes().hex()

    def paths(self) -> list[list[list[str]]]:
        """Per leaf, level by level, its run of nodes with an empty string at its own place."""
        runs: list[list[list[str]]] = []
        for up in range(self.edges):
            cells = self.cells[address(self.edges - up, np.arange(self.counts[up]), self.edges + 1)]
            text = cells.tobytes().hex()
            digests = [text[64 * i : 64 * i + 64] for i in range(self.counts[up])]
            runs.append([digests[i : i + ARITY] for i in range(0, len(digests), ARITY)])
        out = []
        for leaf in range(self.counts[0]):
            path, at = [], leaf
            for level in runs:
                at, own = divmod(at, ARITY)
                run = level[at]
                path.append([*run[:own], "", *run[own + 1 :]])
            out.append(path)
        return out


def proof(path: list[list[str]]) -> str:
    """Digest of the siblings, level by level, left to right."""
    return _hash([x for run in path for x in run])


def fold(leaf: str, path: list[list[str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for run in path:
        leaf = _hash([x or leaf for x in run])
    return leaf


def _pack(path: list[list[str]], above: str = "") -> str:
    """A path, and what is above it, as text; a dot stands for the own place in a run."""
    runs = [",".join(x or "." for x in run) for run in path]
    return "/".join([*runs, above] if above else runs)


def _unpack(path: str) -> list[list[str]]:
    return [["" if x == "." else x for x in run.split(",")] for run in path.split("/")] if path else []


# --- leaves and ranks ---------------------------------------------------------


def leaf_digest(text: Column | None = None) -> Column:
    """Hex digest of a row: each field ``-`` or its UTF-8 length, a colon and its value."""

    def told(name: str) -> Column:
        c = text if name == "text" and text is not None else F.col(name)
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[told(f) for f in FIELDS]).cast("binary"), 256)


def ranked(rows: DataFrame, group: list[str], order: list[str], times: str) -> DataFrame:
    """``rows`` (each standing for ``times`` rows) with ``first``, the rank of the first of them in its group, and ``total``.

    Range partitions hold bounded parts of a group, however large it is; what
    is summed over them is one row per partition and group.
    """
    dealt = rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "merkle-ranked")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *group).agg(F.sum(times).alias("_n"))
    across = Window.partitionBy(*group)
    offsets = parts.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_p_{g}") for g in group],
        F.coalesce(F.sum("_n").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(across).alias("total"),
    )
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_p_{g}"))
    own = dealt.withColumn("_inside", F.coalesce(F.sum(times).over(inside), F.lit(0)))
    joined = own.join(offsets, same).withColumn("first", F.col("_inside") + F.col("_before"))
    return joined.drop("_part", "_inside", "_before", "_p", *[f"_p_{g}" for g in group])


def _unfolded(rows: DataFrame, times: str) -> DataFrame:
    """One row per leaf, with its ``rank``; many equal rows are unfolded in two steps."""
    step = 4096
    outer = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / step)))
    inner = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step - 1).cast("long"), F.col(times) - 1 - F.col("_o") * step)))
    return rows.withColumn("_o", outer).withColumn("_i", inner).withColumn("rank", F.col("first") + F.col("_o") * step + F.col("_i")).drop("_o", "_i", "first", times)


# --- blocks -------------------------------------------------------------------


def _build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roots, layouts = [], []
        for digests, total in zip(b.column("digests").to_pylist(), b.column("total").to_pylist(), strict=True):
            layout = build(digests, EDGES if total > BLOCK else edges_for(total))
            layouts.append(layout)
            roots.append(layout[:32].hex())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "block", "total", "n", "rows")), pa.array(roots, pa.string()), pa.array(layouts, pa.binary())], names=["grp", "block", "total", "n", "rows", "block_root", "layout"])


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """One row per aligned subtree over (grp, rank, digest, total, payload); at most 4,096 leaves in each."""
    kept = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK))
    each = kept.groupBy("grp", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "digest", "payload"))).alias("x"))
    flat = each.select("grp", "block", "total", F.size("x").alias("n"), F.transform("x", lambda x: x["digest"]).alias("digests"), F.transform("x", lambda x: x["payload"]).alias("rows"))
    kind = nodes.schema["payload"].dataType.simpleString()
    group = nodes.schema["grp"].dataType.simpleString()
    return stored(flat.mapInArrow(_build_blocks, f"grp {group}, block bigint, total bigint, n int, rows array<{kind}>, block_root string, layout binary"), name)


def passes(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of blocks, the leaves' first, and (grp, subroot).

    Each pass is over 1/4,096 of the nodes of the one before; their number
    follows from the largest group.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels, done = [], None
    while True:
        level = blocks(nodes, f"{name}-{len(levels)}")
        levels.append(level)
        ready = level.where(F.col("total") <= BLOCK).select("grp", F.col("block_root").alias("subroot"))
        done = ready if done is None else done.unionByName(ready)
        if most <= BLOCK:
            return levels, done
        most = -(-most // BLOCK)
        nodes = level.where(F.col("total") > BLOCK).select(
            "grp", F.col("block").alias("rank"), F.col("block_root").alias("digest"),
            F.ceil(F.col("total") / BLOCK).alias("total"), F.lit(None).cast("string").alias("payload"),
        )


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them -> the path above each block that they stand on."""
    for b in batches:
        for i in range(b.num_rows):
            n, total, above = b.column("n")[i].as_py(), b.column("total")[i].as_py(), b.column("above")[i].as_py()
            tree = Tree(b.column("layout")[i].as_py(), n, EDGES if total > BLOCK else edges_for(total))
            first = b.column("block")[i].as_py() * BLOCK
            told = [_pack(path, above) for path in tree.paths()]
            same = {c: pa.array([b.column(c)[i].as_py()] * n, b.schema.field(c).type) for c in ("grp", "subroot", "root")}
            yield pa.RecordBatch.from_arrays([same["grp"], pa.array(range(first, first + n), pa.int64()), pa.array(told, pa.string()), same["subroot"], same["root"]], names=["grp", "block", "above", "subroot", "root"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of leaves with the path above them -> one row per leaf."""
    for b in batches:
        for i in range(b.num_rows):
            n, total = b.column("n")[i].as_py(), b.column("total")[i].as_py()
            tree = Tree(b.column("layout")[i].as_py(), n, EDGES if total > BLOCK else edges_for(total))
            above = _unpack(b.column("above")[i].as_py())
            out = []
            for row, path in zip(b.column("rows")[i].as_py(), tree.paths(), strict=True):
                path = [*path, *above]
                out.append((row["doc_id"], row["leaf"], proof(path), fold(row["shown"], path)))
            ids, leaves, proofs, folded = zip(*out, strict=True)
            same = [pa.array([b.column(c)[i].as_py()] * n, pa.string()) for c in ("subroot", "root")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves), *same, pa.array(proofs), pa.array(folded)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def _with_above(level: DataFrame, above: DataFrame) -> DataFrame:
    """``level`` joined with (grp, block, above, subroot, root)."""
    right = above.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "above", "subroot", "root")
    return level.join(right, level["grp"].eqNullSafe(F.col("_g")) & (level["block"] == F.col("_b"))).drop("_g", "_b")


# --- the operator -------------------------------------------------------------


def manifest(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Stored blocks of the groups' trees and of the tree over the groups, and (grp, subroot, root).

    ``rows`` holds the columns of a leaf, and ``shown``, the digest that is
    to be verified in its place.
    """
    folded = rows.select("lang", "doc_id", leaf_digest().alias("leaf"), "shown").groupBy("lang", "doc_id", "leaf", "shown").agg(F.count(F.lit(1)).alias("times"))
    leaves = _unfolded(ranked(folded, ["lang"], ["doc_id", "leaf", "shown"], "times"), "times")
    nodes = leaves.select(F.col("lang").alias("grp"), "rank", F.col("leaf").alias("digest"), "total", F.struct(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "shown").alias("payload"))
    levels, subroots = passes(nodes, "merkle-leaves")
    subroots = stored(subroots, "merkle-subroots")
    # The tree over the groups: one group of its own whose leaves are the subroots.
    tops = _unfolded(ranked(subroots.withColumns({"_all": F.lit(0), "times": F.lit(1).cast("long")}), ["_all"], ["grp", "subroot"], "times"), "times")
    tops = tops.select(F.lit(0).alias("grp"), "rank", F.col("subroot").alias("digest"), "total", F.struct(F.col("grp").alias("lang"), "subroot").alias("payload"))
    upper, root = passes(tops, "merkle-groups")
    return levels, upper, root.select(F.col("subroot").alias("root"))


def proofs(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; ``rows`` as for ``manifest``."""
    levels, upper, root = manifest(rows)
    # Down through the tree over the groups ...
    empty = F.lit("").alias("above")
    above = root.select(F.lit(0).alias("grp"), F.lit(0).cast("long").alias("block"), empty, F.lit("").alias("subroot"), "root")
    for level in reversed(upper[1:]):
        above = _with_above(level, above).mapInArrow(_down, "grp int, block bigint, above string, subroot string, root string")
    top = upper[0]
    langs = stored(_with_above(top, above).mapInArrow(_group_paths, f"lang {_type(levels[0], 'grp')}, above string, subroot string, root string"), "merkle-paths")
    # ... and through each group's; a group's highest block starts with the group's own path.
    group = _type(levels[0], "grp")
    above = None
    for k, level in reversed(list(enumerate(levels))):
        start = level.where(F.col("total") <= BLOCK).select(F.col("grp").alias("_g2"), "block")
        start = start.join(langs, F.col("_g2").eqNullSafe(langs["lang"])).select(F.col("lang").alias("grp"), "block", "above", "subroot", "root")
        above = start if above is None else above.unionByName(start)
        if k:
            above = stored(_with_above(level, above).mapInArrow(_down, f"grp {group}, block bigint, above string, subroot string, root string"), f"merkle-above-{k}")
    out = _with_above(levels[0], above).mapInArrow(_proofs, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks over subroots, with the path above them -> each group's path."""
    for b in batches:
        for i in range(b.num_rows):
            n, total, above = b.column("n")[i].as_py(), b.column("total")[i].as_py(), b.column("above")[i].as_py()
            tree = Tree(b.column("layout")[i].as_py(), n, EDGES if total > BLOCK else edges_for(total))
            rows = b.column("rows")[i].as_py()
            told = [_pack(path, above) for path in tree.paths()]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"] for r in rows], pa.string()), pa.array(told, pa.string()), pa.array([r["subroot"] for r in rows], pa.string()), pa.array([b.column("root")[i].as_py()] * n, pa.string())], names=["lang", "above", "subroot", "root"])


def tampered(rows: DataFrame, which: Column) -> DataFrame:
    """``rows`` with ``shown``: the digest of the row with its text lower-cased (A-Z) where ``which`` holds."""
    other = leaf_digest(ascii_lower(F.col("text")))
    return rows.withColumn("shown", F.when(which, other).otherwise(leaf_digest()))
