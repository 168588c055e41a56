"""Prefix trie of conversations: which beginnings are shared, and by whom.

A node is a distinct sequence of the first d turns (role, text); the root has
d = 0. Its members are the conversations that begin with it.

How it works
------------
Each conversation becomes one path, two 64-bit hashes per turn (texts stay
behind). Paths are range-partitioned and sorted, copies by conv_id, so hot
beginnings and hot copies are spread over many blocks. Blocks are numbered and
stored; each gets the last path of the block before and the first path of the
next. In a block, numpy computes

* the longest common prefix (LCP) of every two neighbouring paths, the edges
  of the block included, and a sparse table of range minima over them;
* for each candidate prefix (path s, depth d) the two ends of its interval:
  binary searches in the sparse table, to the left and to the right, each for
  itself, find how far the minimum of the LCPs stays at d or more. No stack
  and no tree is kept. A candidate that is the left end of its interval
  stands for the node;
* the node's counts from prefix sums over its interval. A path adds those
  nodes to the trie that are deeper than its LCP, so sums over distinct nodes
  are sums over paths, and what a block counts simply adds up.

Nodes that reach over blocks are merged by the hash of their turns. Ids of
conversations that end in a node are written in pieces, block by block, and
digested in a stream, so a node with very many copies needs no list of them.

Defined cases: a null role or text is empty; turns are ordered by turn, null
first, and ties by role, then by a hash of the text; rows without a conv_id belong to no conversation; a
conversation is one record (20 bytes a turn). Repeated rows are turns of their
own. An empty table has no conversations and so no root. Only conv_id, turn,
role and text are read; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored, with_small

BLANK = r"[^\x20\x09-\x0D]+"


# --- conversations as paths ---------------------------------------------------


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, as (a, b, words)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    each = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), role.alias("role"),
            F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
            F.regexp_count(text, F.lit(BLANK)).alias("words"),
        ).alias("x"),
    )
    ordered = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ordered.select("conv_id", F.transform("x", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """Each conversation with its first ``shared`` turns (at most ``most``) taken from conversation ``base``.

    A base with fewer turns gives all it has, a missing one none.
    """
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    own = turns.withColumns({"_base": base, "_h": shared})
    joined = own.join(heads, "_base", "left")
    empty = F.slice("turns", 1, 0)
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", empty), F.lit(1), F.col("_h"))).otherwise(empty)
    tail = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


# --- range minima and intervals -----------------------------------------------


class SparseTable:
    """Minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first .. last] (both included)."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            table = self.levels[level]
            out[own] = np.minimum(table[first[own]], table[last[own] - (1 << int(level)) + 1])
        return out

    def reach_right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Largest r with values[start + 1 .. r] all at least ``bound``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            fits = at + 1 < len(table)
            fits[fits] = table[at[fits] + 1] >= bound[fits]
            at[fits] += 1 << k
        return at

    def reach_left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Least l with values[l + 1 .. start] all at least ``bound``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            first = at - (1 << k) + 1
            fits = first >= 1
            fits[fits] = table[first[fits]] >= bound[fits]
            at[fits] -= 1 << k
        return at


def common_prefixes(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """LCP of each path with the one before it (the first: 0)."""
    size = np.diff(ends, prepend=0)
    start = ends - size
    out = np.zeros(len(ends), np.int64)
    if len(ends) < 2:
        return out
    both = np.minimum(size[1:], size[:-1])
    place, pair = W.ragged(np.zeros(len(both), np.int64), both)
    now, was = start[1:][pair] + place, start[:-1][pair] + place
    differ = (a[now] != a[was]) | (b[now] != b[was])
    out[1:] = both
    np.minimum.at(out, pair[differ] + 1, place[differ])
    return out


def _chained(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first d turns of each path, d = 0 .. size, one path after the other."""
    size = np.diff(ends, prepend=0)
    start, off = ends - size, np.cumsum(size + 1) - size - 1
    out = []
    for x in (a, b):
        x = x.view(np.uint64)
        h = np.zeros(int((size + 1).sum()), np.uint64)
        h[off] = 1
        alive = np.arange(len(size))
        for d in range(int(size.max()) if len(size) else 0):
            alive = alive[size[alive] > d]
            h[off[alive] + d + 1] = W.combine(h[off[alive] + d], x[start[alive] + d])
        out.append(h.view(np.int64))
    return out[0], out[1]


_NODES = (
    "k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, n_convs bigint, conv_id bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, n_ends bigint, ends string, first_end bigint"
)
_COLUMNS = [c.split()[0] for c in _NODES.split(", ")]


def _block_nodes(conv: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """What one sorted block knows of each of its nodes (kind 0 and 2: paths of the neighbouring blocks, without words)."""
    lcp = common_prefixes(a, b, ends)
    after = np.append(lcp[1:], 0)
    size = np.diff(ends, prepend=0)
    own = np.flatnonzero(kind == 1)
    lo, hi = int(own[0]), int(own[-1]) + 1
    lcp, after = lcp[lo:hi], after[lo:hi]
    begin = int(ends[lo - 1]) if lo else 0
    a, b = (x[begin : int(ends[hi - 1])] for x in (a, b))
    conv, size = conv[lo:hi], size[lo:hi]
    ends = np.cumsum(size)
    m = len(conv)

    place, path = W.ragged(np.zeros(m, np.int64), size + 1)  # candidates: every path at every depth, 0 too
    off = np.cumsum(size + 1) - size - 1
    ranges = SparseTable(lcp)
    left, right = ranges.reach_left(path, place), ranges.reach_right(path, place)
    node = np.flatnonzero(left == path)
    l, r, d = path[node], right[node], place[node]

    before = np.concatenate([[0], np.cumsum(words)])  # words before each turn of the block
    first_turn = ends - size
    total = before[ends] - before[first_turn]
    upto = lambda s, depth: before[first_turn[s] + depth] - before[first_turn[s]]
    # Words of the nodes that each path adds to the trie: those deeper than its LCP.
    added = total - upto(np.arange(m), lcp)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    total_sum, added_sum, leaf_sum = sums(total), sums(added), sums(after < size)
    members = r - l + 1
    deeper = total_sum[r + 1] - total_sum[l] - members * upto(l, np.maximum(d - 1, 0))
    distinct = added_sum[r + 1] - added_sum[l + 1] + total[l] - upto(l, np.maximum(np.maximum(d - 1, 0), lcp[l]))
    # A leaf is counted at the last of its copies.
    leaves = leaf_sum[r + 1] - leaf_sum[l]

    children = np.zeros(len(path), np.int64)
    new = np.flatnonzero((place > lcp[path]) & (place > 0))
    parent_depth = place[new] - 1
    np.add.at(children, off[left[new - 1]] + parent_depth, 1)

    k1, k2 = _chained(a, b, ends)
    same = np.zeros(m, bool)  # a copy of the path before it in this block
    same[1:] = (lcp[1:] == size[1:]) & (size[1:] == size[:-1])
    run = np.flatnonzero(~same)
    run_stop = np.append(run[1:], m)
    here = off[run] + size[run]
    told = dict(zip(here.tolist(), (",".join(map(str, conv[x:y].tolist())) for x, y in zip(run.tolist(), run_stop.tolist(), strict=True)), strict=True))
    count = np.zeros(len(path), np.int64)
    count[here] = run_stop - run
    ended = [told.get(i) for i in node.tolist()]
    first_end = np.zeros(len(path), np.int64)
    first_end[here] = conv[run]
    top = d == 0
    cols = [
        pa.array(k1[node]), pa.array(k2[node]), pa.array(d),
        pa.array(k1[np.maximum(node - 1, 0)], mask=top), pa.array(k2[np.maximum(node - 1, 0)], mask=top),
        pa.array(members), pa.array(SparseTable(conv).least(l, r)), pa.array(children[node]), pa.array(leaves),
        pa.array(deeper - distinct), pa.array(count[node]), pa.array(ended, pa.string()), pa.array(first_end[node], mask=count[node] == 0),
    ]
    return pa.RecordBatch.from_arrays(cols, names=_COLUMNS)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted, -> partial nodes. One block is held at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        b = table.combine_chunks().to_batches()[0]
        lists = b.column("path")
        flat = np.asarray(lists.flatten())
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists))) // 2
        words = np.asarray(b.column("words").flatten()).astype(np.int64)
        return _block_nodes(*(np.asarray(b.column(c)) for c in ("conv_id", "kind")), flat[::2].copy(), flat[1::2].copy(), words, ends.astype(np.int64))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        block = np.asarray(held.column("block"))
        cuts = np.flatnonzero(np.diff(block)) + 1
        for x, y in zip([0, *cuts[:-1]], cuts, strict=False):
            yield solve(held.slice(int(x), int(y - x)))
        if len(cuts):
            held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield solve(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of ids -> one digest per node, in a stream."""
    key, digest = None, None
    for b in batches:
        out = []
        for k1, k2, depth, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "depth", "ends")), strict=True):
            if (k1, k2, depth) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2, depth), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield _digest_batch(out)
    if key is not None:
        yield _digest_batch([(*key, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["k1", "k2", "depth", "ends_sha256"])


# --- the operator -------------------------------------------------------------


def sorted_blocks(convs: DataFrame) -> DataFrame:
    """(block, kind, conv_id, path, words): sorted blocks (kind 1) and their neighbours' nearest paths (0, 2)."""
    path = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    flat = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words"))
    dealt = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    own = stored(dealt.withColumn("block", F.spark_partition_id()), "trie-paths").withColumn("kind", F.lit(1))
    # One row per block: as many as the shuffle has partitions.
    edges = own.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    by = Window.orderBy("block")
    near = edges.select("block", F.lag("last").over(by).alias("was"), F.lead("first").over(by).alias("then"))
    none = F.array().cast("array<int>")
    beside = [
        near.where(F.col(c).isNotNull()).select(F.lit(0).cast("long").alias("conv_id"), F.col(c).alias("path"), none.alias("words"), "block", F.lit(k).alias("kind"))
        for c, k in (("was", 0), ("then", 2))
    ]
    return own.unionByName(beside[0]).unionByName(beside[1])


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, turns); see the module docstring.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words that members beyond the first repeat, summed
    over the subtree), ends_sha256 (digest of the ids that end here), n_ends.
    """
    blocks = sorted_blocks(convs).repartition("block").sortWithinPartitions("block", "kind", "path", "conv_id")
    partial = stored(blocks.mapInArrow(_nodes, _NODES), "trie-partial")
    key = ["k1", "k2", "depth"]
    added = ["n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]
    merged = partial.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), *[F.sum(c).alias(c) for c in added])
    pieces = partial.where("n_ends > 0").select(*key, "first_end", "ends").repartition(*key).sortWithinPartitions(*key, "first_end")
    digests = pieces.mapInArrow(_digests, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")
    nodes = stored(merged.join(digests, key, "left"), "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_times"))
    out = with_small(nodes, parents, ["p1", "p2"], F.col("_times"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "n_ends")
