"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles; two documents are linked
when the Jaccard similarity of their sets is at least ``threshold`` / 100.

* Sketch: per document the set's size, a digest of the set and ``positions``
  minwise tokens. Equal sets are one vertex from here on.
* Trees: each of ``trees`` independent trees deals every vertex to two nodes
  by two of its minwise tokens. A node of up to ``small`` vertices is
  compared exhaustively (on minwise tokens, then on full sets), one of up to
  ``medium`` times that block against block; a larger one branches again by two tokens that its path chooses. A pair at similarity s
  misses all nodes of a tree with probability q = (1 - s + s q)^2, at most
  0.0625 for s = 0.8 at any depth, so four trees find it with a probability
  of 1 - 1.5e-5; the token filter (``positions`` at four standard
  deviations) leaves out 3e-5 more.
* Large nodes first lose a ball: the vertex nearest to the node's most
  frequent tokens is the hub, all vertices linked to it are joined with it
  and leave the node. Jaccard distance is a metric, so whatever links to a
  ball of radius 0.2 lies within 0.4 of the hub: the ball meets only this
  ring, in blocks, and no pair inside a group of near copies is ever listed.
  So huge groups of near copies shrink by most of their size per level. What
  is still large after ``max_levels`` is compared in blocks, exactly.
* Links are confirmed on full sets (48-bit shingle hashes) and connected by
  ``components``.

Defined cases: a null or blank text has an empty set and no links; fewer
words than a shingle make one shingle of the whole sequence; rows that share
a doc_id are judged by their own texts; a null doc_id may not be a component
id unless the whole component has none. Empty input gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.components import components
from tickerlake.llm.tables import stored, with_small

_VOTES = 6
_SET_BITS = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Options:
    shingle: int = 2
    threshold: int = 80  # percent
    positions: int = 64
    trees: int = 4
    small: int = 2048
    medium: int = 4
    max_levels: int = 12
    bitmap_bits: int = 1 << 24


def _multipliers(n: int) -> np.ndarray:
    return W.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(chunk: W.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit shingle) distinct and sorted within each row of a chunk."""
    n = len(chunk.hash) - k + 1
    out_h, out_r = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n > 0:
        h = chunk.hash[:n]
        for j in range(1, k):
            h = W.combine(h, chunk.hash[j : j + n])
        ok = chunk.row[:n] == chunk.row[k - 1 : k - 1 + n]
        out_h.append(h[ok])
        out_r.append(chunk.row[:n][ok])
    # texts of fewer words: the whole sequence is one shingle
    counts = chunk.word_counts()
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for size in range(1, k):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            h = chunk.hash[first[rows]]
            for j in range(1, size):
                h = W.combine(h, chunk.hash[first[rows] + j])
            out_h.append(W.mix(h + np.uint64(size)))
            out_r.append(rows)
    h, r = np.concatenate(out_h) & _SET_BITS, np.concatenate(out_r)
    key = np.sort((r.astype(np.uint64) << np.uint64(48)) | h)  # rows of a chunk are under 2**16
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(48)).astype(np.int64), key & _SET_BITS


def _sketch(docs: DataFrame, o: Options) -> DataFrame:
    """(doc_id, key, n_shingles, digest, tokens)."""

    def run(batches):
        mult = _multipliers(o.positions)
        for b in batches:
            for c in W.chunks(b.column("text")):
                row, sh = shingle_sets(c, o.shingle)
                n = np.bincount(row, minlength=c.rows)
                has = np.flatnonzero(n)
                tokens = np.zeros((c.rows, o.positions), np.uint32)
                digest = np.zeros(c.rows, np.uint64)
                if len(has):
                    at = np.concatenate([[0], np.cumsum(n)[:-1]])[has]
                    x = W.mix(sh)
                    with np.errstate(over="ignore"):
                        digest[has] = W.combine(np.add.reduceat(x, at), np.add.reduceat(W.mix(x), at))
                        for i in range(o.positions):
                            tokens[has, i] = np.minimum.reduceat(((x * mult[i]) >> np.uint64(32)).astype(np.uint32), at)
                own = b.slice(c.first, c.rows)
                raw = pa.py_buffer(np.ascontiguousarray(tokens))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * o.positions), c.rows, [None, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("key"), pa.array(n), pa.array(digest.view(np.int64)), packed],
                    names=["doc_id", "key", "n_shingles", "digest", "tokens"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, digest bigint, tokens binary")


def _sets(docs: DataFrame, wanted: DataFrame, o: Options, packed: bool) -> DataFrame:
    """(vertex, shingles) of the vertices in ``wanted`` (vertex = key of a representative).

    A bitmap of the wanted keys keeps nearly all other texts out of the
    pass; what slips through meets nothing in the joins that follow. Packed
    sets are binary, six bytes a shingle; else arrays.
    """
    at = F.col("vertex").bitwiseAND(F.lit(o.bitmap_bits - 1))
    bit = F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))
    marks = wanted.groupBy(F.floor(at / 8).cast("int").alias("at")).agg(F.bit_or(bit).alias("octet")).toArrow()  # at most bitmap_bits / 8 rows
    table = np.zeros(o.bitmap_bits // 8, np.uint8)
    table[marks["at"].to_numpy()] = marks["octet"].to_numpy().astype(np.uint8)
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def some(b):
        at = b.column("key").to_numpy() & np.int64(o.bitmap_bits - 1)
        return b.filter(pa.array((bits.value[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1))

    def run(batches):
        for b in batches:
            b = some(b)
            for c in W.chunks(b.column("text")):
                row, sh = shingle_sets(c, o.shingle)
                offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=c.rows))]).astype(np.int32)
                if packed:
                    raw = np.ascontiguousarray(sh.view(np.uint8).reshape(-1, 8)[:, :6])
                    sets = pa.Array.from_buffers(pa.binary(), c.rows, [None, pa.py_buffer(offs * 6), pa.py_buffer(raw)])
                else:
                    sets = pa.ListArray.from_arrays(pa.array(offs), pa.array(sh.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(c.first, c.rows), sets], names=["vertex", "shingles"])

    found = docs.select("key", "text").mapInArrow(run, "vertex bigint, shingles " + ("binary" if packed else "array<bigint>"))
    return found.groupBy("vertex").agg(F.first("shingles").alias("shingles"))  # repeated rows have one key


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets) of packed sets."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.int64).ravel(), (offs - offs[0]) // 6


def _token(i: Column) -> Column:
    return F.substring(F.col("tokens"), (i * 4 + 1).cast("int"), F.lit(4))


def _groups(batches, key: str):
    """Arrow tables of whole groups from batches sorted by ``key``."""
    left = None
    for b in batches:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
        if cut:
            yield t.slice(0, cut)
        left = t.slice(cut)
    if left is not None and left.num_rows:
        yield left


def _labels(link: np.ndarray) -> np.ndarray:
    """Component (least index) of each row of a symmetric boolean matrix."""
    label = np.arange(len(link), dtype=np.int32)
    while True:
        least = np.where(link, label[None, :], np.int32(len(link))).min(1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _likely(nodes: DataFrame, vertices: DataFrame, o: Options) -> DataFrame:
    """(cluster, vertex): members of small nodes whose tokens may reach the threshold."""
    floor = o.threshold / 100 - 4 * (0.16 / o.positions) ** 0.5

    def run(batches):
        for t in _groups(batches, "node"):
            node, vertex = t["node"].to_numpy(), t["vertex"].to_numpy()
            raw = t["tokens"].combine_chunks()
            tok = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, o.positions)
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            out_c, out_d = [], []
            for i, j in zip(edge[:-1], edge[1:]):
                g = j - i
                if g < 2:
                    continue
                own = tok[i:j]
                same = np.zeros((g, g), np.uint16)
                for p in range(o.positions):
                    same += own[:, p][:, None] == own[:, p][None, :]
                label = _labels(same >= floor * o.positions)
                for root in np.flatnonzero(np.bincount(label) > 1):
                    members = np.sort(vertex[i:j][label == root])
                    out_c.append(np.full(len(members), W.mix(np.add.reduce(W.mix(members.view(np.uint64))).reshape(1)).view(np.int64)[0]))
                    out_d.append(members)
            if out_c:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_d))], names=["cluster", "vertex"])

    rows = nodes.join(vertices.select("vertex", "tokens"), "vertex").select("node", "vertex", "tokens")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "cluster bigint, vertex bigint").distinct()


def _confirmed(clusters: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """Links (a, b) of members that connect what the full sets link inside each cluster."""

    def linked(shared, sizes):
        return 100 * shared >= o.threshold * (sizes[:, None] + sizes[None, :] - shared)

    def run(batches):
        for t in _groups(batches, "cluster"):
            cluster, vertex = t["cluster"].to_numpy(), t["vertex"].to_numpy()
            flat, offs = _unpacked(t["shingles"].combine_chunks())
            edge = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
            a, b = [], []
            for i, j in zip(edge[:-1], edge[1:]):
                g = j - i
                sizes = np.diff(offs[i : j + 1]).astype(np.int64)
                if g == 2:
                    both = len(np.intersect1d(flat[offs[i] : offs[i + 1]], flat[offs[i + 1] : offs[j]], assume_unique=True))
                    shared = np.array([[sizes[0], both], [both, sizes[1]]])
                else:
                    shared = _shared(flat[offs[i] : offs[j]], np.repeat(np.arange(g), sizes), g)
                    np.fill_diagonal(shared, sizes)
                label = _labels(linked(shared, sizes))
                a.append(vertex[i:j][label != np.arange(g)])
                b.append(vertex[i:j][label[label != np.arange(g)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = clusters.join(sets, "vertex").select("cluster", "vertex", "shingles")
    return rows.repartition("cluster").sortWithinPartitions("cluster", "vertex").mapInArrow(run, "a bigint, b bigint")


def _shared(items: np.ndarray, row: np.ndarray, g: int, width: int = 2048) -> np.ndarray:
    """Sizes of all intersections of g sets, as products of 0/1 blocks over the items that repeat."""
    _, code, n = np.unique(items, return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    keep = n[code] > 1
    col, row = rank[code[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((g, g), np.float32)
    total = int((n > 1).sum())
    for c in range(0, total, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        block = np.zeros((g, min(width, total - c)), np.float32)
        block[row[lo:hi], col[lo:hi] - c] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _dealt(rows: DataFrame, by: list[str], size: Column, half: int) -> Column:
    """Block of a row when ``size`` rows are dealt into blocks of about ``half``."""
    return F.pmod(F.xxhash64("vertex", *by), F.greatest(F.ceil(size / half), F.lit(1)))


def _alike(a: str, b: str, positions: int) -> Column:
    """Share of equal minwise tokens, an estimate of the similarity."""
    same = F.transform(F.sequence(F.lit(0), F.lit(positions - 1)), lambda i: (F.substring(F.col(a), i * 4 + 1, F.lit(4)) == F.substring(F.col(b), i * 4 + 1, F.lit(4))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / positions


def _remove_ball(docs: DataFrame, large: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to hubs, clusters of ball and ring, rows left) of large nodes (node, vertex, tokens)."""
    picks = F.array(*[_token(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(o.positions))) for i in range(_VOTES)])
    counted = large.select("node", F.posexplode(picks).alias("at", "token")).groupBy("node", "at", "token").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy("node").agg(F.array(*[F.max(F.when(F.col("at") == i, F.struct("n", "token"))) for i in range(_VOTES)]).alias("top"))
    agree = F.aggregate(F.zip_with(picks, F.col("top"), lambda x, y: (x == y["token"]).cast("int")), F.lit(0), lambda x, y: x + y)
    hubs = large.join(usual, "node").groupBy("node").agg(F.max(F.struct(agree.alias("n"), F.col("vertex").alias("hub"), F.col("tokens").alias("hub_tokens"))).alias("top"))
    hubs = hubs.select("node", "top.hub", "top.hub_tokens")
    # full sets are fetched only of what the tokens place within the ring
    floor = 2 * o.threshold / 100 - 1 - 4 * (0.25 / o.positions) ** 0.5
    near = stored(large.join(hubs, "node").where(_alike("tokens", "hub_tokens", o.positions) >= floor).select("node", "vertex", "hub"), "near-hub")
    sets = stored(_sets(docs, near.select("vertex").distinct(), o, packed=False), "hub-sets")
    met = near.join(sets, "vertex").join(sets.withColumnsRenamed({"vertex": "hub", "shingles": "hub_set"}), "hub")
    shared = F.size(F.array_intersect("shingles", "hub_set"))
    union = F.size("shingles") + F.size("hub_set") - shared
    ring = 2 * o.threshold - 100  # similarity below which nothing in the ball has a link
    zone = F.when(100 * shared >= o.threshold * union, "ball").when(100 * shared >= ring * union, "ring").otherwise("out")
    zoned = stored(met.select("node", "vertex", "hub", zone.alias("zone")), "zones")
    links = zoned.where("zone = 'ball' AND vertex <> hub").select(F.col("vertex").alias("a"), F.col("hub").alias("b"))
    sizes = zoned.groupBy("node").agg(F.count_if(F.col("zone") == "ball").alias("n_ball"), F.count_if(F.col("zone") == "ring").alias("n_ring")).where("n_ring > 0")
    both = zoned.where("zone <> 'out'").join(sizes, "node")
    half = o.small // 2
    n_ball, n_ring = F.ceil(F.col("n_ball") / half), F.ceil(F.col("n_ring") / half)
    mine = F.when(F.col("zone") == "ball", _dealt(both, ["node"], F.col("n_ball"), half)).otherwise(_dealt(both, ["node"], F.col("n_ring"), half))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("zone") == "ball", n_ring).otherwise(n_ball) - 1))
    spread = both.select("node", "vertex", "zone", mine.alias("mine"), other.alias("other"))
    ball, ring_no = (F.when(F.col("zone") == z, F.col("mine")).otherwise(F.col("other")) for z in ("ball", "ring"))
    clusters = spread.select(F.xxhash64("node", ball, ring_no).alias("cluster"), "vertex")
    left = large.join(zoned.where("zone = 'ball'").select("node", "vertex"), ["node", "vertex"], "left_anti")
    return links, clusters, left


def _in_blocks(sized: DataFrame, o: Options) -> DataFrame:
    """Nodes of at most about ``small`` rows that compare every pair of the nodes (node, vertex, n)."""
    half = o.small // 2
    n_blocks = F.greatest(F.ceil(F.col("n") / half), F.lit(1))
    rows = sized.withColumn("mine", F.pmod(F.xxhash64("vertex", "node"), n_blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    return rows.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "vertex")


def _vertices(sketch: DataFrame) -> DataFrame:
    """(digest, vertex, tokens, least_id, times): one vertex per distinct set, named by the least key that has it."""
    full = sketch.where("n_shingles > 0")
    of_set = [F.min("key").alias("vertex"), F.max("tokens").alias("tokens"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("times")]
    return stored(full.groupBy("digest").agg(*of_set), "vertices")


def links_of(docs: DataFrame, vertices: DataFrame, o: Options) -> DataFrame:
    """Confirmed links (a, b) between vertices that connect the components."""
    pairs = F.array(*[F.xxhash64(F.lit(i // 2), F.lit(i), _token(F.lit(i))) for i in range(2 * o.trees)])
    rows = vertices.select(F.explode(pairs).alias("node"), "vertex")
    links, clusters, leaves = [], [], []
    for level in range(o.max_levels + 1):
        rows = stored(rows, f"level-{level}") if level else rows
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = stored(rows.join(sizes, "node"), f"sized-{level}")
        leaves.append(sized.where(F.col("n") <= o.small).select("node", "vertex"))
        most = o.small * o.medium if level < o.max_levels else 1 << 62
        leaves.append(_in_blocks(sized.where((F.col("n") > o.small) & (F.col("n") <= most)), o))
        big = sized.where(F.col("n") > most)
        if big.isEmpty():
            break
        large = big.select("node", "vertex").join(vertices.select("vertex", "tokens"), "vertex")
        to_hub, met, left = _remove_ball(docs, large, o)
        links.append(to_hub)
        clusters.append(met)
        one = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(o.positions))
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(-2)), F.lit(o.positions - 1)), F.lit(o.positions))
        rows = left.select(F.explode(F.array(*[F.xxhash64("node", i, _token(i)) for i in (one, two)])).alias("node"), "vertex")
    nodes = leaves[0]
    for x in leaves[1:]:
        nodes = nodes.unionByName(x)
    found = _likely(nodes, vertices, o)
    for x in clusters:
        found = found.unionByName(x)
    found = stored(found, "clusters")
    out = _confirmed(found, _sets(docs, found.select("vertex").distinct(), o, packed=True), o)
    for x in links:
        out = out.unionByName(x)
    return stored(out.where("a <> b").distinct(), "links")


def near_duplicates(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept): one row per document.

    ``component_id`` is the least doc_id reachable; ``key`` is a hash of id
    and text by which ``deduplicate`` finds the row again.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    sketch = stored(_sketch(texts, o), "sketch")
    vertices = _vertices(sketch)
    roots = components(links_of(texts, vertices, o), "near-duplicates")
    own = sketch.select("doc_id", "key", "n_shingles", "digest")
    # minima are taken per set, then per component; documents only meet the result
    of_set = vertices.select("digest", "vertex", "least_id", "times").join(roots.withColumnRenamed("id", "vertex"), "vertex", "left")
    of_set = stored(of_set.select("digest", F.coalesce("root", "vertex").alias("root"), "least_id", "times"), "roots-of-sets")
    least = of_set.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    found = with_small(of_set, least, ["root"], F.col("sets")).select("digest", "component_id", "times")
    out = with_small(own.where("n_shingles > 0"), found, ["digest"], F.col("times")).select("doc_id", "key", "n_shingles", "component_id")
    out = out.unionByName(own.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row of ``docs`` per component: the one with the least doc_id (ties: the least text hash).

    Rows that share doc_id and text are one document, and any one of them
    stays. Documents without words have no links and all stay.
    """
    found = near_duplicates(docs, o)
    first = found.where("n_shingles > 0 AND kept").groupBy("component_id").agg(F.min("key").alias("key")).select("key")
    key = "_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    has_words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.where(has_words).withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    # the join shuffles by key where it shuffles, and the repeats meet there
    kept = marked.join(first.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key]).drop(key)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~has_words))
