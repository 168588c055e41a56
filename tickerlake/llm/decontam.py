"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window). A document is hit where a window occurs word for
word. As a set join: a window is its set of shingles (``shingle`` words
each), all of which a containing passage must have, so for containment the
necessary prefix of a window is its single rarest shingle.

1. Rarity: shingles of the items are counted over the whole corpus.
2. Prefix: each distinct window keeps its rarest shingle and its offset.
3. Join: document positions that have a prefix shingle meet the windows of
   that shingle in a shuffled equality join.
4. Positional and length bounds: the window must start at position - offset
   >= 0 and end inside the document.
5. Verification: all words of the span equal the window's words.

Documents read a fixed-size bitmap of the item shingles (``bitmap_bits``
bits whatever the number of items) before anything is shuffled; it lets a
few more positions through, which the join drops. So a benchmark of any size
works, and a word that half of the corpus has costs nothing unless it is
some window's rarest shingle. Words meet as 64-bit hashes.

Defined cases: a null text or one without words has no windows and no hits;
equal items are hit together; repeated documents give one row each; a null
item_id is a separate item whose id reads as the empty string; an empty
benchmark hits nothing. Only doc_id, text and item_id are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored

_ROWS = "kind int, doc_id bigint, digest bigint, n_words bigint, pos bigint, shingle bigint, around array<bigint>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rolled(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, at) of all runs of ``k`` words inside one row; ``at``: first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n]
    for j in range(1, k):
        out = W.combine(out, h[j : j + n])
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return out[at], at


def _item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, win, size, offset, shingle, words): a row per shingle of a window."""

    def cut(batches):
        for b in batches:
            rows = []
            ids = b.column("item_id").to_pylist()
            for c in W.chunks(b.column("text"), W.NON_WORD):
                edge = np.searchsorted(c.row, np.arange(c.rows + 1))
                for r in range(c.rows):
                    h = c.hash[edge[r] : edge[r + 1]]
                    size = min(window, len(h))
                    k = min(shingle, size)
                    for s in range(len(h) - size + 1 if size else 0):
                        own = h[s : s + size]
                        win = int(_signed(rolled(own, np.zeros(size), size)[0])[0])
                        sh, at = rolled(own, np.zeros(size), k)
                        rows += [(ids[c.first + r], win, size, int(o), k, int(x), _signed(own).tolist()) for x, o in zip(_signed(sh), at)]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["item_id", "win", "size", "offset", "k", "shingle", "words"])

    few = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return few.mapInArrow(cut, "item_id bigint, win bigint, size bigint, offset bigint, k bigint, shingle bigint, words array<bigint>")


def _bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the shingles' low bits, collected as at most bits / 64 words of 64 bits."""
    at = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))
    rows = shingles.groupBy(F.floor(at / 64).cast("int").alias("at")).agg(F.bit_or(word).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _passing(chunk: W.Chunk, sizes: list[int], bitmap: np.ndarray):
    """(k, shingle hash, first word) of the positions that the bitmap lets through."""
    mask = np.uint64(len(bitmap) - 1)
    for k in sizes:
        sh, at = rolled(chunk.hash, chunk.row, k)
        ok = np.flatnonzero(bitmap[(sh & mask).astype(np.int64)])
        yield k, sh[ok], at[ok]


def _shingle_counts(docs: DataFrame, sizes: list[int], bitmap) -> DataFrame:
    """(shingle, n): occurrences in the corpus of what the bitmap lets through."""

    def count(batches):
        for b in batches:
            for c in W.chunks(b.column("text"), W.NON_WORD):
                for _, sh, _ in _passing(c, sizes, bitmap.value):
                    u, n = np.unique(sh, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _positions(docs: DataFrame, sizes: list[int], window: int, bitmap) -> DataFrame:
    """Kind 0: a row per document. Kind 1: positions that may hold a prefix shingle.

    ``around`` has the words from position - window to position + window
    (0 where the document has none), enough to verify any window there.
    """

    def scan(batches):
        for b in batches:
            ids, digests = b.column("doc_id"), b.column("digest").to_numpy(zero_copy_only=False)
            for c in W.chunks(b.column("text"), W.NON_WORD):
                n = c.word_counts()
                rows = pa.array(np.arange(c.first, c.first + c.rows))
                none = pa.nulls(c.rows, pa.int64())
                yield _batch(0, ids.take(rows), digests[c.first : c.first + c.rows], n, none, none, pa.nulls(c.rows, pa.list_(pa.int64())))
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                for _, sh, at in _passing(c, sizes, bitmap.value):
                    for i in range(0, len(at), 4096):
                        a, s = at[i : i + 4096], sh[i : i + 4096]
                        r = c.row[a]
                        lo, hi = begin[r], begin[r] + n[r]
                        grid = a[:, None] + np.arange(-window, window + 1)
                        inside = (grid >= lo[:, None]) & (grid < hi[:, None])
                        near = np.where(inside, _signed(c.hash)[np.clip(grid, 0, len(c.hash) - 1)], 0)
                        offs = np.arange(len(a) + 1, dtype=np.int32) * (2 * window + 1)
                        around = pa.ListArray.from_arrays(pa.array(offs), pa.array(near.ravel()))
                        yield _batch(1, ids.take(pa.array(r + c.first)), digests[r + c.first], n[r], pa.array(a - lo), pa.array(_signed(s)), around)

    def _batch(kind, ids, digest, n, pos, shingle, around):
        cols = [pa.array(np.full(len(ids), kind, np.int32)), ids, pa.array(digest), pa.array(n, pa.int64()), pos, shingle, around]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _ROWS.split(", ")])

    return docs.mapInArrow(scan, _ROWS)


def find(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, bitmap_bits: int = 1 << 24) -> DataFrame:
    """(doc_id, n_words, spans, items, digest): one row per document.

    ``spans``: distinct (start, size) in words of occurring windows, sorted;
    ``items``: ids (as text, sorted) of the items that have them;
    ``digest``: xxhash64 of the text.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stored(_item_windows(items, window, shingle), "windows")
    sizes = [r[0] for r in cut.select("k").distinct().collect()]  # at most ``shingle`` values
    whole = spark.sparkContext.broadcast(_bitmap(cut.select("shingle").distinct(), bitmap_bits))
    counts = _shingle_counts(texts, sizes, whole)

    # the rarest shingle of each distinct window (ties: the smaller hash, the first offset)
    known = cut.select("shingle").distinct().join(counts, "shingle", "left").select("shingle", F.coalesce("n", F.lit(0)).alias("n"))
    rank = F.struct("n", "shingle", "offset")
    prefix = cut.dropDuplicates(["win", "offset"]).join(known, "shingle").groupBy("win").agg(F.min(rank).alias("rarest"), F.first("size").alias("size"), F.first("words").alias("words"))
    prefix = stored(prefix.select("win", "size", "words", "rarest.shingle", "rarest.offset"), "prefix")

    rare = spark.sparkContext.broadcast(_bitmap(prefix.select("shingle").distinct(), bitmap_bits))
    rows = stored(_positions(texts.withColumn("digest", F.xxhash64("text")), sizes, window, rare), "positions")
    met = rows.where("kind = 1").join(prefix, "shingle")
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    span = F.slice("around", (F.lit(window + 1) - F.col("offset")).cast("int"), F.col("size").cast("int"))
    hit = met.where(fits & (span == F.col("words"))).select("doc_id", "digest", "win", start.alias("start"), "size")

    own = cut.select("win", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    # per document the windows it has, then the items that have these
    doc = ["doc_id", "digest"]
    named = hit.select(*doc, "win").distinct().join(own, "win").select(*doc, "item").distinct()
    parts = (
        rows.where("kind = 0").select(*doc, "n_words", F.lit(None).cast("struct<start:bigint,size:bigint>").alias("span"), F.lit(None).cast("string").alias("item"))
        .unionByName(hit.select(*doc, F.lit(None).cast("bigint").alias("n_words"), F.struct("start", "size").alias("span"), F.lit(None).cast("string").alias("item")))
        .unionByName(named.select(*doc, F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("struct<start:bigint,size:bigint>").alias("span"), "item"))
    )
    out = parts.groupBy(*doc).agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"), "doc_id", "n_words", "spans", "items", "digest").drop("_copy")


def words_hit(spans: str = "spans"):
    """Words covered by sorted spans (overlaps count once)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["size"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"))

    def clip(acc, s):
        return F.when(s["start"] + s["size"] <= acc["end"], acc).otherwise(step(acc, s))

    return F.aggregate(F.col(spans), zero, clip, lambda a: a["n"])


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain a benchmark window."""
    hit = find(docs, items, **options).where(F.size("spans") > 0).select("doc_id", "digest").distinct()
    # judged by id and text: rows that share an id only do not share a fate
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("h.digest"))
    return docs.alias("d").join(hit.alias("h"), same, "left_anti")
