"""Language-model scores by context-tree weighting.

A text is its words (ASCII lower case) and one end. The bytes of a word and
the blank after it are coded one by one after the bytes of the word so far
(``depth`` at most, beginning with the blank before it); the end is a byte
of its own after a blank. The blank before a word carries the class of its
text (``cls``, say its language, known for training rows only): a text is
scored as a mixture over the classes. A byte is decomposed into eight binary decisions,
each with a context tree over the preceding bytes. Every node of a tree has
the Krichevsky-Trofimov estimate of its counts, and the weighted probability
P_w = 1/2 P_KT + 1/2 product of P_w over its children mixes all depths; the
predictive probability follows from the posterior weights on the path.

The counts are those of the whole training corpus, and every byte string of
its words is kept: Spark counts the words and their byte strings, a task
grows the subtrees under the contexts of three bytes that it is dealt, the
driver the depths over them, and the log probabilities are a stored table
that the distinct words of all texts are joined with. Bytes that a context
has never seen share what its trees leave to them, in proportion to the next
shorter context, so the probabilities of all bytes sum to one everywhere.

With ``Options.across`` (the query) contexts go on through the blanks into the
words before: ``ctw_text`` counts, grows and scores the running texts with the
trees of this module. Without it a context ends at the blank before its word.

Code length: ``score`` is log10 P(text); bits_per_byte is its code length.

Defined cases: a null or blank text is one end token; without training rows
each byte has probability 1/256; repeated rows give a row each; a null
doc_id counts as a training document. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored

END = 0x0A  # the byte of the end of a text
END_GRAM = 0x20 << 8 | END


@dataclass(frozen=True)
class Options:
    depth: int = 7  # at most: a gram is packed into 64 bits
    top: int = 3  # depths below this one are grown on the driver, the subtrees in tasks
    piece: int = 1 << 18  # grams that a task grows at once, in whole subtrees
    max_classes: int = 8
    max_frequent: int = 1 << 19  # words whose counts every task holds
    across: bool = False  # contexts go on through the blank into the words before (``ctw_text``)
    slices: int = 512  # across: parts of the tree, each of whole subtrees
    groups: int = 32  # across: groups of slices that answer what texts ask for
    max_grams: int = 1 << 21  # across: byte strings whose probabilities every task holds
    chunk: int = 1 << 23  # across: bytes of texts that a task looks at together
    bucket: int = 1 << 31  # across: bytes of training texts for which a group is one task


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series after a shift by eight)."""
    shift = np.zeros(x.shape)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


_SHORT = 1 << 12
_LGAMMA = {shift: _lgamma(np.arange(_SHORT) + shift) for shift in (0.5, 1.0)}


def _lgamma_of(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) of counts: most are small, and theirs are kept."""
    out = np.take(_LGAMMA[shift], n.astype(np.int64), mode="clip")
    large = np.flatnonzero(n >= _SHORT)
    out[large] = _lgamma(n[large] + shift)
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma_of(a, 0.5) + _lgamma_of(b, 0.5) - _lgamma_of(a + b, 1.0) - np.log(np.pi)


@dataclass
class Tree:
    """Per depth from ``first`` on: grams (context and byte) with log10 P, contexts with the log10 share of unseen bytes.

    ``nodes`` are the decisions of the deepest level (key, mixture so far,
    weight left) from which subtrees go on; ``above`` is what lies over a
    subtree.
    """

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    unseen: list[np.ndarray]
    first: int = 0
    nodes: tuple | None = None
    above: Tree | None = None

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 P of the last byte of packed grams after the bytes before it."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for i in range(len(self.grams) - 1, -1, -1):
            own = gram[todo] & _mask(self.first + i + 1)
            p = W.looked_up(self.grams[i], self.logp[i], own, np.float32(np.nan))
            met = ~np.isnan(p)
            out[todo[met]] += p[met]
            todo, own = todo[~met], own[~met]
            out[todo] += W.looked_up(self.contexts[i], self.unseen[i], own >> np.uint64(8), np.float32(0))
        if self.above is not None:
            out[todo] += self.above.log10(gram[todo])
        else:
            out[todo] += np.log10(1 / 256)  # below depth 0: one of all bytes
        return out


def _lead(cls: int) -> int:
    """The blank before a word of a text of class ``cls``."""
    return 1 + cls


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def _weigh(grams, counts, first, j, under=None):
    """The j-th binary decision of every depth: (nodes, parents, place and bit of each gram, n0, n1, log P_w, log share of the own estimate).

    ``under`` has (node, log P_w, count) sums of the children of the deepest level.
    """
    levels = range(len(grams))
    node, at, n0, n1 = [], [], [], []
    for i in levels:
        byte = (grams[i] & np.uint64(255)).astype(np.int16)
        prefix = ((1 << j) | (byte >> (8 - j))).astype(np.uint64)
        key, inv = np.unique((grams[i] & ~np.uint64(255)) | prefix, return_inverse=True)
        inv, bit = inv.ravel().astype(np.int32), ((byte >> (7 - j)) & 1).astype(bool)
        node.append(key)
        at.append((inv, bit))
        n1.append(np.bincount(inv, counts[i] * bit, len(key)))
        n0.append(np.bincount(inv, counts[i] * ~bit, len(key)))
    # a node's parent has the context without its first byte
    parent = [None] + [np.searchsorted(node[i - 1], node[i] & _mask(first + i)).astype(np.int32) for i in levels if i]
    weighted, own = [None] * len(grams), [None] * len(grams)
    for i in reversed(levels):
        kt = _log_kt(n0[i], n1[i])
        if i < len(grams) - 1:
            below = np.bincount(parent[i + 1], weighted[i + 1], len(node[i]))
        elif under is not None:
            below = W.looked_up(under[0], under[1], node[i], 0.0)
        else:
            weighted[i], own[i] = kt, np.zeros(len(kt))
            continue
        # every count goes on to the next depth, so a node with children has all its counts there
        weighted[i] = np.logaddexp(kt, below) + np.log(0.5)
        own[i] = np.log(0.5) + kt - weighted[i]
    return node, parent, at, n0, n1, weighted, own


def levels_of(gram: np.ndarray, count: np.ndarray, first: int, last: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted grams and counts of the depths first .. last from those of the deepest."""
    grams, counts = [], []
    for d in range(last, first - 1, -1):
        gram, inv = np.unique(gram & _mask(d + 1), return_inverse=True)
        count = np.bincount(inv.ravel(), count, len(gram))
        grams.insert(0, gram)
        counts.insert(0, count)
    return grams, counts


def roots(grams: list[np.ndarray], counts: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """(node of depth first - 1, sum of log P_w of its children) of subtrees that begin at depth ``first``."""
    keys, sums = [], []
    for j in range(8):
        node, *_, weighted, _ = _weigh(grams, counts, first, j)
        key, inv = np.unique(node[0] & _mask(first), return_inverse=True)
        keys.append(key)
        sums.append(np.bincount(inv.ravel(), weighted[0], len(key)))
    return np.concatenate(keys), np.concatenate(sums)


def grow(grams: list[np.ndarray], counts: list[np.ndarray], first: int = 0, under=None, above: Tree | None = None) -> Tree:
    """Tree from the sorted grams of the depths first, first + 1, .. and their counts.

    ``under`` (sorted nodes of the deepest level, sums of their children's
    log P_w) stands for the subtrees below; ``above`` is the tree whose
    deepest level is first - 1.
    """
    levels = range(len(grams))
    logp = [np.zeros(len(g)) for g in grams]
    ends = []
    for j in range(8):
        node, parent, at, n0, n1, _, own = _weigh(grams, counts, first, j, under)
        mixed = rest = None
        for i in levels:
            p1 = (n1[i] + 0.5) / (n0[i] + n1[i] + 1)
            if i:
                before, left = mixed[parent[i]], rest[parent[i]]
            elif above is not None:
                up = np.searchsorted(above.nodes[0], node[0] & _mask(first))
                before, left = above.nodes[1][up], above.nodes[2][up]
            else:
                before, left = 0.0, 1.0
            stop = before + left * p1  # the path ends here
            inv, bit = at[i]
            logp[i] += np.log10(np.where(bit, stop[inv], 1 - stop[inv]))
            w = np.exp(np.minimum(own[i], 0))
            mixed, rest = before + left * w * p1, left * (1 - w)
        if under is not None:
            ends.append((node[-1], mixed, rest))
    contexts, unseen = [], []
    for i in levels:
        ctx, inv = np.unique(grams[i] >> np.uint64(8), return_inverse=True)
        inv = inv.ravel()
        seen = np.bincount(inv, 10 ** logp[i], len(ctx))
        if i:
            lower = 10 ** logp[i - 1][np.searchsorted(grams[i - 1], grams[i] & _mask(first + i))]
        elif above is not None:
            lower = 10 ** above.logp[-1][np.searchsorted(above.grams[-1], grams[0] & _mask(first))].astype(float)
        else:
            lower = np.full(len(grams[0]), 1 / 256)
        share = np.maximum(1 - seen, 1e-12) / np.maximum(1 - np.bincount(inv, lower, len(ctx)), 1e-12)
        contexts.append(ctx)
        unseen.append(np.log10(share).astype(np.float32))
    nodes = None
    if ends:
        key, mixed, rest = (np.concatenate(x) for x in zip(*ends))
        order = np.argsort(key)
        nodes = key[order], mixed[order], rest[order]
    return Tree(grams, [x.astype(np.float32) for x in logp], contexts, unseen, first, nodes, above)


def vocabulary(docs: DataFrame, classes: int) -> DataFrame:
    """(word, hash, n, n_0 .. n_k): training counts of all words of ``docs`` (text, cls), in all and by class.

    Rows of class -1 are no training rows: their words are listed, not counted.
    """

    def count(batches):
        for b in batches:
            cls = b.column("cls").to_numpy()
            for k in np.unique(cls):
                for c in W.chunks(b.column("text").filter(pa.array(cls == k))):
                    d = W.distinct_words(c)
                    at, _ = W.ragged(d.start, d.stop - d.start)
                    offs = np.concatenate([[0], np.cumsum(d.stop - d.start)]).astype(np.int32)
                    word = pa.Array.from_buffers(pa.binary(), len(d.hash), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(c.data[at]))])
                    yield pa.RecordBatch.from_arrays([word, pa.array(d.hash.view(np.int64)), pa.array(d.count * int(k >= 0)), pa.array(np.full(len(d.hash), k, np.int32))], names=["word", "hash", "n", "cls"])

    rows = docs.select("text", "cls").mapInArrow(count, "word binary, hash bigint, n bigint, cls int")
    each = [F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in range(classes)]
    return rows.groupBy("word", "hash").agg(F.sum("n").alias("n"), *each)


def _word_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs[:-1], offs[1:]


def _place(gram: np.ndarray) -> np.ndarray:
    """Place in its word of the last byte of each gram, 0 if the blank before the word is out of the gram.

    Words hold no blank, so a blank in a context is the one before the word.
    """
    place = np.zeros(len(gram), np.int64)
    for i in range(1, 8):
        place[((gram >> np.uint64(8 * i)) & np.uint64(255)) == 0x20] = i
    return place


def _by_class(gram: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(has a blank in its context, gram of each class): the blanks of the context become those of each class."""
    blanks = np.zeros(len(gram), np.uint64)  # a one in each byte of the context that is a blank
    for i in range(1, 8):
        blanks |= (((gram >> np.uint64(8 * i)) & np.uint64(255)) == 0x20).astype(np.uint64) << np.uint64(8 * i)
    return blanks > 0, np.stack([gram ^ blanks * np.uint64(0x20 ^ _lead(k)) for k in range(classes)])


def _counted(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of training grams by class, from grams and their counts (class, gram)."""
    led, each = _by_class(gram, len(n))
    one = ~led & (n.sum(0) > 0)
    keys, counts = [gram[one]], [n.sum(0)[one]]
    for k in range(len(n)):
        own = led & (n[k] > 0)
        keys.append(each[k][own])
        counts.append(n[k][own])
    return np.concatenate(keys), np.concatenate(counts).astype(float)


def spell(vocab: DataFrame, ends: list[int], o: Options = Options()) -> DataFrame:
    """(gram, n_0 .. n_k): every byte string of the words of ``vocab`` and of the end of a text, with its training counts."""
    names = [f"n_{k}" for k in range(len(ends))]

    def run(batches):
        for b in batches:
            gram, owner = W.packed_grams(*_word_buffers(b.column("word")), o.depth + 1)
            u, inv = np.unique(gram, return_inverse=True)
            inv = inv.ravel()
            n = [np.bincount(inv, b.column(c).to_numpy()[owner], len(u)).astype(np.int64) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, n)], names=["gram", *names])

    grams = vocab.select("word", *names).mapInArrow(run, "gram bigint, " + ", ".join(f"{c} bigint" for c in names))
    last = vocab.sparkSession.range(1).select(F.lit(END_GRAM).cast("bigint").alias("gram"), *[F.lit(n).cast("bigint").alias(c) for n, c in zip(ends, names)])
    return grams.unionByName(last).groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])


def _columns(rows, names) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in names])


def train(vocab: DataFrame, ends: list[int], o: Options = Options()) -> Tree:
    """The whole tree in one process, for a vocabulary that fits it (``probabilities`` has no such bound)."""
    rows = spell(vocab, ends, o).toArrow()
    gram, n = _counted(rows["gram"].to_numpy().view(np.uint64), _columns(rows, [f"n_{k}" for k in range(len(ends))]))
    if not len(gram):
        return _nothing()
    return grow(*levels_of(gram, n, 0, o.depth))


def _nothing() -> Tree:
    return Tree([], [], [], [])


def _pieces(batches, group: str, least: int):
    """Tables of at least ``least`` rows of batches sorted by ``group``; no group is split."""
    kept, size = [], 0
    for b in batches:
        g = b.column(group).to_numpy()
        while len(g):
            if size >= least and g[0] != kept[-1].column(group)[-1].as_py():
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
            cut = np.flatnonzero(g[1:] != g[:-1]) + 1
            cut = cut[cut + size >= least]
            stop = int(cut[0]) if len(cut) else len(g)
            kept.append(b.slice(0, stop))
            size += stop
            b, g = b.slice(stop), g[stop:]
    if kept:
        yield pa.Table.from_batches(kept)


def probabilities(grams: DataFrame, classes: int, o: Options = Options()) -> DataFrame:
    """(gram, lp_0 .. lp_k): log10 P of the last byte of every gram of ``grams`` (gram, n_0 .. n_k) by class.

    Grams that share the last ``top`` bytes of their contexts lie in one
    subtree, so they meet in one task. The tasks grow their subtrees and
    return what the nodes over them need; the driver grows the depths under
    ``top`` (strings of at most ``top`` bytes); the tasks then score.
    """
    spark = grams.sparkSession
    names, lps = [f"n_{k}" for k in range(classes)], [f"lp_{k}" for k in range(classes)]
    top = min(o.top, o.depth)
    short = (1 << (8 * top)) - 1
    rows = grams.groupBy(F.col("gram").bitwiseAND(F.lit(short)).alias("gram")).agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    head, n = _counted(rows["gram"].to_numpy().view(np.uint64), _columns(rows, names))
    parts = max(spark.sparkContext.defaultParallelism, -(-grams.count() // o.piece))
    root = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(short)).alias("root")
    dealt = grams.select("gram", *names, root).repartition(parts, "root").sortWithinPartitions("root")

    def climb(batches):
        for t in _pieces(batches, "root", o.piece):
            gram, n = _counted(t["gram"].to_numpy().view(np.uint64), _columns(t, names))
            if len(gram):
                key, total = roots(*levels_of(gram, n, top, o.depth), top)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total)], names=["node", "total"])

    if len(head):
        # at most the decisions of the strings of ``top`` bytes
        under = dealt.mapInArrow(climb, "node bigint, total double").groupBy("node").agg(F.sum("total").alias("total")).toArrow()
        node, total = under["node"].to_numpy().view(np.uint64), under["total"].to_numpy()
        order = np.argsort(node)
        tree = grow(*levels_of(head, n, 0, top - 1), under=(node[order], total[order]))
    else:
        tree = _nothing()
    shipped = spark.sparkContext.broadcast(tree)

    def judge(batches):
        for t in _pieces(batches, "root", o.piece):
            asked = t["gram"].to_numpy().view(np.uint64)
            gram, n = _counted(asked, _columns(t, names))
            own = grow(*levels_of(gram, n, top, o.depth), first=top, above=shipped.value) if len(gram) else shipped.value
            led, each = _by_class(asked, classes)
            lp = np.empty((classes, len(asked)))
            lp[:, ~led] = own.log10(asked[~led])
            for k in range(classes):
                lp[k][led] = own.log10(each[k][led])
            yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), *[pa.array(x.astype(np.float32)) for x in lp]], names=["gram", *lps])

    return dealt.mapInArrow(judge, "gram bigint, " + ", ".join(f"{c} float" for c in lps))


def beginnings(probs: DataFrame, classes: int, o: Options = Options()) -> DataFrame:
    """(gram, lp_0 .. lp_k): log10 P of whole beginnings of words, where a word ends or leaves the reach of a gram.

    A gram with the blank before its word is the word up to there. Strings
    that agree in their first three bytes meet in one task, which adds up
    along them; the sums of one and two bytes are a bounded table.
    """
    lps = [f"lp_{k}" for k in range(classes)]
    blank = [F.shiftrightunsigned("gram", 8 * i).bitwiseAND(F.lit(255)) == 0x20 for i in range(1, 8)]
    place = F.coalesce(*[F.when(x, i + 1) for i, x in enumerate(blank)], F.lit(0))
    begun = probs.withColumn("place", place)
    short = begun.where("place IN (1, 2)").drop("place").toArrow()  # strings of one or two bytes
    key, lp = short["gram"].to_numpy().view(np.uint64), _columns(short, lps).astype(float)
    order = np.argsort(key)  # a longer string has the greater key, and its beginning a lower one
    key, lp = key[order], lp[:, order]
    two = np.flatnonzero(_place(key) == 2)
    lp[:, two] += lp[:, np.searchsorted(key, key[two] >> np.uint64(8))]
    shipped = probs.sparkSession.sparkContext.broadcast((key, lp))

    def ends(gram, place, lp):
        last = ((gram & np.uint64(255)) == 0x20) | (place == o.depth)
        return pa.RecordBatch.from_arrays([pa.array(gram[last].view(np.int64)), *[pa.array(x[last].astype(np.float32)) for x in lp]], names=["gram", *lps])

    def add(batches):
        up, up_lp = shipped.value
        for t in _pieces(batches, "front", o.piece):
            gram, place, lp = t["gram"].to_numpy().view(np.uint64), t["place"].to_numpy(), _columns(t, lps).astype(float)
            order = np.argsort(gram)
            gram, place, lp = gram[order], place[order], lp[:, order]
            for p in range(3, o.depth + 1):
                own = np.flatnonzero(place == p)
                before = gram[own] >> np.uint64(8)
                lp[:, own] += up_lp[:, np.searchsorted(up, before)] if p == 3 else lp[:, np.searchsorted(gram, before)]
            yield ends(gram, place, lp)

    front = F.expr("shiftrightunsigned(gram, 8 * (place - 3)) & 16777215").alias("front")
    parts = max(probs.sparkSession.sparkContext.defaultParallelism, -(-probs.count() // o.piece))
    long = begun.where("place > 2").select("gram", "place", *lps, front).repartition(parts, "front").sortWithinPartitions("front")
    kind = "gram bigint, " + ", ".join(f"{c} float" for c in lps)

    def few(batches):
        for _ in batches:
            yield ends(key, _place(key), lp)

    return long.mapInArrow(add, kind).unionByName(probs.sparkSession.range(1, numPartitions=1).mapInArrow(few, kind))


def spelled_out(vocab: DataFrame, probs: DataFrame, classes: int, o: Options = Options()) -> DataFrame:
    """(hash, n, lp_0 .. lp_k): log10 P of every word of ``vocab`` by class, by joins with the stored probabilities."""
    lps = [f"lp_{k}" for k in range(classes)]

    def run(batches):
        for b in batches:
            data, start, stop = _word_buffers(b.column("word"))
            gram, owner = W.packed_grams(data, start, stop, o.depth + 1)
            place, _ = W.ragged(np.ones(len(start), np.int64), stop - start + 1)
            # the beginning up to the reach of a gram at once, then byte by byte
            use = (place > o.depth) | (place == np.minimum(stop - start + 1, o.depth)[owner])
            gram, owner = gram[use], owner[use]
            order = np.lexsort((gram, owner))
            gram, owner = gram[order], owner[order]
            first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])][: len(gram)])
            times = np.diff(np.r_[first, len(gram)])
            own = b.column("hash").to_numpy()[owner[first]]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(gram[first].view(np.int64)), pa.array(times.astype(np.int64))], names=["hash", "gram", "times"])

    inner = [F.shiftrightunsigned("gram", 8 * i).bitwiseAND(F.lit(255)) != 0x20 for i in range(1, o.depth + 1)]
    for x in inner[1:]:
        inner[0] = inner[0] & x
    table = beginnings(probs, classes, o).unionByName(probs.where(inner[0]))
    each = vocab.select("word", "hash").mapInArrow(run, "hash bigint, gram bigint, times bigint").join(table, "gram")
    each = each.select("hash", *[(F.col("times") * F.col(c)).cast("float").alias(c) for c in lps])
    sums = each.groupBy("hash").agg(*[F.sum(c).cast("float").alias(c) for c in lps])
    return vocab.select("hash", "n").join(sums, "hash")


def cutoff(frequencies: DataFrame, most: int) -> int:
    """Least frequency f (rows f, k) such that at most ``most`` items are as frequent; above 10,000 they are not told apart."""
    left, floor = most, 10_001
    for f, k in sorted(((r["f"], r["k"]) for r in frequencies.collect()), reverse=True):  # at most 10,000 rows
        if k > left:
            break
        left, floor = left - k, f
    return floor


def score(docs: DataFrame, held_out: Column, cls: Column | None = None, o: Options = Options()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): a row per document.

    ``cls`` splits the training rows into classes: its ``max_classes`` - 1
    most frequent values, and all others with null.

    Every distinct word is scored once. Words of the ``max_frequent`` most
    frequent are looked up where they stand; all others meet their counts
    and scores in a join.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"),
        (F.lit(None) if cls is None else cls).cast("string").alias("cls"),
    )
    learn = texts.where("NOT held_out")
    by_class = learn.where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cls").limit(o.max_classes - 1).collect()
    n_docs = learn.count()
    ends = [n_docs - sum(r["n"] for r in by_class), *[r["n"] for r in by_class]]
    number = F.lit(0)
    for k, r in enumerate(by_class):
        number = F.when(F.col("cls") == r["cls"], k + 1).otherwise(number)
    number = F.when(F.col("held_out"), -1).otherwise(number).cast("int").alias("cls")
    if o.across:
        from tickerlake.llm import ctw_text

        rows, total, _, _ = ctw_text.score(texts.withColumn("cls", number), ends, o)
        return _mixture(rows, [f"lp_{k}" for k in range(len(ends))], total + n_docs)
    vocab = stored(vocabulary(texts.select("text", number), len(ends)), "vocabulary")
    total, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    n, z = total + n_docs, total + n_docs + 0.1 * (kinds + (n_docs > 0) + 1)
    prior = np.log10((np.array(ends) + 0.5) / (n_docs + 0.5 * len(ends)))

    lps = [f"lp_{k}" for k in range(len(ends))]
    probs = stored(probabilities(stored(spell(vocab, ends, o), "ctw-grams"), len(ends), o), "ctw-probabilities")
    end = probs.where(F.col("gram") == END_GRAM).first()
    end = np.array([end[c] for c in lps]) + prior
    scored = stored(spelled_out(vocab, probs, len(ends), o), "ctw-words")

    floor = cutoff(vocab.where("n > 0").groupBy(F.least("n", F.lit(10_000)).alias("f")).agg(F.count(F.lit(1)).alias("k")), o.max_frequent)
    often = scored.where(F.col("n") >= floor).select("hash", "n", *[F.col(c).cast("float").alias(c) for c in lps]).toArrow()  # at most max_frequent rows
    key = often["hash"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    table = spark.sparkContext.broadcast((key[order], often["n"].to_numpy()[order], np.stack([often[x].to_numpy()[order] for x in lps])))
    del often
    end_base, end_known = float(np.log10((n_docs + 0.1) / z)), int(n_docs > 0)

    names = ["doc_id", "digest", "held_out", "tokens", "known", "base", "bytes", "hash", "times", *lps]
    kind = "doc_id bigint, digest bigint, held_out boolean, tokens bigint, known bigint, base double, bytes bigint, hash bigint, times bigint, " + ", ".join(f"{c} double" for c in lps)

    def scan(batches):
        hashes, counts, logs = table.value
        for b in batches:
            for c in W.chunks(b.column("text")):
                own = b.slice(c.first, c.rows)
                d = W.distinct_words(c)
                n_of = W.looked_up(hashes, counts, d.hash, 0)
                whole = []
                for k in range(len(ends)):
                    lp = W.looked_up(hashes, logs[k], d.hash, np.float32(0)).astype(float)
                    whole.append(pa.array(np.bincount(c.row, lp[d.inverse], c.rows) + end[k]))
                base = np.where(n_of > 0, np.log10((n_of + 0.1) / z), 0.0)
                words = c.word_counts()
                known = np.bincount(c.row, (n_of > 0)[d.inverse], c.rows).astype(np.int64)
                size = np.bincount(c.row, (c.stop - c.start + 1), c.rows).astype(np.int64)
                none = pa.nulls(c.rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("digest"), own.column("held_out"), pa.array(words + 1), pa.array(known + end_known),
                     pa.array(np.bincount(c.row, base[d.inverse], c.rows) + end_base), pa.array(size + 1), none, none, *whole],
                    names=names,
                )
                # the words that are not at hand, once per document and word
                at = np.flatnonzero((n_of == 0)[d.inverse])
                if len(at):
                    pair, times = np.unique((c.row[at].astype(np.uint64) << np.uint64(32)) | d.inverse[at].astype(np.uint64), return_counts=True)
                    r, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    rows = pa.array(r)
                    none, half = pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id").take(rows), own.column("digest").take(rows), pa.nulls(len(r), pa.bool_()), none, none, half, none, pa.array(d.hash[w].view(np.int64)), pa.array(times), *[half] * len(lps)],
                        names=names,
                    )

    rows = stored(texts.drop("cls").withColumn("digest", F.xxhash64("text")).mapInArrow(scan, kind), "ctw-rows")
    rare = rows.where("hash IS NOT NULL").select("doc_id", "digest", "hash", "times")
    counted = rare.join(scored.where(F.col("n") < floor), "hash")
    null = F.lit(None)
    parts = rows.where("hash IS NULL").select("doc_id", "digest", "held_out", "tokens", "known", "base", "bytes", *lps).unionByName(
        counted.select(
            "doc_id", "digest", null.cast("boolean").alias("held_out"), null.cast("bigint").alias("tokens"),
            F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(z))).alias("base"),
            null.cast("bigint").alias("bytes"), *[(F.col("times") * F.col(c)).cast("float").alias(c) for c in lps],
        )
    )
    # equal rows add up alike, so each has its share of the sums
    copies = F.count("tokens")
    out = parts.groupBy("doc_id", "digest").agg(
        copies.alias("copies"), F.max("held_out").alias("held_out"), F.max("tokens").alias("n_tokens"), (F.sum("known") / copies).cast("bigint").alias("n_known"),
        (F.sum("base") / copies).alias("base_score"), F.max("bytes").alias("bytes"), *[(F.sum(c) / copies).alias(c) for c in lps],
    )
    named = {"n_tokens": "tokens", "n_known": "known", "base_score": "base"}
    out = out.withColumnsRenamed(named).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _mixture(out, lps, n)


def _mixture(rows: DataFrame, lps: list[str], train_tokens: int) -> DataFrame:
    """Rows (doc_id, held_out, tokens, known, base, bytes, lp_0 .. lp_k) as scores."""
    most = F.greatest(*lps) if len(lps) > 1 else F.col(lps[0])
    out = rows.withColumn("score", most + F.log10(sum((F.pow(F.lit(10.0), F.col(c) - most) for c in lps), F.lit(0.0))))
    bits = F.col("score") * F.lit(-np.log2(10).item()) / F.col("bytes")
    return out.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"),
    )
