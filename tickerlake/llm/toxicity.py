"""Toxicity by class-conditional Kneser-Ney models.

Words are expressions spelled in bytes. Each class (toxic, ordinary) has a
Kneser-Ney model of the next byte of a word after up to ``order`` - 1 bytes
of it; the class's own counts are discounted, and what the discount sets
aside goes to one backoff model shared by both classes, built from pooled
continuation counts. So an expression that neither class has seen says
nothing, a rare one little, and spellings related to toxic words something.

A text's evidence is the log-likelihood ratio of the classes, normalised by
length: its mean per byte over the text, and the highest of a single expression
over the square root of its length. A logistic curve fitted on labelled rows that the counts have
not seen turns both into a score between 0 and 1.

The model is fitted on a sample of the labelled documents that is bounded by
parameters: of each class at most ``max_rows`` documents with at most
``max_bytes`` bytes of text together. A class's ids fall into 256 slots by hash
and whole slots are taken in turn, each that still fits; so no row is ranked, no
class is gathered in a task, and a slot with a huge text or an id repeated
very often is passed over. Equal texts of a class count once. Every byte string
of the sample stays in the model: at most one a byte, which bounds what the
tasks receive. Scoring reads every text whole.

Defined cases: a null, empty or blank text scores by a mean and peak of 0;
labels with a null toxic value are ignored, of several for one document the
highest holds; where a class has no two labelled documents all scores are
the share of toxic labels (0 without labels). Repeated rows and other columns pass
through; a column called score, mean or peak is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored

SLOTS = 256


@dataclass(frozen=True)
class Options:
    order: int = 6
    max_rows: int = 8000
    max_bytes: int = 24 << 20
    held_back: int = 4  # one in so many labelled rows fits the curve


@dataclass
class Model:
    grams: np.ndarray  # sorted packed byte strings that a class has seen
    ratio: np.ndarray  # log P(toxic) - log P(ordinary) of the last byte after the others
    contexts: np.ndarray  # sorted packed contexts
    backoff: np.ndarray  # the same for a byte not seen after the context
    curve: np.ndarray  # bias, mean, peak, log length
    order: int

    def word_ratios(self, data, start, stop) -> tuple[np.ndarray, np.ndarray]:
        """(log ratio, bytes) of words."""
        gram, owner = W.packed_grams(data, start, stop, self.order)
        u, inv = np.unique(gram, return_inverse=True)
        back = W.looked_up(self.contexts, self.backoff, u >> np.uint64(8), np.float32(0))
        each = W.looked_up(self.grams, self.ratio, u, back)[inv.ravel()]
        n = len(start)
        return np.bincount(owner, each, n), np.bincount(owner, minlength=n)

    def evidence(self, chunk: W.Chunk) -> np.ndarray:
        """Rows x (1, mean, peak, log length)."""
        d = W.distinct_words(chunk)
        total, size = self.word_ratios(chunk.data, d.start, d.stop) if len(d.hash) else (np.zeros(0), np.zeros(0))
        out = np.zeros((chunk.rows, 4))
        out[:, 0] = 1
        if len(d.hash):
            t, s = total[d.inverse], size[d.inverse]
            length = np.bincount(chunk.row, s, chunk.rows)
            out[:, 1] = np.bincount(chunk.row, t, chunk.rows) / np.maximum(length, 1)
            has = np.flatnonzero(chunk.word_counts())
            first = np.searchsorted(chunk.row, has)
            out[has, 2] = np.maximum.reduceat(t / np.sqrt(s), first)
            out[:, 3] = np.log1p(length) / 10
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -40, 40)))


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.9))


def _per_context(grams: np.ndarray, counts: np.ndarray):
    """(contexts, total, kinds, context of each gram): contexts of sorted grams."""
    ctx, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    at = at.ravel()
    return ctx, np.bincount(at, counts, len(ctx)), np.bincount(at, counts > 0, len(ctx)), at


def _shared(grams: np.ndarray, order: int) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each gram's last byte one order down."""
    if order == 1:
        return np.full(len(grams), 1 / 256)
    lower, back = np.unique(grams & np.uint64((1 << (8 * (order - 1))) - 1), return_inverse=True)
    back = back.ravel()
    cont = np.bincount(back, minlength=len(lower)).astype(float)
    d = _discount(cont)
    _, total, kinds, at = _per_context(lower, cont)
    p = np.maximum(cont - d, 0) / total[at] + d * kinds[at] / total[at] * _shared(lower, order - 1)
    return p[back]


def _class_models(grams, toxic, ordinary, order):
    """(ratio per gram, contexts, backoff ratio per context)."""
    shared = _shared(grams, order)
    logs, lambdas, ctx = [], [], None
    for c in (toxic, ordinary):
        d = _discount(c)
        ctx, total, kinds, at = _per_context(grams, c)
        lam = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        own = np.where(total[at] > 0, np.maximum(c - d, 0) / np.maximum(total[at], 1), 0.0)
        logs.append(np.log(own + lam[at] * shared))
        lambdas.append(np.log(lam))
    return (logs[0] - logs[1]).astype(np.float32), ctx, (lambdas[0] - lambdas[1]).astype(np.float32)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> Model:
    """Model from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks."""
    spark = docs.sparkSession
    lab = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    seen = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    empty = Model(*nothing, *nothing, np.array([0.0, 0, 0, 0]), o.order)
    # without a logistic fit every text scores the share of toxic labels
    share = seen.get(1, 0) / max(sum(seen.values()), 1)
    empty.curve[0] = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
    if not (seen.get(0) and seen.get(1)):
        return empty
    # about max_rows ids of each class fall into the class's slots
    rate = F.when(F.col("toxic") == 1, min(1.0, o.max_rows / seen[1])).otherwise(min(1.0, o.max_rows / seen[0]))
    slot = F.floor(F.col("u") / rate * SLOTS).cast("int")
    lab = lab.withColumn("slot", slot).where(F.col("slot") < SLOTS).withColumn("slot", F.col("slot") + F.col("toxic") * SLOTS)
    sizes = lab.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per slot, here and below
    some = lab.where(F.col("slot").isin(_fitting({r["slot"]: (r["n"],) for r in sizes}, (o.max_rows,)))).select("doc_id", "toxic", "slot")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").withColumn("digest", F.xxhash64("text"))
    # one in held_back is held back, and of each class with two documents one is on either side
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(o.held_back)) == 0
    per = own.groupBy("slot", "doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    sizes = per.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.count_if(drawn).alias("n_held"), F.min("doc_id").alias("first")).collect()
    taken = _fitting({r["slot"]: (r["bytes"],) for r in sizes}, (o.max_bytes,))
    held = F.lit(False)
    for kind in (0, 1):
        rows = [r for r in sizes if r["slot"] in taken and r["slot"] // SLOTS == kind]
        n, n_held, first = sum(r["n"] for r in rows), sum(r["n_held"] for r in rows), min((r["first"] for r in rows), default=None)
        is_first = F.col("doc_id") == F.lit(first)
        side = is_first if n_held == 0 else ~is_first if n_held == n else drawn
        held = F.when(F.col("toxic") == kind, side & F.lit(n > 1)).otherwise(held)
    own = own.where(F.col("slot").isin(taken)).withColumn("held", held)

    def count(batches):
        for b in batches:
            toxic = b.column("toxic").to_numpy()
            for kind in (0, 1):
                mine = b.filter(pa.array(toxic == kind))
                for c in W.chunks(mine.column("text"), limit=4 << 20):
                    d = W.distinct_words(c)
                    gram, owner = W.packed_grams(c.data, d.start, d.stop, o.order)
                    u, inv = np.unique(gram, return_inverse=True)
                    n = np.bincount(inv.ravel(), d.count[owner], len(u)).astype(np.int64)
                    zero = np.zeros(len(u), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n if kind else zero), pa.array(zero if kind else n)], names=["gram", "toxic", "ordinary"])

    fitted = own.where("NOT held").dropDuplicates(["digest", "toxic"])
    grams = fitted.select("toxic", "text").mapInArrow(count, "gram bigint, toxic bigint, ordinary bigint")
    grams = grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    kept = stored(grams, "toxic-grams").toArrow()  # at most a row per byte of the sample
    if not kept.num_rows:
        return empty
    key = kept["gram"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, toxic, ordinary = key[order], kept["toxic"].to_numpy()[order], kept["ordinary"].to_numpy()[order]
    model = Model(key, *_class_models(key, toxic, ordinary, o.order), empty.curve, o.order)

    shipped = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for b in batches:
            y = b.column("toxic").to_numpy()
            for c in W.chunks(b.column("text")):
                e = shipped.value.evidence(c)
                yield pa.RecordBatch.from_arrays([pa.array(y[c.first : c.first + c.rows]), *map(pa.array, e.T.copy())], names=["toxic", "e0", "e1", "e2", "e3"])

    rows = own.where("held").select("toxic", "text").mapInArrow(evidence, "toxic int, e0 double, e1 double, e2 double, e3 double").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.stack([rows[f"e{i}"].to_numpy() for i in range(4)], axis=1)
        # weights restore the shares that the classes have among all labels
        w = np.where(y == 1, seen[1] / y.sum(), seen[0] / (len(y) - y.sum()))
        model.curve = _logistic(x, y, w * len(y) / w.sum())
    return model


def _fitting(sizes: dict[int, tuple[int, ...]], most: tuple[int, ...]) -> list[int]:
    """Slots taken in turn, class by class, each that still fits into ``most`` of its class."""
    taken, used = [], {}
    for slot in sorted(sizes):
        now = [a + b for a, b in zip(used.get(slot // SLOTS, [0] * len(most)), sizes[slot])]
        if all(a <= b for a, b in zip(now, most)):
            taken.append(slot)
            used[slot // SLOTS] = now
    return taken


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with columns score, mean and peak; every text is read whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("score", "mean", "peak")
    schema = T.StructType(own.schema.fields + [T.StructField(n, T.DoubleType()) for n in ("score", "mean", "peak")])

    def run(batches):
        m = shipped.value
        for b in batches:
            for c in W.chunks(b.column("text")):
                e = m.evidence(c)
                part = b.slice(c.first, c.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(e)), pa.array(e[:, 1].copy()), pa.array(e[:, 2].copy())], names=schema.names)

    return own.mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; all their columns keep their values."""
    others = [c for c in docs.columns if c != "text"]
    bare = docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    kept = score(bare, model).where(F.col("score") < threshold)
    return kept.select("text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)]).select(*[F.col(f"`{c}`") for c in docs.columns])
