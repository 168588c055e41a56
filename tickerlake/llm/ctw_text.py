"""Context-tree weighting over running texts: contexts go on through the blank into the words before.

The model is that of ``ctw``: the same trees, weights, classes and shares of
unseen bytes. Here a text is one string, a blank that carries the class, its
words with a blank after each, and the end; every byte is coded after the
``depth`` bytes before it, whatever words they belong to, back to the start.

A corpus has some hundred times more positions than distinct byte strings,
so no row stands for a position:

* Each task counts the byte strings of its texts and sends them, sorted and
  compressed, to ``slices``. All strings of a subtree (their contexts end in
  the same ``top`` bytes) lie in one slice; the slices add the counts up.
* Slices grow their subtrees under the tree that the driver has of the depths
  above, and store the log probabilities of their strings.
* Every task holds the ``max_grams`` most frequent strings and the
  ``max_frequent`` most frequent words and adds up what it finds there. What
  it does not find is asked for: a row per chunk of texts and group of slices
  has the strings, and the texts that each stands in. The group answers with
  a row of sums per text, and a chunk adds its answers up.

Both bounds are of what a task holds; every string is counted, grown and
scored. Words (for the base score) are told apart by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.ctw import END, Options, Tree, _by_class, _counted, _mask, _nothing, cutoff, grow, levels_of, roots
from tickerlake.llm.tables import stored

PIECE = 1 << 18  # bytes of text that arrays are made of at once
_SQUEEZE = zstandard.ZstdCompressor(level=1)
_SQUEEZE_MORE = zstandard.ZstdCompressor(level=3)
_UNPACK = zstandard.ZstdDecompressor()


# --- bytes of sorted keys and numbers -------------------------------------------


def _small(raw) -> bytes:
    return _SQUEEZE.compress(raw)


def _repeated(x: np.ndarray) -> bytes:
    """Numbers of which many are alike as a whole, compressed."""
    return _SQUEEZE_MORE.compress(np.ascontiguousarray(x).tobytes())


def _whole(packed: bytes) -> bytes:
    return _UNPACK.decompress(packed)


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return _small(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_whole(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _turned(gram: np.ndarray) -> np.ndarray:
    """Grams with the nearest byte of the context first and their own byte last: subtrees lie together."""
    back = gram.byteswap()
    return (back << np.uint64(8)) | (back >> np.uint64(56))


def _returned(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(8)) | (key << np.uint64(56))).byteswap()


def _slice_of(key: np.ndarray, o: Options) -> np.ndarray:
    """Slice of turned grams: one for all strings of a subtree."""
    top = np.uint64(64 - 8 * min(o.top, o.depth))
    return (W.mix(key >> top) % np.uint64(o.slices)).astype(np.uint16)


def _word_slice(h: np.ndarray, o: Options) -> np.ndarray:
    return (W.mix(h) % np.uint64(o.slices)).astype(np.uint16)


def _dealt(key: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(part, range, order) of sorted keys, part by part."""
    order = np.argsort(part, kind="stable")
    own = part[order]
    edge = np.flatnonzero(np.diff(own)) + 1 if len(own) else own
    for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(own)], strict=True):
        if z > a:
            yield int(own[a]), slice(a, z), order


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _times(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands there."""
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.diff(np.append(first, len(key)))


# --- counts --------------------------------------------------------------------


class _Counter:
    """Counts of keys that come in any order; those that wait are counted by ``fold``."""

    def __init__(self):
        self.waiting, self.size = [], 0
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray) -> None:
        self.waiting.append(key)
        self.size += len(key)

    def fold(self) -> None:
        if self.size:
            key, n = _times(np.concatenate(self.waiting))
            self.waiting, self.size = [], 0
            self.key, self.n = _summed(np.concatenate([self.key, key]), np.concatenate([self.n, n])) if len(self.key) else (key, n)


WORDS = -2  # the class that stands for words, counted over all training rows; HEARD: words of other rows
HEARD = -3


def _count(o: Options):
    schema = pa.schema([("slice", pa.int32()), ("cls", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def emit(counters: dict[int, _Counter]) -> Iterator[pa.RecordBatch]:
        for cls, c in counters.items():
            c.fold()
            part = (_word_slice if cls <= WORDS else _slice_of)(c.key, o)
            cols: list[list] = [[], [], [], []]
            for p, own, order in _dealt(c.key, part):
                at = order[own]
                for col, x in zip(cols, (p, cls, _packed(c.key[at]), _packed(c.n[at])), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, schema.types, strict=True)], schema=schema)
        counters.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, _Counter] = {}
        for b in batches:
            cls = b.column("cls").to_numpy()
            for k in np.unique(cls).tolist():
                for c in W.chunks(b.column("text").filter(pa.array(cls == k)), limit=PIECE):
                    grams, _ = W.running_grams(c, o.depth + 1, END)
                    counters.setdefault(k, _Counter()).add(_turned(grams))
                    counters.setdefault(WORDS if k >= 0 else HEARD, _Counter()).add(c.hash)
                    if sum(x.size for x in counters.values()) >= o.chunk // 2:
                        for x in counters.values():
                            x.fold()
            if sum(len(x.key) for x in counters.values()) > o.chunk // 2:
                yield from emit(counters)
        yield from emit(counters)

    return run


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of batches sorted by slice, slice by slice."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["slice"] != now and held:
                yield now, held
                held = []
            now = r["slice"]
            held.append(r)
    if held:
        yield now, held


_COUNTS = "slice int, n_grams bigint, grams binary, n binary, words binary, word_n binary"
_COUNTS_ARROW = pa.schema([("slice", pa.int32()), ("n_grams", pa.int64()), ("grams", pa.binary()), ("n", pa.binary()), ("words", pa.binary()), ("word_n", pa.binary())])


def _added(classes: int):
    """Sorted by slice: (grams, n by class, words, n) of each slice."""

    def matrix(rows: list[dict], classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        keys = [_unpacked(r["keys"], np.uint64) for r in rows]
        if not keys:
            return np.zeros(0, np.uint64), np.zeros((len(classes), 0), np.int64)
        all_ = np.unique(np.concatenate(keys))
        n = np.zeros((len(classes), len(all_)), np.int64)
        for k, cls in enumerate(classes):
            own = [i for i, r in enumerate(rows) if r["cls"] == cls]
            if own:
                key, sums = _summed(np.concatenate([keys[i] for i in own]), np.concatenate([_unpacked(rows[i]["n"], np.int64) for i in own]))
                n[k, np.searchsorted(all_, key)] = sums
        return all_, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_slice(batches):
            gram, n = matrix([r for r in rows if r["cls"] > WORDS], list(range(classes)))
            word, times = matrix([r for r in rows if r["cls"] <= WORDS], [WORDS])
            cols = [s, len(gram), _packed(gram), _packed(n.ravel()), _packed(word), _packed(times.ravel())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cols, _COUNTS_ARROW.types, strict=True)], schema=_COUNTS_ARROW)

    return run


def counts(docs: DataFrame, classes: int, o: Options) -> DataFrame:
    """A row per slice: its byte strings with their training counts by class, and its words with theirs.

    Rows of class -1 are no training rows: what stands in them is listed, not counted.
    """
    rows = docs.select("text", "cls").mapInArrow(_count(o), "slice int, cls int, keys binary, n binary")
    return rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(_added(classes), _COUNTS)


# --- the tree ------------------------------------------------------------------


def _slices_of(batches: Iterator[pa.RecordBatch], classes: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]]:
    """(slice of each gram, grams, n by class, [(slice, words, n)]) of whole slices, at least ``least`` grams at once."""
    held: list[tuple] = []
    words: list[tuple] = []
    size = 0

    def together():
        return *(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)), words

    for b in batches:
        for r in b.to_pylist():
            gram = _returned(_unpacked(r["grams"], np.uint64))
            held.append((np.full(len(gram), r["slice"], np.int32), gram, _unpacked(r["n"], np.int64).reshape(classes, -1)))
            words.append((r["slice"], r.get("words"), r.get("word_n")))
            size += len(gram)
            if size >= least:
                yield together()
                held, words, size = [], [], 0
    if held:
        yield together()


def _floor(rows: DataFrame, column: str, classes: int, most: int) -> int:
    """Least training count of the at most ``most`` strings or words that every task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(column).to_pylist():
                n = np.minimum(_unpacked(x, np.int64).reshape(classes, -1).sum(0), 10_000)
                f, k = np.unique(n[n > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(k)], names=["f", "k"])

    return cutoff(rows.select(column).mapInArrow(run, "f bigint, k bigint").groupBy("f").agg(F.sum("k").alias("k")), most)


_PROBS = "slice int, words binary, word_n binary, often binary, often_lp binary, rare binary, rare_lp binary"
_PROBS_ARROW = pa.schema([("slice", pa.int32()), *[(c, pa.binary()) for c in ("words", "word_n", "often", "often_lp", "rare", "rare_lp")]])


def probabilities(rows: DataFrame, classes: int, floor: int, o: Options) -> DataFrame:
    """The rows of ``counts`` with log10 P by class: of the grams of at least ``floor`` training counts, and of all others."""
    spark = rows.sparkSession
    top = min(o.top, o.depth)
    names = [f"n_{k}" for k in range(classes)]

    def heads(batches):
        for _, gram, n, _ in _slices_of(batches, classes, o.piece):
            u, inv = np.unique(gram & _mask(top), return_inverse=True)
            sums = [np.bincount(inv.ravel(), x, len(u)).astype(np.int64) for x in n]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, sums)], names=["gram", *names])

    def climb(batches):
        for _, gram, n, _ in _slices_of(batches, classes, o.piece):
            gram, n = _counted(gram, n)
            if len(gram):
                key, total = roots(*levels_of(gram, n, top, o.depth), top)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total)], names=["node", "total"])

    grams = rows.select("slice", "grams", "n")
    head = grams.mapInArrow(heads, "gram bigint, " + ", ".join(f"{c} bigint" for c in names))
    head = head.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # strings of at most ``top`` bytes
    gram, n = _counted(head["gram"].to_numpy().view(np.uint64), np.stack([head[c].to_numpy() for c in names]))
    tree = _nothing()
    if len(gram):
        under = grams.mapInArrow(climb, "node bigint, total double").groupBy("node").agg(F.sum("total").alias("total")).toArrow()
        node, total = under["node"].to_numpy().view(np.uint64), under["total"].to_numpy()
        order = np.argsort(node)
        tree = grow(*levels_of(gram, n, 0, top - 1), under=(node[order], total[order]))
    shipped = spark.sparkContext.broadcast(tree)

    def judge(batches):
        for of, asked, n, words in _slices_of(batches, classes, o.piece):
            lp = _logs(asked, n, shipped.value, top, o) if len(asked) else np.zeros((classes, 0), np.float32)
            often = n.sum(0) >= floor
            for s, word, word_n in words:
                own = of == s
                cols: list = [s, word, word_n]
                for at in (np.flatnonzero(own & often), np.flatnonzero(own & ~often)):
                    cols += [_packed(_turned(asked[at])), _repeated(lp[:, at])]
                yield _row(_PROBS_ARROW, *cols)

    return rows.mapInArrow(judge, _PROBS)


def _logs(asked: np.ndarray, n: np.ndarray, above: Tree, top: int, o: Options) -> np.ndarray:
    """log10 P of the last byte of each gram by class, float32; whole subtrees."""
    gram, times = _counted(asked, n)
    own = grow(*levels_of(gram, times, top, o.depth), first=top, above=above) if len(gram) else above
    led, each = _by_class(asked, len(n))
    lp = np.empty((len(n), len(asked)))
    lp[:, ~led] = own.log10(asked[~led])
    for k in range(len(n)):
        lp[k][led] = own.log10(each[k][led])
    return lp.astype(np.float32)


# --- scores --------------------------------------------------------------------


class _Table:
    """Rows of values by their keys, found by the leading bits of the keys' hashes; absent keys have zeros."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys = np.append(keys[order], np.uint64(0))
        self.values = np.zeros((len(keys) + 1, *values.shape[1:]), values.dtype)
        for k in range(values.shape[1]):  # a column at a time: the whole is large
            self.values[:-1, k] = values[:, k][order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << self.bits))]).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (W.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each, the last one where it is absent."""
        bucket = self._bucket(wanted)
        at = np.take(self.first, bucket, mode="clip")
        met = np.take(self.keys, at, mode="clip") == wanted
        out = np.where(met, at, np.int32(len(self.keys) - 1))
        todo = np.flatnonzero(~met)
        at, end, wanted = at[todo] + 1, np.take(self.first, bucket[todo] + 1, mode="clip"), wanted[todo]
        while len(todo):
            on = np.flatnonzero(at < end)
            todo, at, end, wanted = todo[on], at[on], end[on], wanted[on]
            met = np.take(self.keys, at, mode="clip") == wanted
            out[todo[met]] = at[met]
            on = np.flatnonzero(~met)
            todo, at, end, wanted = todo[on], at[on] + 1, end[on], wanted[on]
        return out


class _Shipped:
    """A ``_Table`` in packed parts: the driver passes them on, every worker unpacks them once."""

    def __init__(self, keys: list[bytes], values: list[bytes], kind: str, each: int):
        self.parts = keys, values, kind, each

    def __reduce__(self):
        return _of_parts, self.parts


def _of_parts(keys: list[bytes], values: list[bytes], kind: str, each: int) -> _Table:
    key = [_unpacked(x, np.uint64) for x in keys]
    out = [np.frombuffer(_whole(x), kind).reshape(each, -1) for x in values]
    return _Table(np.concatenate([np.zeros(0, np.uint64), *key]), np.concatenate([np.zeros((each, 0), kind), *out], axis=1).T)


def _asked(pairs: list[tuple[np.ndarray, np.ndarray]], of, o: Options) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Per group of slices: keys, how many texts each has, the texts; from (key, text) pairs, one by one."""
    if not pairs:
        return {}
    key, text = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(key, kind="stable")
    key, text = key[order], text[order]
    out = {}
    for p, own, by in _dealt(key, of(key, o) % np.uint16(o.groups)):
        at = by[own]
        k = key[at]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[p] = _packed(k[first]), _packed(np.diff(np.append(first, len(k))).astype(np.int32)), _packed(text[at].astype(np.uint16))
    return out


TABLE, ASK, TEXTS = 0, 1, 2
_BLOBS = ["a", "b", "c", "d", "e", "f"]
_ROWS = "part int, kind int, chunk bigint, texts int, " + ", ".join(f"{c} binary" for c in _BLOBS)
_ROWS_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("texts", pa.int32()), *[(c, pa.binary()) for c in _BLOBS]])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, schema.types, strict=True)], schema=schema)


def _ipc(columns: dict) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return _small(sink.getvalue())


def _scan(table, classes: int, z: float, buckets: int, o: Options):
    """Texts -> what they have at hand (a row per chunk), and what they ask for (a row per chunk and group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = table.value
        lp, word_n = grams.values, words.values[:, 0]
        word_base = np.where(word_n > 0, np.log10((word_n + 0.1) / z), 0.0)
        number = TaskContext.get().partitionId() << 32
        state: dict = {}

        def begin():
            state.update(texts=0, positions=0, grams=[], words=[], cols=[])

        def end():
            cols = [np.concatenate(x, axis=0) for x in zip(*(c[2:] for c in state["cols"]), strict=True)]
            own = {c: pa.concat_arrays([x[i] for x in state["cols"]]) for i, c in enumerate(("doc_id", "held_out"))}
            own |= dict(zip(("tokens", "known", "base", "bytes"), map(pa.array, cols), strict=False))
            own |= {f"lp_{k}": pa.array(np.ascontiguousarray(cols[4][:, k])) for k in range(classes)}
            g, w = _asked(state["grams"], _slice_of, o), _asked(state["words"], _word_slice, o)
            ask = sorted(g.keys() | w.keys())
            none = (None, None, None)
            # of its rows, so that rows of a repeated task with its texts in another order are not mixed up
            same = np.bitwise_xor.reduce(W.mix(np.frombuffer(np.ascontiguousarray(cols[4]).tobytes(), np.uint64) + np.arange(cols[4].size, dtype=np.uint64)))
            chunk = int(W.combine(np.array([number], np.uint64), np.array([same], np.uint64)).view(np.int64)[0])
            b = chunk % buckets
            yield _row(_ROWS_ARROW, b * o.groups + chunk % o.groups, TEXTS, chunk, len(ask), _ipc(own), *[None] * 5)
            for p in ask:
                yield _row(_ROWS_ARROW, b * o.groups + p, ASK, chunk, state["texts"], *g.get(p, none), *w.get(p, none))
            begin()

        begin()
        for b in batches:
            for c in W.chunks(b.column("text"), limit=PIECE):
                if state["texts"] + c.rows > 65_535 or state["positions"] >= o.chunk:
                    yield from end()
                    number += 1
                first = state["texts"]
                gram, size = W.running_grams(c, o.depth + 1, END)
                gram = _turned(gram)
                starts = np.cumsum(size) - size
                at = grams.find(gram)
                sums = np.add.reduceat(np.take(lp, at, axis=0, mode="clip"), starts, axis=0, dtype=np.float64)
                miss = np.flatnonzero(at == len(lp) - 1)
                state["grams"].append((gram[miss], first + np.searchsorted(starts, miss, side="right") - 1))
                at = words.find(c.hash)
                miss = np.flatnonzero(at == len(word_n) - 1)
                state["words"].append((c.hash[miss], first + c.row[miss]))
                known = np.bincount(c.row, np.take(word_n, at) > 0, c.rows).astype(np.int64)
                own = b.slice(c.first, c.rows)
                state["cols"].append((own.column("doc_id"), own.column("held_out"), c.word_counts() + 1, known, np.bincount(c.row, np.take(word_base, at), c.rows), size, sums))
                state["texts"] += c.rows
                state["positions"] += len(gram)
        if state["texts"]:
            yield from end()

    return run


def _tables(classes: int, buckets: int, floor: int, o: Options):
    """Slices of ``probabilities`` and ``counts`` -> what the groups look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                word, n = _unpacked(r["words"], np.uint64), _unpacked(r["word_n"], np.int64)
                few = n < floor
                for k in range(buckets):
                    yield _row(_ROWS_ARROW, k * o.groups + r["slice"] % o.groups, TABLE, None, None, r["rare"], r["rare_lp"], _packed(word[few]), _packed(n[few]), None, None)

    return run


_ANSWERS = "chunk bigint, texts int, own binary, sums binary"
_ANSWERS_ARROW = pa.schema([("chunk", pa.int64()), ("texts", pa.int32()), ("own", pa.binary()), ("sums", pa.binary())])


def _answer(classes: int, z: float, o: Options):
    """Sorted by part and kind: the sums that the texts of a chunk asked for (log10 P by class, base score, known words)."""

    def met(keys: np.ndarray, r: dict, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        wanted, times, text = (_unpacked(r[c], k) for c, k in zip(cols, (np.uint64, np.int32, np.uint16), strict=True))
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        if len(wanted) and not (len(keys) and (keys[at] == wanted).all()):
            raise RuntimeError("a string of a text is not in the counts: the input changed while it was read")
        return np.repeat(at, times), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    part, held, ready = r["part"], [], None
                if r["kind"] == TABLE:
                    held.append((_unpacked(r["a"], np.uint64), np.frombuffer(_whole(r["b"]), np.float32).reshape(classes, -1), _unpacked(r["c"], np.uint64), _unpacked(r["d"], np.int64)))
                    continue
                if r["kind"] == TEXTS:
                    yield _row(_ANSWERS_ARROW, r["chunk"], r["texts"], r["a"], None)
                    continue
                if ready is None:
                    key, lp, word, n = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
                    by, at = np.argsort(key), np.argsort(word)
                    ready, held = (key[by], lp[:, by].astype(np.float64), word[at], n[at]), []
                key, lp, word, n = ready
                sums = np.zeros((classes + 2, r["texts"]))
                if r["a"] is not None:
                    at, text = met(key, r, ["a", "b", "c"])
                    for k in range(classes):
                        sums[k] = np.bincount(text, lp[k][at], r["texts"])
                if r["d"] is not None:
                    at, text = met(word, r, ["d", "e", "f"])
                    own = n[at]
                    sums[classes] = np.bincount(text, np.where(own > 0, np.log10((own + 0.1) / z), np.log10(0.1 / z)), r["texts"])
                    sums[classes + 1] = np.bincount(text, own > 0, r["texts"])
                yield _row(_ANSWERS_ARROW, r["chunk"], r["texts"], None, _small(sums.tobytes()))

    return run


def _texts_of(classes: int):
    """Sorted by chunk, its texts first: their rows with the answers added."""
    lps = [f"lp_{k}" for k in range(classes)]

    def whole(own: pa.RecordBatch, left: int, sums: np.ndarray) -> pa.RecordBatch:
        if left:
            raise RuntimeError("answers to a chunk are missing: the input changed while it was read")
        named = {c: own.column(c) for c in ("doc_id", "held_out", "tokens")}
        named["known"] = pa.array(np.asarray(own.column("known")) + np.rint(sums[classes + 1]).astype(np.int64))
        named["base"] = pa.array(np.asarray(own.column("base")) + sums[classes])
        named["bytes"] = own.column("bytes")
        named |= {c: pa.array(np.asarray(own.column(c)) + sums[k]) for k, c in enumerate(lps)}
        return pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk = sums = None
        left = 0
        for b in batches:
            for r in b.to_pylist():
                if r["own"] is not None:
                    if own is not None:
                        yield whole(own, left, sums)
                    own = pa.ipc.open_stream(_whole(r["own"])).read_next_batch()
                    chunk, left, sums = r["chunk"], r["texts"], np.zeros((classes + 2, own.num_rows))
                else:
                    if r["chunk"] != chunk:
                        raise RuntimeError("answers without their chunk: the input changed while it was read")
                    sums += np.frombuffer(_whole(r["sums"])).reshape(sums.shape)
                    left -= 1
        if own is not None:
            yield whole(own, left, sums)

    return run


def _words_at_hand(rows: DataFrame, floor: int) -> DataFrame:
    """(k, v): the words of at least ``floor`` training counts of each slice, and these counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("words").to_pylist(), b.column("word_n").to_pylist(), strict=True):
                word, n = _unpacked(x, np.uint64), _unpacked(y, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (_packed(word[n >= floor]), _repeated(n[n >= floor]))], names=["k", "v"])

    return rows.select("words", "word_n").mapInArrow(run, "k binary, v binary")


def _shipped(rows: DataFrame, kind: str, each: int) -> _Shipped:
    got = rows.toArrow()
    return _Shipped(got["k"].to_pylist(), got["v"].to_pylist(), kind, each)


def score(texts: DataFrame, ends: list[int], o: Options) -> tuple[DataFrame, int, int, float]:
    """(rows, training words, training texts, z): rows (doc_id, held_out, tokens, known, base, bytes, lp_0 .. lp_k) of ``texts`` (doc_id, text, held_out, cls), priors included."""
    spark, classes, n_docs = texts.sparkSession, len(ends), sum(ends)
    listed = stored(counts(texts, classes, o), "ctw-counts")

    def sizes(batches):
        for b in batches:
            for x, y in zip(b.column("n").to_pylist(), b.column("word_n").to_pylist(), strict=True):
                n = _unpacked(y, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (_unpacked(x, np.int64).sum(), n.sum(), (n > 0).sum())], names=["positions", "total", "kinds"])

    positions, total, kinds = (int(x or 0) for x in listed.select("n", "word_n").mapInArrow(sizes, "positions bigint, total bigint, kinds bigint").agg(F.sum("positions"), F.sum("total"), F.sum("kinds")).first())
    z = total + n_docs + 0.1 * (kinds + (n_docs > 0) + 1)
    prior = np.log10((np.array(ends) + 0.5) / (n_docs + 0.5 * classes))
    end_base, end_known = float(np.log10((n_docs + 0.1) / z)), int(n_docs > 0)

    probs = stored(probabilities(listed, classes, _floor(listed, "n", classes, o.max_grams), o), "ctw-probabilities")
    floor = _floor(listed, "word_n", 1, o.max_frequent)
    often = _shipped(probs.select(F.col("often").alias("k"), F.col("often_lp").alias("v")), "<f4", classes)
    table = spark.sparkContext.broadcast((often, _shipped(_words_at_hand(listed, floor), "<i8", 1)))

    buckets = 1 + positions // o.bucket
    asked = texts.select("doc_id", "text", "held_out").mapInArrow(_scan(table, classes, z, buckets, o), _ROWS)
    tables = probs.select("slice", "words", "word_n", "rare", "rare_lp").mapInArrow(_tables(classes, buckets, floor, o), _ROWS)
    dealt = asked.unionByName(tables).repartition(buckets * o.groups, "part").sortWithinPartitions("part", "kind")
    answers = dealt.mapInArrow(_answer(classes, z, o), _ANSWERS)
    kind = "doc_id bigint, held_out boolean, tokens bigint, known bigint, base double, bytes bigint, " + ", ".join(f"lp_{k} double" for k in range(classes))
    rows = answers.repartition("chunk").sortWithinPartitions("chunk", F.col("own").isNull()).mapInArrow(_texts_of(classes), kind)
    rows = rows.withColumns({"known": F.col("known") + end_known, "base": F.col("base") + end_base, **{f"lp_{k}": F.col(f"lp_{k}") + float(prior[k]) for k in range(classes)}})
    return rows, total, n_docs, z
