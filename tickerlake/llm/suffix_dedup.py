"""Removal of byte strings that stand more than once, by suffix arrays.

A byte goes when a string of ``length`` bytes (400) covers it that starts
anywhere else, in another text or in the same one. Strings are judged on the
input, never across the end of a text; overlaps count.

How it scales
-------------
A suffix array over a whole corpus is one sequential job, so the suffixes are
dealt out first and each task builds an array of what it holds:

* Every string of ``length`` bytes (a *window*) has a least 32-byte gram, its
  *anchor* (ties: the leftmost). It depends on the window's bytes alone, so
  equal windows have equal anchors at equal offsets. Neighbouring windows
  share an anchor; one row stands for them: the gram's hash (key), the range
  of offsets, and a hash of the bytes they cover together (context).
* Equal contexts are folded into one row with a count on the map side. A
  context found twice is repeated as a whole; one whose key is found once is
  unique. Only the rest, the edges of repeated regions, needs bytes.
* Contexts of one key meet in one task. The bytes right of the anchor, and
  those left of it read backwards, are cut into blocks; blocks are numbered
  in byte order, and all strings of a batch are put one after the other.
  ``linear_grouping`` builds the suffix array of that string. In its order,
  strings that agree on n bytes are neighbours, so a window of offset o is
  told by two ranges: of right sides that agree on ``length`` - o bytes and
  of left sides that agree on o. Windows with the same two ranges are equal.
* A key with more than ``limit`` distinct contexts is not gathered: its
  windows are counted by hash. They are dealt by their hashes as arrays, a
  row per chunk of contexts and part, not per window; a part sends each chunk
  the windows that it met twice. This is exact too.
* Anchors, folded contexts and sides are read more than once. They are kept on
  the executors' disks and let go when the spans are stored: as files of the
  shared folder they would cost a ``chmod`` process for each file on a local one.

``linear_grouping`` (no recursion, no renaming): suffixes start in groups of
their first symbol. Groups are taken in descending order. For each member the
nearest suffix to its left in a lower group is its previous-smaller pointer;
suffixes that are pointed at leave their group for a new one right behind it,
those with more pointers behind those with fewer. At the end a group holds
the suffixes that begin with one and the same Lyndon word. The second pass
goes through the array from its start; the suffix before each entry, and what
its pointers lead to, take the first free place of their groups.

Defined cases: a null or empty text has no bytes and loses none; texts shorter
than ``length`` lose nothing; repeated rows and ties count as copies, whatever
their doc_id (null included); invalid cuts inside a character are possible, so
what is kept is binary; extra columns pass through ``cut`` unchanged, also when
they are named like a result of ``spans_of``; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored, with_small
from tickerlake.session import keep

GRAM = 32  # bytes of an anchor
BLOCK = 80  # bytes of a symbol; divides LENGTH
LENGTH = 400
SLICE = 1 << 18  # bytes whose windows are looked at together: their arrays stay near the core
BATCH = 8192  # contexts of one suffix array, unless one key has more
LIMIT = 4096  # distinct contexts of a key that meet in one task
PART = 1 << 23  # windows by hash that meet in one task, at most


# --- the suffix array ---------------------------------------------------------


def linear_grouping(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a string of integers (module docstring)."""
    s = np.asarray(symbols, np.int64)
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    places = (order + 1).tolist()  # suffixes count from 1; 0 stands for "none"
    edges = [0, *cuts.tolist(), n]
    members = [places[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    size = [len(m) for m in members]
    behind = [*range(1, len(members)), -1]
    before = list(range(-1, len(members) - 1))
    group = [0] * (n + 1)
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    pointer = _group_by_lyndon_words(group, members, size, behind, before)
    return _emit(n, group, size, behind, pointer)


def _group_by_lyndon_words(group: list, members: list, size: list, behind: list, before: list) -> list:
    """Refine the groups in descending order; returns the previous-smaller pointers."""
    left = list(range(len(group)))  # the nearest suffix, itself or to the left, whose group is still to come
    pointer = [0] * len(group)
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) != size[g]:
            own = members[g] = [i for i in own if group[i] == g]
        for i in own:
            left[i] = i - 1
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            q = left[p]
            while q != p:  # path halving
                left[p] = left[q]
                p = left[p]
                q = left[p]
            pointer[i] = p
            if p:
                pointed[p] = pointed.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moved.setdefault((times, group[p]), []).append(p)
        for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            leaving, old = moved[key], key[1]
            if len(leaving) == size[old]:
                continue  # the whole group would move right behind its empty self
            new = len(members)
            members.append(leaving)
            size.append(len(leaving))
            size[old] -= len(leaving)
            follower = behind[old]
            behind.append(follower)
            before.append(old)
            behind[old] = new
            if follower >= 0:
                before[follower] = new
            for p in leaving:
                group[p] = new
        g = before[g]
    return pointer


def _emit(n: int, group: list, size: list, behind: list, pointer: list) -> np.ndarray:
    """Order inside the groups, in one pass over the array while it fills."""
    free = [0] * len(size)
    g, at = 0, 0
    while g >= 0:
        free[g] = at
        at += size[g]
        g = behind[g]
    out = [0] * n
    placed = bytearray(n + 1)
    placed[0] = 1
    j = n  # the suffix before the end comes first
    for x in range(n + 1):
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = pointer[j]
        if x < n:
            j = out[x] - 1
    return np.asarray(out, np.int64) - 1


# --- anchors ------------------------------------------------------------------


def _hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    power, inverse = W._power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums, inverse


def _hash_of(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix((sums[stop] - sums[start]) * inverse[start])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, anchor, least offset, largest offset, key, context) of texts that lie one after the other.

    Offset o of an anchor at p is the window that starts at p - o.
    """
    n, width = len(data), length - GRAM + 1
    count = n - length + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, inverse = _hash_sums(data)
    with np.errstate(over="ignore"):
        grams = W.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    ranked = (grams & ~low) | np.arange(n - GRAM + 1, dtype=np.uint64)  # ties: the leftmost
    full = np.concatenate([ranked, np.full(-len(ranked) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)
    start = np.arange(count)
    size = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), size)[:count]
    inside = start + length <= np.repeat(ends, size)[:count]
    start, least, row = start[inside], least[inside], row[inside]
    if not len(start):
        return anchors(data[:0], ends[:0], length)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    p = least[first]
    high, small = p - start[first], p - start[last]
    context = _hash_of(sums, inverse, p - high, p - small + length)
    with np.errstate(over="ignore"):  # the same bytes under another range of offsets are another context
        context = W.combine(context, (small.astype(np.uint64) << np.uint64(10)) | high.astype(np.uint64))
    return row[first], p, small, high, grams[p], context


_PLACE = 1 << 18  # a place packs the anchor's position and two offsets under 512


def _anchor_rows(length: int):
    schema = pa.schema([("t", pa.int64()), ("size", pa.int32()), ("place", pa.int64()), ("key", pa.int64()), ("context", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = W.text_buffers(b.column("text"))
            t = np.asarray(b.column("t"))
            for i, j in W.spans(offs, SLICE):
                a, z = int(offs[i]), int(offs[j])
                for c in range(a, max(z - length + 1, a + 1), SLICE):
                    stop = z if j > i + 1 else min(z, c + SLICE + length - 1)
                    row, p, small, high, key, context = anchors(raw[c:stop], np.minimum(offs[i + 1 : j + 1], stop) - c, length)
                    r = i + row
                    place = (p + c - offs[r]) * _PLACE + small * 512 + high
                    size = (offs[r + 1] - offs[r]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[r], size, place, key.view(np.int64), context.view(np.int64))], schema=schema)
                    if j > i + 1:
                        break

    return run


# --- comparing contexts -------------------------------------------------------


def _ranks(blocks: np.ndarray) -> np.ndarray:
    """Dense numbers of the rows of a byte matrix, in byte order."""
    parts = np.ascontiguousarray(blocks).view(">u8").astype(np.uint64)
    out = np.unique(parts[:, 0], return_inverse=True)[1].ravel().astype(np.int64)
    for k in range(1, parts.shape[1]):
        own = np.unique(parts[:, k], return_inverse=True)[1].ravel().astype(np.int64)
        out = np.unique(out * (int(own.max()) + 1) + own, return_inverse=True)[1].ravel().astype(np.int64)
    return out


def _agreeing(sides: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Bytes that each row of ``sides`` shares with the one before it in ``order``; -1 for another key."""
    out = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 4096):
        now, was = order[a : a + 4096], order[a - 1 : a - 1 + len(order[a : a + 4096])]
        differ = sides[now] != sides[was]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), sides.shape[1])
        out[a : a + len(now)] = np.where(key[now] == key[was], shared, -1)
    return out


def repeated_offsets(key: np.ndarray, small: np.ndarray, high: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix (context, offset): whether that window of the context stands more than once.

    ``left`` (backwards from the anchor) and ``right`` are byte matrices of
    one width, filled up with zeros; the width is the length of a window.
    """
    m, length = right.shape
    per = length // BLOCK
    keys = np.unique(key, return_inverse=True)[1].ravel().astype(np.int64)
    ranks = _ranks(np.concatenate([right, left]).reshape(-1, BLOCK)).reshape(2 * m, per) + 1
    base = int(ranks.max()) + 1
    text = np.zeros((2 * m, per + 2), np.int64)  # key, blocks, end
    text[:, 0] = base + np.concatenate([keys, keys + int(keys.max()) + 1])  # right and left sides apart
    text[:, 1:-1] = ranks
    array = linear_grouping(text.ravel())
    sides = array[array % (per + 2) == 0] // (per + 2)  # strings in byte order, key by key
    rank, shared = [], []
    for order, side in ((sides[sides < m], right), (sides[sides >= m] - m, left)):
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        rank.append(place)
        shared.append(_agreeing(side, order, key))
    out = np.zeros((m, length), bool)
    for o in range(int(small.min()), int(high.max()) + 1):
        at = np.flatnonzero((small <= o) & (o <= high))
        ranges = [np.cumsum(shared[0] < length - o)[rank[0][at]], np.cumsum(shared[1] < o)[rank[1][at]]]
        both = ranges[0] * (m + 1) + ranges[1]
        by = np.argsort(both, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(both[by]) != 0])) if len(by) else by
        total = np.add.reduceat(times[at][by], edge) if len(by) else by
        out[at[by], o] = np.repeat(total, np.diff(np.append(edge, len(by)))) > 1
    return out


_PIECES = "t bigint, size int, start bigint, stop bigint"
_PIECES_ARROW = pa.schema([("t", pa.int64()), ("size", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])


def _pieces(t: np.ndarray, size: np.ndarray, place: np.ndarray, flags: np.ndarray, length: int) -> pa.RecordBatch:
    """(t, size, start, stop) of the bytes that the flagged windows (context, offset) cover, a row per run of offsets."""
    edged = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edged[:, 1:-1] = flags
    turns = np.diff(edged, axis=1)
    row, low = np.nonzero(turns == 1)
    high = np.nonzero(turns == -1)[1] - 1
    p = place[row] // _PLACE
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((t[row], size[row], p - high, p - low + length), _PIECES_ARROW.types, strict=True)], schema=_PIECES_ARROW)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    raw, offs = W.text_buffers(column)
    out = np.zeros((len(offs) - 1, width), np.uint8)
    place, owner = W.ragged(np.zeros(len(out), np.int64), np.diff(offs))
    out[owner, place] = raw[offs[0] : offs[-1]]
    return out


def _compared(length: int):
    """Sorted by key: batches of whole keys through ``repeated_offsets``; pieces of contexts that stand once."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        b = table.combine_chunks().to_batches()[0]
        col = {c: np.asarray(b.column(c)) for c in ("t", "size", "place", "key", "times")}
        rest = col["place"] % _PLACE
        sides = [_matrix(b.column(c), length) for c in ("left", "right")]
        flags = repeated_offsets(col["key"], rest // 512, rest % 512, col["times"], *sides)
        once = np.flatnonzero(col["times"] == 1)
        return _pieces(col["t"][once], col["size"][once], col["place"][once], flags[once], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows < BATCH:
                continue
            key = np.asarray(held.column("key"))
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _contexts(length: int):
    """Texts with their wanted contexts -> (t, size, place, key, context, times, crowded, left, right)."""
    names = ["place", "key", "context", "times", "crowded"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    schema = pa.schema([("t", pa.int64()), ("size", pa.int32()), *zip(names, kinds, strict=True), ("left", pa.binary()), ("right", pa.binary())])

    def cut_out(texts: list[bytes], t: list[int], size: list[int], rows: pa.StructArray, owner: np.ndarray) -> pa.RecordBatch:
        """Contexts with their sides; ``owner`` is the text of each."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        cols = [rows.field(c).cast(k) for c, k in zip(names, kinds, strict=True)]
        p, rest = np.divmod(np.asarray(cols[0]), _PLACE)
        p += ends[owner] - np.array(size)[owner]
        left, right = rest % 512, np.minimum(ends[owner] - p, length)
        sides = []
        for n, first, step in ((left, p - 1, -1), (right, p, 1)):
            at, of = W.ragged(np.zeros(len(n), np.int64), n)
            offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            sides.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(data[first[of] + step * at])]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(t, np.int64)[owner]), pa.array(np.array(size, np.int32)[owner]), *cols, *sides], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            t, size, lists = b.column("t").to_pylist(), b.column("size").to_pylist(), b.column("wanted")
            rows, offs = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            i = 0
            while i < len(t):  # texts of some 4,096 contexts or a slice of bytes, one at least
                j = i + 1
                while j < len(t) and offs[j + 1] - offs[i] <= 4096 and sum(size[i : j + 1]) <= SLICE:
                    j += 1
                texts = [unpack.decompress(x.as_py()) for x in b.column("packed")[i:j]]
                owner = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
                for a in range(0, len(owner), 4096):
                    yield cut_out(texts, t[i:j], size[i:j], rows.slice(offs[i] + a, min(4096, len(owner) - a)), owner[a : a + 4096])
                i = j

    return run


def _window_hashes(b: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """(context, offset, hash of the bytes and the offset) of every window of the contexts."""
    sides = [W.text_buffers(b.column(c)) for c in ("left", "right")]
    width = [np.diff(offs) for _, offs in sides]
    both = width[0] + width[1]
    begin = np.cumsum(both) - both
    data = np.zeros(int(both.sum()), np.uint8)
    for (raw, offs), n, first, step in ((sides[0], width[0], begin + width[0] - 1, -1), (sides[1], width[1], begin + width[0], 1)):
        place, owner = W.ragged(np.zeros(len(n), np.int64), n)
        data[first[owner] + step * place] = raw[offs[0] : offs[-1]]
    rest = np.asarray(b.column("place")) % _PLACE
    offset, owner = W.ragged(rest // 512, rest % 512 - rest // 512 + 1)
    sums, inverse = _hash_sums(data)
    start = (begin + width[0])[owner] - offset
    return owner, offset, W.combine(_hash_of(sums, inverse, start, start + length), offset.astype(np.uint64))


_DEALT = "part int, chunk bigint, n int, own binary, window binary, id binary, key binary"
_DEALT_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("own", "window", "id", "key")]])
_MET = "chunk bigint, n int, own binary, id binary"
_MET_ARROW = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("own", pa.binary()), ("id", pa.binary())])
_MANY = 1 << 31  # in an id: the window's context stands more than once


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, schema.types, strict=True)], schema=schema)


def _windows(length: int, parts: int):
    """Contexts -> a row per chunk of them (t, size, place), and one per chunk and part of the windows with their hashes, ids and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in (x.slice(i, BATCH) for x in batches for i in range(0, x.num_rows, BATCH)):
            cols: list[list] = [[], [], []]
            many = np.asarray(b.column("times")) > 1
            keys = (np.asarray(b.column("key")).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            for i in range(0, b.num_rows, 1024):
                owner, offset, h = _window_hashes(b.slice(i, 1024), length)
                own = i + owner
                for col, x in zip(cols, (h, ((own * 512 + offset) | np.where(many[own], _MANY, 0)).astype(np.uint32), keys[own]), strict=True):
                    col.append(x)
            h, id_, key = (np.concatenate(x) for x in cols)
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
            own = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("t", "size", "place")])
            # also of its rows, so that a repeated task with its rows in another order is found out
            same = W.mix(own[0].view(np.uint64) + W.mix(own[2].view(np.uint64)) + np.arange(b.num_rows, dtype=np.uint64))
            chunk = int(W.combine(np.array([number], np.uint64), np.bitwise_xor.reduce(same)[None]).view(np.int64)[0])
            number += 1
            yield _row(_DEALT_ARROW, chunk % parts, chunk, len(edge) - 1, own.tobytes(), None, None, None)
            for i, j in zip(edge, edge[1:], strict=False):
                at = order[i:j]
                yield _row(_DEALT_ARROW, int(part[at[0]]), chunk, 0, None, h[at].tobytes(), id_[at].tobytes(), key[at].tobytes())

    return run


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part: of each chunk the ids of its windows that stand more than once."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, id_, key = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        order = np.argsort(h, kind="stable")
        same_hash = h[order][1:] == h[order][:-1]
        if (same_hash & (key[order][1:] != key[order][:-1])).any():  # other bytes under one hash
            order = np.lexsort((key, h))
            same_hash = h[order][1:] == h[order][:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same_hash | (key[order][1:] != key[order][:-1])]))
        total = np.add.reduceat(np.where(id_[order] & np.uint32(_MANY), 2, 1), first)
        twice = np.empty(len(h), bool)
        twice[order] = np.repeat(total > 1, np.diff(np.append(first, len(h))))
        twice &= id_ < _MANY  # the others go as a whole
        at = 0
        for chunk, own, *_ in held:
            here = slice(at, at + len(own))
            yield _row(_MET_ARROW, chunk, 0, None, id_[here][twice[here]].tobytes())
            at += len(own)

    held: list[tuple] = []
    part = None
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != part and held:
                yield from solve(held)
                held = []
            part = r["part"]
            if r["own"] is not None:
                yield _row(_MET_ARROW, r["chunk"], r["n"], r["own"], None)
            else:
                held.append((r["chunk"], *(np.frombuffer(r[c], k) for c, k in (("window", np.uint64), ("id", np.uint32), ("key", np.uint32)))))
    if held:
        yield from solve(held)


def _flagged(length: int):
    """Sorted by chunk, its contexts first: pieces of the windows that stand more than once."""

    def solve(own: np.ndarray, left: int, flags: np.ndarray) -> pa.RecordBatch:
        if left:
            raise RuntimeError("windows of a chunk are missing: its contexts changed while they were read")
        return _pieces(own[0], own[1].astype(np.int32), own[2], flags, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk = flags = None
        left = 0
        for b in batches:
            for r in b.to_pylist():
                if r["own"] is not None:
                    if own is not None:
                        yield solve(own, left, flags)
                    own, chunk, left = np.frombuffer(r["own"], np.int64).reshape(3, -1), r["chunk"], r["n"]
                    flags = np.zeros((own.shape[1], length), bool)
                else:
                    if r["chunk"] != chunk:
                        raise RuntimeError("windows without their contexts: these changed while they were read")
                    id_ = np.frombuffer(r["id"], np.uint32)
                    flags[id_ // 512, id_ % 512] = True
                    left -= 1
        if own is not None:
            yield solve(own, left, flags)

    return run


# --- the operator -------------------------------------------------------------


def _named(text: Column) -> list[Column]:
    """Identity of a text: a 64-bit hash and the number of bytes."""
    return [F.xxhash64(text).alias("t"), F.octet_length(text).alias("size")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = pa.array([squeeze.compress(x.as_buffer()) for x in b.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("t"), b.column("size"), packed], names=["t", "size", "packed"])


def _texts(docs: DataFrame, length: int) -> DataFrame:
    """(t, size, text) of texts that have a window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*_named(text), text.alias("text")).where(F.col("size") >= length)


def _packed(docs: DataFrame, length: int) -> DataFrame:
    """Texts for a shuffle, compressed."""
    return _texts(docs, length).mapInArrow(_pack, "t bigint, size int, packed binary")


def _held(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """``df`` worked out once, its rows on the executors' disks until ``held`` is let go."""
    held.append(keep(df, StorageLevel.DISK_ONLY))
    df.count()
    return df


def repeated_pieces(docs: DataFrame, held: list[DataFrame], length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """(t, size, start, stop): bytes of each distinct text under a repeated window; pieces may overlap.

    ``limit`` bounds what one task gathers, not what is found. ``held`` gets
    the tables that the pieces are read from, to be unpersisted after that.
    """
    if length % BLOCK or not GRAM <= length < 512:
        raise ValueError(f"length must be a multiple of {BLOCK} under 512")
    found = _held(_texts(docs, length).mapInArrow(_anchor_rows(length), "t bigint, size int, place bigint, key bigint, context bigint"), held)
    folded = found.groupBy("key", "context").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("t", "size", "place")])
    folded = _held(folded, held)

    # Contexts that stand twice: each of their places.
    twice = folded.where("times > 1").select("key", "context", "times")
    whole = with_small(found, twice, ["key", "context"], F.col("times"))
    p, rest = F.floor(F.col("place") / _PLACE), F.col("place") % _PLACE
    pieces = whole.select("t", "size", (p - rest % 512).alias("start"), (p - F.floor(rest / 512) + length).alias("stop"))

    # Contexts of a key that has several, one of them found once: compared.
    several = folded.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("times").alias("least")).where("contexts > 1 AND least = 1")
    wanted = folded.join(several, "key").withColumn("crowded", F.col("contexts") > limit)
    by_text = wanted.groupBy("t", "size").agg(F.collect_list(F.struct("place", "key", "context", "times", "crowded")).alias("wanted"))
    texts = _packed(docs, length).groupBy("t", "size").agg(F.first("packed").alias("packed"))
    sides = "t bigint, size int, place bigint, key bigint, context bigint, times bigint, crowded boolean, left binary, right binary"
    contexts = _held(texts.join(by_text, ["t", "size"]).mapInArrow(_contexts(length), sides), held)
    sorted_ = contexts.where("NOT crowded").repartition("key").sortWithinPartitions("key")
    pieces = pieces.unionByName(sorted_.mapInArrow(_compared(length), _PIECES))

    # Keys with more contexts than a task takes: windows by hash.
    crowded = contexts.where("crowded")
    many = crowded.count()
    if not many:
        return pieces
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-many * length // PART))
    windows = crowded.mapInArrow(_windows(length, parts), _DEALT).repartition(parts, "part").sortWithinPartitions("part")
    met = windows.mapInArrow(_met_twice, _MET).repartition("chunk").sortWithinPartitions("chunk", F.col("own").isNull())
    return pieces.unionByName(met.mapInArrow(_flagged(length), _PIECES))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a text -> its spans: sorted, apart from each other."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for b in batches:
        out = []
        for pieces in b.column("pieces"):
            starts, stops = (np.asarray(pieces.values.field(c)) for c in ("start", "stop"))
            by = np.argsort(starts, kind="stable")
            starts, reach = starts[by], np.maximum.accumulate(stops[by])
            new = np.concatenate([[True], starts[1:] > reach[:-1]])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(by) - 1)
            out.append([{"start": int(a), "stop": int(z)} for a, z in zip(starts[new], reach[last], strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("t"), b.column("size"), pa.array(out, kind)], names=["t", "size", "spans"])


def spans_by_text(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """(t, size, spans): of each distinct text that loses bytes, the runs that go."""
    held: list[DataFrame] = []
    try:
        pieces = repeated_pieces(docs, held, length, limit).groupBy("t", "size").agg(F.collect_set(F.struct("start", "stop")).alias("pieces"))
        return stored(pieces.mapInArrow(_merged, "t bigint, size int, spans array<struct<start: bigint, stop: bigint>>"), "suffix-spans")
    finally:
        for df in reversed(held):
            df.unpersist()


def _rest(text: bytes, spans: list[dict]) -> bytes:
    at, out = 0, []
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])


def _kept(hashed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rest = [_rest(unpack.decompress(x.as_py()), s.as_py()) for x, s in zip(b.column("packed"), b.column("spans"), strict=True)]
            if hashed:
                yield pa.RecordBatch.from_arrays([b.column("t"), b.column("size"), pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())], names=["t", "size", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("t"), b.column("size"), pa.array(rest, pa.binary())], names=["t", "size", "kept"])

    return run


def _partial(docs: DataFrame, spans: DataFrame, length: int, hashed: bool) -> DataFrame:
    """What is left of the texts that lose some bytes but not all (none of them has a copy)."""
    some = spans.where(F.col("spans")[0]["stop"] - F.col("spans")[0]["start"] < F.col("size"))
    kept = "kept_sha256 string" if hashed else "kept binary"
    return _packed(docs, length).join(some, ["t", "size"]).mapInArrow(_kept(hashed), f"t bigint, size int, {kept}")


def spans_of(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) per row: the runs that go and the hash of the bytes that stay."""
    spans = spans_by_text(docs, length, limit)
    lost = spans.join(_partial(docs, spans, length, True), ["t", "size"], "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *_named(text), F.sha2(text.cast("binary"), 256).alias("own"))
    long, short = rows.where(F.col("size") >= length), rows.where(F.col("size") < length)
    nothing = F.sha2(F.lit(""), 256)
    joined = with_small(long, lost, ["t", "size"], how="left").unionByName(short, allowMissingColumns=True)
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    kept = F.when(F.col("spans").isNull(), F.col("own")).otherwise(F.coalesce("kept_sha256", nothing))
    return joined.select("doc_id", F.col("size").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), kept.alias("kept_sha256"))


def cut(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """``docs`` with their text as the binary of the bytes that stay (null texts: empty)."""
    spans = spans_by_text(docs, length, limit)
    lost = spans.select("t", "size").join(_partial(docs, spans, length, False), ["t", "size"], "left")
    lost = lost.select(F.col("t").alias("_t"), F.col("size").alias("_size"), F.coalesce("kept", F.lit(b"")).alias("_kept"))
    text = F.coalesce(F.col("text"), F.lit(""))
    t, size = _named(text)
    joined = with_small(docs.withColumns({"_t": t, "_size": size}), lost, ["_t", "_size"], how="left")
    return joined.withColumn("text", F.coalesce("_kept", text.cast("binary"))).select(*docs.columns)
