"""Suffix-array dedup: the array against sorting, removed bytes against brute force, edge rows."""

import hashlib
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tickerlake.llm import queries
from tickerlake.llm import suffix_dedup as S
from tickerlake.llm.tables import scratch_root

LENGTH = 80


def brute(texts, length):
    """Removed byte positions of each text."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for r, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((r, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, i in places:
                gone[r][i : i + length] = True
    return gone


def spans(flags):
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def check(spark, rows, length=LENGTH, limit=S.LIMIT):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in S.spans_of(docs, length, limit).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, [(s.start, s.stop) for s in r.spans], r.kept_sha256))
    texts = [(t or "").encode() for _, t in rows]
    want = {}
    for (k, _), t, gone in zip(rows, texts, brute(texts, length), strict=True):
        kept = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        want.setdefault(k, []).append((len(t), spans(gone), kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return want


def test_linear_grouping_sorts_suffixes():
    rng = random.Random(3)
    for t in range(1500):
        s = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        if t % 4 == 0 and s:
            s = (s[: rng.randint(1, 4)] * 20)[: len(s)]
        assert S.linear_grouping(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(seed, n):
    """Texts that share passages, are edited copies, repeat themselves or run periodically."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    some = lambda k: " ".join(word() for _ in range(k))
    passages = [some(rng.randint(15, 40)) for _ in range(3)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(some(40))
        elif kind == 1:
            texts.append(some(rng.randint(0, 30)) + rng.choice(passages) + some(rng.randint(0, 30)))
        elif kind == 2 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        elif kind == 3:
            texts.append(rng.choice(["ab" * 60, "x" * rng.randint(70, 200), "\x00" * 90, some(2) * 20]))
        elif kind == 4:
            p = rng.choice(passages)
            texts.append(p + some(3) + p[rng.randint(0, 20) :])
        else:
            texts.append(rng.choice([None, "", "short", rng.choice(passages)[:79], rng.choice(passages)[:81]]))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [S.LIMIT, 1])
def test_removed_bytes_match_brute_force(spark, limit):
    want = check(spark, corpus(1, 90), limit=limit)
    assert sum(len(s) for v in want.values() for _, s, _ in v) > 30


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rows = corpus(2, 24)
    data = "".join(t or "" for _, t in rows).encode()
    monkeypatch.setattr(S, "SLICE", 100)
    import pyarrow as pa

    run = S._anchor_rows(LENGTH)
    monkeypatch.setattr(S.W, "CHUNK_BYTES", 10)
    monkeypatch.setattr(S.W.spans, "__defaults__", (10,))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(data)], pa.int32()), pa.array([data.decode()])], names=["t", "size", "text"])
    starts = []
    for b in run(iter([batch])):
        for place in b.column("place").to_pylist():
            p, rest = divmod(place, S._PLACE)
            starts += range(p - rest % 512, p - rest // 512 + 1)
    assert sorted(starts) == list(range(len(data) - LENGTH + 1))


def test_edge_rows(spark):
    copy = "the same words " * 8
    rows = [(1, None), (2, ""), (None, copy), (3, copy), (3, copy), (4, "x" * 5000), (5, "y"), (6, "ünï ¿ 文 字 " * 30)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'mine' AS spans", "7 AS size", "'k' AS t", "1 AS n_bytes")
    out = S.cut(docs, LENGTH)
    assert out.columns == docs.columns
    kept = {(r.doc_id, bytes(r.text)) for r in out.collect()}
    assert {(1, b""), (3, b""), (None, b""), (5, b"y")} <= kept and out.count() == len(rows)
    assert S.spans_of(docs.limit(0), LENGTH).collect() == []


def test_query_on_the_small_table(spark):
    rows = queries.registry()["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [(d.text or "").encode() for d in docs]
    want = {}
    for d, t, gone in zip(docs, texts, brute(texts, 400), strict=True):
        want[d.doc_id] = (len(t), int(gone.sum()), len(spans(gone)), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_tables_between_steps_are_no_files_and_let_go(spark):
    root = scratch_root(spark).removeprefix("file:")
    persisted = spark.sparkContext._jsc.getPersistentRDDs
    before, held = set(os.listdir(root)), persisted().size()
    check(spark, corpus(5, 30))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"hot-keys", "suffix-spans"}
    assert persisted().size() == held


def test_a_long_text_takes_no_more_memory_than_many_short_ones():
    letters = np.random.default_rng(7).integers(97, 123, 6 << 20, np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([len(letters)], pa.int32()), pa.array([letters])], names=["t", "size", "text"])
    tracemalloc.start()
    try:
        starts = 0
        for b in S._anchor_rows(S.LENGTH)(iter([batch])):
            rest = np.asarray(b.column("place")) % S._PLACE
            starts += int((rest % 512 - rest // 512 + 1).sum())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert starts == len(letters) - S.LENGTH + 1
    assert most < 300e6
