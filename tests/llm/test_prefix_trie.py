"""Conversation trie against plain Python: nodes over several blocks, copies, edge rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerlake.llm import prefix_trie as P

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * words(p)
    out = set()
    for p, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], sha))
    return out


def run(df):
    turns = P.turns_of(df)
    convs = P.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 20, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"), 3)
    rows = P.trie(convs).drop("n_ends").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def want(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return brute(convs)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("blocks", [1, 7])
def test_nodes_match_brute_force(spark, blocks):
    rng = random.Random(5)
    rows = []
    for c in range(300):
        for t in range(rng.randint(0, 6) or 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello there" if t < 3 and rng.random() < 0.7 else rng.choice(["one", "two words", "", "three\tof them"])))
    rows += [(1000 + i, t, "user", "the same long start") for i in range(60) for t in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    try:
        got = run(spark.createDataFrame(rows, SCHEMA))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "no id"), (3, None, None, None), (3, 0, "user", "x" * 70_000), (3, 0, "user", "x" * 70_000), (4, 1, None, "a b"), (4, 0, "user", None), (20, 0, "u", "base"), (21, 0, "u", "other"), (21, 1, "u", "more")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS depth", "1 AS n_convs", "'p' AS path", "2 AS block")
    assert run(df) == want(rows)
    assert run(df.limit(0)) == set()


def test_conversations_left_without_turns(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 0, "u", "goes, and the base is absent")]
    assert run(spark.createDataFrame(rows, SCHEMA)) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_sparse_table_against_scans():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 8, 33):
        v = rng.integers(0, 4, m)
        t = P.SparseTable(v)
        first = rng.integers(0, m, 50)
        last = np.minimum(first + rng.integers(0, m, 50), m - 1)
        assert t.least(first, last).tolist() == [v[a : b + 1].min() for a, b in zip(first, last, strict=True)]
        bound = rng.integers(0, 5, 50)
        for s, b, r, lo in zip(first, bound, t.reach_right(first, bound), t.reach_left(first, bound), strict=True):
            x = s
            while x + 1 < m and v[x + 1] >= b:
                x += 1
            y = s
            while y >= 1 and v[y] >= b:
                y -= 1
            assert (r, lo) == (x, y)
