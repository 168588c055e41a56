"""Merkle manifest against plain Python: layout, proofs, trees of one and of several blocks, edge rows."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from tickerlake.llm import merkle as M

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [*row[:4], row[4].translate(LOWER) if lower and row[4] is not None else row[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(root, siblings and own place of each leaf, level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(paths):
            p.append((runs[at[k] // 8], at[k] % 8))
            at[k] //= 8
        level = [sha(*r) for r in runs]
    return level[0], paths


def want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    subs, inside = {}, {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g], inside[g] = climb([leaf(r) for r in own])
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, above = climb([subs[g] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for r, path in zip(groups[g], inside[g], strict=True):
            path = path + up
            cur = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for run, k in path:
                cur = sha(*run[:k], cur, *run[k + 1 :])
            out.append((r[0], leaf(r), subs[g], root, sha(*[x for run, k in path for i, x in enumerate(run) if i != k]), cur, cur == root))
    return sorted(out, key=str)


def run(df):
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return sorted((tuple(r) for r in M.proofs(M.tampered(df, third)).collect()), key=str)


def test_layout_places_every_node_once():
    for height in range(1, 7):
        all_ = np.concatenate([M.address(d, np.arange(M.ARITY**d), height) for d in range(height)])
        assert sorted(all_.tolist()) == list(range(M.nodes_of(height)))
    assert M.address(0, np.arange(1), 5).tolist() == [0]
    lower = [M.address(d, np.arange(M.ARITY ** (d - 2)) + 3 * M.ARITY ** (d - 2), 4) for d in (2, 3)]  # one lower half is one stretch
    found = np.sort(np.concatenate(lower))
    assert (np.diff(found) == 1).all()


def test_proofs_match_brute_force(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(1, 9_000)]  # three blocks, two passes
    rows += [(i, "s", "de", None, None if i % 5 == 0 else "Ä b") for i in range(-70, 4)]
    rows += [(7, None, f"l{i:03}", 1, "one of many languages") for i in range(90)]
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert got == want(rows)
    assert {r[6] for r in got} == {True, False}


def test_edge_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", None, 0, ""), (1, "a", "en", 2, "X"), (1, "b", "en", 2, "X"), (2, "b", "en", 2, "x" * 70_000), (3, "b", "EN", 2, "ÜNÏ 文 A"), (3, "b", "EN", 2, "ÜNÏ 文 A")]
    rows += [(9, "many", "zz", 1, "equal rows")] * 5000
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "'y' AS root", "1 AS times", "2 AS rank", "3 AS total", "4 AS grp")
    assert run(df) == want(rows)
    assert run(df.limit(0)) == []
    assert run(df.limit(1)) == want(rows[:1])
