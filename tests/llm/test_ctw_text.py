"""Contexts over the running text: against one whole tree over plain Python's counts, order of words, edge rows."""

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerlake.llm import ctw, ctw_text, queries
from tickerlake.llm import words as W

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
EDGES = [(801, None), (802, ""), (803, " \t\n"), (804, "One two"), (804, "One two"), (None, "null id here"), (805, "x" * 30_000), (806, "ünï ¿ 文 字 " * 40)]
SMALL = {"piece": 50, "max_frequent": 20, "max_grams": 150, "chunk": 300, "slices": 7, "groups": 3}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def running(text, lead):
    return bytes([lead]) + b"".join(w.encode() + bytes([lead]) for w in split(text))


def coded(text, lead):
    """(context, byte) of every byte of a text: a blank is a byte of its own, as context it carries the class."""
    s = running(text, lead)
    return [(s[max(0, i - 7) : i], 0x20 if s[i] == lead else s[i]) for i in range(1, len(s))] + [(s[-7:], 0x0A)]


def packed(context, byte):
    return int.from_bytes(context + bytes([byte]), "big")


def test_running_grams_match_plain_python():
    texts = [t for _, t in EDGES[:-2]] + ["a b", "", "word ünï\tX  y", "last"]
    for limit in (8, 1 << 20):
        for c in W.chunks(pa.array(texts, pa.string()), limit=limit):
            gram, size = W.running_grams(c, 8, 0x0A)
            want = [[packed(x, b) for x, b in coded(t, 0x20)] for t in texts[c.first : c.first + c.rows]]
            assert size.tolist() == [len(x) for x in want] and gram.tolist() == sum(want, [])


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    for n in (0, 1, 2, len(keys) // 2):
        values = np.stack([np.arange(1, n + 1), np.full(n, 7)], axis=1)
        cut = n // 3
        parts = [ctw_text._packed(keys[a:z]) for a, z in ((0, cut), (cut, n))], [ctw_text._repeated(values[a:z].T) for a, z in ((0, cut), (cut, n))]
        for t in (ctw_text._Table(keys[:n], values), pickle.loads(pickle.dumps(ctw_text._Shipped(*parts, "<i8", 2)))):
            at = t.find(keys)
            assert (t.values[at[:n]] == values).all() and (at[n:] == n).all() and not t.values[n].any()


@pytest.mark.parametrize("size", [SMALL, {}])
def test_scores_match_one_tree_over_plain_counts(spark, size):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 13)), "xyz"[i % 3], i % 5 == 0) for i in range(120)]
    rows += [(900, "unheard banana split", "x", True), *[(i, t, "y" if t and len(t) < 20 else None, False) for i, t in EDGES]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, out boolean").withColumns({"score": F.lit("own"), "chunk": F.lit(1)})
    ends = [sum(1 for r in rows if not r[3] and r[2] == c) for c in (None, "x", "y", "z")]
    most = sorted("xyz", key=lambda c: (-ends[" xyz".index(c)], c))
    ends = [ends[0], *[ends[" xyz".index(c)] for c in most]]
    n, heard, docs_in, tokens = {}, {}, 0, 0
    for _, text, lang, out in rows:
        if not out:
            docs_in += 1
            for w in split(text):
                heard[w] = heard.get(w, 0) + 1
            for x, b in coded(text, 1 + (1 + most.index(lang) if lang else 0)):
                for d in range(8):
                    gram = d, packed(x[len(x) - d :] if d < len(x) else x, b)
                    n[gram] = n.get(gram, 0) + 1
    levels = [sorted((g, c) for (d, g), c in n.items() if d == depth) for depth in range(8)]
    tree = ctw.grow([np.array([g for g, _ in x], np.uint64) for x in levels], [np.array([c for _, c in x], float) for x in levels])
    total = sum(heard.values()) + docs_in
    z = total + 0.1 * (len(heard) + 2)

    def log10(k, text):
        return tree.log10(np.array([packed(x, b) for x, b in coded(text, 1 + k)], np.uint64)).sum() + np.log10((ends[k] + 0.5) / (sum(ends) + 2))

    got = {}
    for r in ctw.score(docs, F.col("out"), F.col("lang"), ctw.Options(across=True, **size)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[804]) == 2
    for i, text, _, out in rows:
        lp = np.array([log10(k, text) for k in range(4)])
        want = lp.max() + np.log10((10 ** (lp - lp.max())).sum())
        own = split(text)
        base = sum(np.log10((heard.get(w, 0) + 0.1) / z) for w in own) + np.log10((docs_in + 0.1) / z)
        for r in got[i]:
            assert abs(r.score - want) < 1e-4 * max(1, abs(want)), (i, r.score, want)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, len(own) + 1, sum(w in heard for w in own) + 1, total)
            assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
            assert abs(r.bits_per_byte * (sum(len(w.encode()) + 1 for w in own) + 1) + r.score * np.log2(10)) < 1e-6 * max(1, abs(want))


def test_no_rows_and_no_training_rows(spark):
    o = ctw.Options(across=True, **SMALL)
    docs = spark.createDataFrame(EDGES, "doc_id int, text string")
    assert ctw.score(docs.limit(0), F.lit(False), F.lit("x"), o).collect() == []
    untrained = ctw.score(docs, F.lit(True), o=o).collect()
    assert len(untrained) == len(EDGES) and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.bits_per_byte - 8) < 1 for r in untrained)


def test_the_query_reads_words_in_their_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    heard = [i for i in range(2000) if i not in held][:120]
    rows = [(i, " ".join(rng.permutation(["un deux trois", "quatre cinq", "six"]).tolist() * 4), "fr") for i in heard]
    rows += [(held[0], "un deux trois quatre cinq six", "fr"), (held[1], "trois un cinq deux six quatre", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.registry()["op8_ctw_score"](spark, str(tmp_path)).collect()}
    told, mixed = got[held[0]], got[held[1]]
    assert told.held_out and mixed.held_out and abs(told.base_score - mixed.base_score) < 1e-9
    assert told.score > mixed.score + 3
