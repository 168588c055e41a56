"""License scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are the lines of a text. Their features are word n-grams (one and
two words) that occur in the notices below; a softmax regression over the
licence families and the class "unknown" is fitted on noisy copies of the
notices, on notices whose telling word is replaced by another (no licence of
these families), on mixtures of their words and on paragraphs of the corpus (a
bounded sample: at most ``max_lines`` lines of about ``max_rows`` documents). Its probabilities are calibrated
by a temperature on examples that the fit has not seen. A family is reported
where its calibrated probability reaches ``least`` and a notice of the
family shares at least ``overlap`` of its word pairs with the paragraph, and
one of the words that tell the family, if it has such words; all else is
unknown.

Notices that a line does not show by itself (wrapped over several lines, or
next to another one in the same line) are found in the running words of the
text: every stretch of at most twice a notice's words that has ``overlap`` of
its pairs is judged alone, whatever its lines, and reported at its first line
unless the family is reported there already.

Defined cases: a null or empty text has no paragraphs; blank lines are no
paragraphs; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerlake.llm import words as W

NOTICES = {
    "agpl": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the Apache License", "distributed under the Apache License Version 2.0 on an AS IS basis"],
    "bsd": ["Released under the BSD License", "licensed under the three clause BSD license", "Redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal", "To the extent possible under law the author has waived all copyright under CC0"],
    "epl": ["made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2", "Licensed under the EUPL, version 1.2"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later"],
    "isc": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl": ["subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License"],
    "zlib": ["Released under the zlib License", "This software is provided as-is, without any express or implied warranty"],
}
# Identifiers of the families in SPDX lines.
SPDX = {
    "agpl": "AGPL-3.0-only", "apache-2.0": "Apache-2.0", "bsd": "BSD-3-Clause", "bsl-1.0": "BSL-1.0", "cc-by": "CC-BY-4.0",
    "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc0": "CC0-1.0", "epl": "EPL-2.0", "eupl": "EUPL-1.2",
    "gpl": "GPL-3.0-or-later", "isc": "ISC", "lgpl": "LGPL-2.1-only", "mit": "MIT", "mpl": "MPL-2.0", "zlib": "Zlib",
}
NOTICES = {k: [*NOTICES[k], f"SPDX-License-Identifier: {SPDX[k]}"] for k in sorted(NOTICES)}
FAMILIES = [*NOTICES, "unknown"]


@dataclass(frozen=True)
class Options:
    max_rows: int = 400
    max_lines: int = 20_000
    max_chars: int = 2_000  # of a line in the sample
    copies: int = 60
    least: float = 0.5
    overlap: float = 0.6


def _ngrams(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, row, is a pair) of all words and word pairs of the rows of a chunk."""
    h, row = chunk.hash, chunk.row
    two = np.flatnonzero(row[:-1] == row[1:]) if len(h) > 1 else np.zeros(0, np.int64)
    pairs = W.combine(h[two], h[two + 1])
    return np.concatenate([h, pairs]), np.concatenate([row, row[two]]), np.repeat([False, True], [len(h), len(two)])


def _chunk_of(lines: list[str]) -> W.Chunk:
    raw = [x.encode() for x in lines]
    data = W._LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    return W.words_of(data, np.cumsum([len(x) for x in raw]), 0, W.NON_WORD)


@dataclass
class Model:
    features: np.ndarray  # sorted n-grams of the notices
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    template: np.ndarray  # sorted word pairs of notices, one run per notice
    notice: np.ndarray  # (pair, notice) as pair index and notice number
    notice_size: np.ndarray
    family: np.ndarray  # family of each notice
    telling: list[np.ndarray]  # features of each notice's telling words; without one of them it confirms nothing

    def judge(self, chunk: W.Chunk, o: Options) -> tuple[np.ndarray, np.ndarray]:
        """(family number, probability) of each row; "unknown" where the templates do not confirm."""
        unknown = len(FAMILIES) - 1
        out, prob = np.full(chunk.rows, unknown), np.zeros(chunk.rows)
        gram, row, pair = _ngrams(chunk)
        at = np.minimum(np.searchsorted(self.features, gram), len(self.features) - 1)
        met = np.flatnonzero(self.features[at] == gram)
        if not len(met):
            return out, prob
        some, local = np.unique(row[met], return_inverse=True)
        x = np.zeros((len(some), len(self.features)), np.float32)
        x[local.ravel(), at[met]] = 1
        p = self.probabilities(x)
        best = p.argmax(1)
        ok = (best != unknown) & (p.max(1) >= o.least)
        pairs = self.template_pairs(x)
        share = np.where(self.family[None, :] == best[:, None], pairs / self.notice_size, 0).max(1)
        ok &= share >= o.overlap
        out[some[ok]] = best[ok]
        prob[some] = p.max(1)
        return out, prob

    def stretches(self, chunk: W.Chunk, doc: np.ndarray, o: Options) -> list[tuple[int, int, int, float]]:
        """(first word, last word, family, probability) of notices in the running words of texts; ``doc`` is the text of each row."""
        h = chunk.hash
        if len(h) < 2:
            return []
        own = doc[chunk.row]
        pair = np.where(own[:-1] == own[1:], W.combine(h[:-1], h[1:]), np.uint64(0))
        at = np.minimum(np.searchsorted(self.features, pair), len(self.features) - 1)
        place = np.flatnonzero(self.features[at] == pair)
        at = at[place]
        key = place + own[place] * 4096  # texts lie further apart than a stretch
        found = []
        for n, size in enumerate(self.notice_size):
            pairs = self.template[self.notice == n]
            mine = np.flatnonzero(np.isin(at, pairs))
            k, need, reach = key[mine], int(np.ceil(o.overlap * size - 1e-9)), 2 * (size + 1)
            start = mine[np.searchsorted(k, k + reach) - np.arange(len(k)) >= need]
            if not len(start):
                continue
            share, end = np.zeros(len(start), np.int64), key[start].copy()
            for f in pairs:
                where = key[mine[at[mine] == f]]
                if len(where):
                    i = np.searchsorted(where, key[start])
                    nearest = where[np.minimum(i, len(where) - 1)]
                    ok = (i < len(where)) & (nearest < key[start] + reach)
                    share += ok
                    end = np.maximum(end, np.where(ok, nearest, 0))
            ok = share >= need
            begin, last, share = place[start][ok], (place[start] + end - key[start])[ok], share[ok]
            i = 0
            while i < len(begin):
                j = int(np.searchsorted(begin, last[i], side="right"))
                best = min(range(i, j), key=lambda m: (-share[m], last[m] - begin[m]))
                found.append((int(begin[best]), int(last[best]) + 1, int(self.family[n]), share[best] / size, n))
                i = max(i + 1, int(np.searchsorted(begin, last[best], side="right")))
        if not found:
            return []
        begin, last = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        word, owner = W.ragged(begin, last - begin + 1)
        p = np.zeros(len(found))
        for i in range(0, len(found), 4096):
            some = (owner >= i) & (owner < i + 4096)
            w, r = word[some], owner[some] - i
            within = np.flatnonzero(r[:-1] == r[1:])
            gram, row = np.concatenate([h[w], pair[w[within]]]), np.concatenate([r, r[within]])
            g = np.minimum(np.searchsorted(self.features, gram), len(self.features) - 1)
            met = self.features[g] == gram
            x = np.zeros((min(4096, len(found) - i), len(self.features)), np.float32)
            x[row[met], g[met]] = 1
            p[i : i + len(x)] = self.probabilities(x)[np.arange(len(x)), [f[2] for f in found[i : i + 4096]]]
            which = np.array([f[4] for f in found[i : i + 4096]])
            for n in np.unique(which):
                p[i : i + len(x)][(which == n) & ~self.told(n, x)] = 0
        # of stretches over the same words the best fitting one stays
        out, taken = [], np.zeros(len(h), bool)
        for i in sorted(np.flatnonzero(p >= o.least), key=lambda i: (-found[i][3], -p[i], found[i][0])):
            a, b, family = found[i][:3]
            if 2 * taken[a : b + 1].sum() <= b - a + 1:
                taken[a : b + 1] = True
                out.append((a, b, family, float(p[i])))
        return sorted(out)

    def probabilities(self, x):
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def template_pairs(self, x):
        """Word pairs of each notice that a row has."""
        out = np.zeros((len(x), len(self.notice_size)))
        for n in range(len(self.notice_size)):
            out[:, n] = x[:, self.template[self.notice == n]].sum(1) * self.told(n, x)
        return out

    def told(self, n: int, x) -> np.ndarray:
        """Rows with a telling word of notice ``n`` (all rows if it has none)."""
        return x[:, self.telling[n]].any(1) if len(self.telling[n]) else np.ones(len(x), bool)


_WORD = re.compile("[a-z0-9]+")


def _telling_words(most: int = 3) -> list[tuple[str, set[str]]]:
    """Notices with the few words (at most ``most``) that tell their family.

    Words that only the family's notices have; of these the ones that several
    of its notices share (its name), where a notice has any.
    """
    used = {k: {w for n in ns for w in _WORD.findall(n.lower())} for k, ns in NOTICES.items()}
    out = []
    for k, ns in NOTICES.items():
        others = set().union(*[v for f, v in used.items() if f != k])
        own = [{w for w in _WORD.findall(n.lower()) if w not in others and not w.isdigit()} for n in ns]
        for n, told in zip(ns, own, strict=True):
            told = {w for w in told if sum(w in x for x in own) > 1} or told
            if 0 < len(told) <= most:
                out.append((n, told))
    return out


def _examples(o: Options, rng) -> tuple[list[str], list[int]]:
    lines, y = [], []
    all_words = [w for ns in NOTICES.values() for n in ns for w in n.split()]
    telling = dict(_telling_words())
    for k, notices in enumerate(NOTICES.values()):
        for n in notices:
            words = n.split()
            for _ in range(o.copies):
                told = telling.get(n, set())  # without its telling words a notice is not this family's
                kept = [w for w in words if rng.random() > 0.1 or told & set(_WORD.findall(w.lower()))]
                noise = [all_words[rng.integers(len(all_words))] if rng.random() < 0.1 else "xq" for _ in range(rng.integers(0, 6))]
                cut = rng.integers(len(noise) + 1)
                lines.append(" ".join(noise[:cut] + (kept or words) + noise[cut:]))
                y.append(k)
    # One word off is another licence: notices whose telling word is replaced.
    for n, told in _telling_words():
        for _ in range(2 * o.copies):
            swap = {w: f"xq{rng.integers(100)}" for w in told}
            lines.append(" ".join(swap.get(w, w) for w in _WORD.findall(n.lower())))
            y.append(len(FAMILIES) - 1)
    for _ in range(30 * o.copies):  # words of notices in no order are no notice
        lines.append(" ".join(all_words[i] for i in rng.integers(0, len(all_words), rng.integers(1, 9))))
        y.append(len(FAMILIES) - 1)
    return lines, y


def fit(docs: DataFrame, o: Options = Options()) -> Model:
    rng = np.random.default_rng(7)
    notices = [n for ns in NOTICES.values() for n in ns]
    family = np.array([k for k, ns in enumerate(NOTICES.values()) for _ in ns])
    chunk = _chunk_of(notices)
    gram, row, pair = _ngrams(chunk)
    features, at = np.unique(gram, return_inverse=True)
    own = np.unique(np.stack([row[pair], at.ravel()[pair]], axis=1), axis=0)
    size = np.maximum(np.bincount(own[:, 0], minlength=len(notices)), 1)
    words = dict(_telling_words())
    telling = [np.searchsorted(features, _chunk_of([" ".join(sorted(words[n]))]).hash) if n in words else np.zeros(0, np.int64) for n in notices]
    model = Model(features, None, None, 1.0, own[:, 1], own[:, 0], size, family, telling)

    lines, y = _examples(o, rng)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    share = o.max_rows / max(texts.count(), o.max_rows)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    # about max_rows whole texts (equal rows count once), however large the table
    some = texts.where(drawn).dropDuplicates().select(F.explode(F.split("text", "\n")).alias("line"))
    some = some.where(F.trim("line") != "").select(F.substring("line", 1, o.max_chars).alias("line"))
    some = some.orderBy(F.xxhash64("line"), "line").limit(o.max_lines)
    corpus = sorted(r["line"] for r in some.collect())
    lines, y = lines + corpus, np.array(y + [len(FAMILIES) - 1] * len(corpus))
    x = np.zeros((len(lines), len(features)), np.float32)
    gram, row, _ = _ngrams(_chunk_of(lines))
    at = np.minimum(np.searchsorted(features, gram), len(features) - 1)
    ok = features[at] == gram
    x[row[ok], at[ok]] = 1
    # corpus paragraphs that hold a notice are no examples of unknown ones
    model.weights, model.bias = np.zeros((len(features), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    notice_like = (model.template_pairs(x) / size).max(1) >= 0.4
    use = ~(notice_like & (y == len(FAMILIES) - 1))
    x, y = x[use], y[use]
    held = rng.random(len(y)) < 0.2
    model.weights, model.bias = _softmax(x[~held], y[~held])
    model.temperature = _temperature(x[held] @ model.weights + model.bias, y[held])
    return model


def _softmax(x, y, rounds: int = 400, rate: float = 4.0, ridge: float = 1e-4):
    w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[y]
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(y)
        w -= rate * (x.T @ g + ridge * w)
        b -= rate * g.sum(0)
    return w.astype(np.float32), b.astype(np.float32)


def _temperature(z, y) -> float:
    """Temperature with the least log loss on held-out examples."""
    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()

    grid = np.geomspace(0.2, 5, 60)
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


_OUT = "doc_id bigint, n_paragraphs bigint, families array<string>, hits array<struct<paragraph:bigint,family:string,probability:double>>"


def scan(docs: DataFrame, model: Model, o: Options = Options()) -> DataFrame:
    """(doc_id, n_paragraphs, families, hits): confirmed licence notices of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    hit = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64())])

    def run(batches):
        m = shipped.value
        for b in batches:
            raw, offs = W.text_buffers(b.column("text"))
            ids = b.column("doc_id")
            for i, j in W.spans(offs):
                data = W._LOWER[raw[offs[i] : offs[j]]]
                ends = offs[i + 1 : j + 1] - offs[i]
                # lines are the rows here; a line does not run over the end of its text
                stops = np.union1d(np.flatnonzero(data == 0x0A), ends)
                doc = np.searchsorted(ends, stops - (stops > 0), side="right")
                c = W.words_of(data, stops, 0, W.NON_WORD)
                has = c.word_counts() > 0
                doc = np.minimum(doc, j - i - 1)
                number = np.cumsum(has) - 1
                before = np.searchsorted(doc[has], np.arange(j - i))
                fam, prob = m.judge(c, o)
                hits = [[] for _ in range(j - i)]
                for r in np.flatnonzero(fam < len(FAMILIES) - 1):
                    hits[doc[r]].append({"paragraph": int(number[r] - before[doc[r]]), "family": FAMILIES[fam[r]], "probability": float(prob[r])})
                for a, z, family, p in m.stretches(c, doc, o):
                    lines = range(c.row[a], c.row[z] + 1)
                    if not any(fam[r] == family for r in lines):
                        r = lines[0]
                        hits[doc[r]].append({"paragraph": int(number[r] - before[doc[r]]), "family": FAMILIES[family], "probability": p})
                for x in hits:
                    x.sort(key=lambda h: h["paragraph"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.bincount(doc[has], minlength=j - i)), pa.array([sorted({h["family"] for h in x}) for x in hits], pa.list_(pa.string())), pa.array(hits, pa.list_(hit))],
                    names=["doc_id", "n_paragraphs", "families", "hits"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)
