"""Small cases of every operator: brute force, round trips and edge rows."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerlake.llm import chat, ctw, decontam, fingerprint, licenses, minhash_dedup, mixing, queries, toxicity, url_filter, warc
from tickerlake.llm import words as W
from tickerlake.llm.components import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
EDGES = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "One two"), (5, "One two"), (None, "null id here"), (6, "x" * 70_000), (7, "word " * 30_000), (8, "ünï ¿ 文 字")]


def docs_of(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with results."""
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit("mine"), "source": F.lit("s"), "digest": F.lit(1), "n_words": F.lit(2)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_words_match_plain_python():
    texts = [t for _, t in EDGES]
    for c in W.chunks(pa.array(texts, pa.string()), limit=64):
        for r in range(c.rows):
            own = [bytes(c.data[a:b]).decode() for a, b, k in zip(c.start, c.stop, c.row) if k == r]
            assert own == split(texts[c.first + r])


def test_toxicity_learns_and_keeps_rows(spark):
    rng = np.random.default_rng(1)
    plain = ["river", "stone", "market", "yellow", "garden", "window", "paper", "music"]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(plain, 30))
        if i % 5 == 0:
            text += " grotblim" + rng.choice(["", "ling", "er"])
        rows.append((i, text))
        labels.append((i, int(i % 5 == 0)))
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(spark, rows), lab)
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, [(i + 1000, t + " meadow") for i, t in rows]), model).collect()}
    assert all((got[i + 1000].score >= 0.3) == (i % 5 == 0) for i in range(400))
    edges = toxicity.score(docs_of(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert len({r.score for r in edges if r.doc_id == 5}) == 1
    none = toxicity.fit(docs_of(spark, rows).limit(0), lab)
    assert toxicity.score(docs_of(spark, EDGES), none).count() == len(EDGES)


def plain_kneser_ney(counts, shared_counts, order):
    """{gram: P(last byte | others)} and {context: backoff mass} of a class over the shared backoff, by dictionaries."""

    def discount(c):
        one, two = sum(x == 1 for x in c), sum(x == 2 for x in c)
        return min(max(one / max(one + 2 * two, 1), 0.1), 0.9)

    def lower(grams, width):  # grams are tuples of bytes
        if width == 1:
            return {g: 1 / 256 for g in grams}
        cont = {}
        for g in grams:
            cont[g[1:]] = cont.get(g[1:], 0) + 1
        d, below = discount(cont.values()), lower(set(cont), width - 1)
        out = {}
        for g in cont:
            alike = [n for x, n in cont.items() if x[:-1] == g[:-1]]
            out[g] = (max(cont[g] - d, 0) + d * len(alike) * below[g]) / sum(alike)
        return {g: out[g[1:]] for g in grams}

    shared, d = lower(set(shared_counts), order), discount(counts.values())
    p, mass = {}, {}
    for g in shared_counts:
        alike = [n for x, n in counts.items() if x[:-1] == g[:-1]]
        mass[g[:-1]] = d * len(alike) / sum(alike) if alike else 1.0
        p[g] = (max(counts.get(g, 0) - d, 0) / sum(alike) if alike else 0) + mass[g[:-1]] * shared[g]
    return p, mass


def test_kneser_ney_against_plain_python(spark):
    """Ratios and backoff of the fitted model, counted over the documents that it did not hold back."""
    order, rows = 4, [(i, t) for i, t in enumerate(["bad bat bad", "bat bats", "a cat sat", "cat cats sat on", "bad mat", "on a mat", "", None])]
    toxic = {0, 1, 4}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows], "doc_id bigint, toxic int"), toxicity.Options(order=order))

    def counted(ids):
        out = {}
        for i in ids:
            for w in split(rows[i][1]):
                raw = (" " + w + " ").encode()
                for k in range(1, len(raw)):
                    g = tuple([0] * max(order - 1 - k, 0) + list(raw[max(k - order + 1, 0) : k + 1]))
                    out[g] = out.get(g, 0) + 1
        return out

    def packed(g):
        return int.from_bytes(bytes(g), "big")

    fits = []
    for drawn in range(1 << len(rows)):  # the split is the model's own: one of all splits gives its grams and ratios
        kept = [i for i in range(len(rows)) if not drawn >> i & 1]
        bad, good = counted(set(kept) & toxic), counted(set(kept) - toxic)
        both = {g: bad.get(g, 0) + good.get(g, 0) for g in {**bad, **good}}
        if sorted(map(packed, both)) != [int(x) for x in model.grams] or not both:
            continue
        (p, mp), (q, mq) = (plain_kneser_ney(c, both, order) for c in (bad, good))
        ratio = {packed(g): np.log(p[g] / q[g]) for g in both}
        back = {packed(c): np.log(mp[c] / mq[c]) for c in mp}
        fits.append(np.allclose([ratio[int(x)] for x in model.grams], model.ratio, atol=1e-4) and np.allclose([back[int(x)] for x in model.contexts], model.backoff, atol=1e-4))
    assert any(fits) and len(model.grams) > 10


def test_toxicity_sample_is_bounded():
    sizes = {0: (5,), 1: (100,), 2: (4,), toxicity.SLOTS: (9,), toxicity.SLOTS + 1: (2,)}
    assert toxicity._fitting(sizes, (10,)) == [0, 2, toxicity.SLOTS]
    assert toxicity._fitting({}, (10,)) == []


def test_toxicity_passes_over_a_huge_text_and_repeats(spark):
    rows = [(i, ("calm river stone " if i % 2 else "grotblim awful ") * 5 + str(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(62)], "doc_id bigint, toxic int")
    o = toxicity.Options(max_bytes=20_000)
    huge = docs_of(spark, rows + [(60, "grotblim " * 50_000)] + [(61, "calm river")] * 5_000)
    model, without = toxicity.fit(huge, labels, o), toxicity.fit(docs_of(spark, rows), labels, o)
    assert 0 < len(model.grams) <= 40_000 and len(without.grams) > 0
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, [(1, "calm river stone"), (2, "grotblim awful")]), model).collect()}
    assert got[1] < 0.3 <= got[2]


def test_toxicity_with_few_labels(spark):
    rows = [(i, f"plain river stone {i}" + (" grotblim" * 3 if i % 10 == 0 else "")) for i in range(60)]
    docs = docs_of(spark, rows)
    for first in range(0, 60, 20):  # two toxic documents each, so a split by chance alone often lacks a class
        labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(first, first + 20)], "doc_id bigint, toxic int")
        model = toxicity.fit(docs, labels)
        assert model.curve[1:].any() and model.grams.size  # the curve is fitted
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert min(got[i] for i in range(0, 60, 10)) > max(got[i] for i in range(60) if i % 10)
    # a class with one document, or none: the share of toxic labels
    for ids, toxic, share in (([0, *range(1, 10)], {0}, 0.1), ([1, 2, 900], {900}, 1 / 3), ([901, 902, 903, 904], {904}, 0.25)):
        model = toxicity.fit(docs, spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id bigint, toxic int"))
        assert all(abs(r.score - share) < 1e-9 for r in toxicity.score(docs, model).collect())


def brute_components(rows, k=2, threshold=80):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("options", [minhash_dedup.Options(), minhash_dedup.Options(small=4, medium=2, max_levels=3)])
def test_near_duplicates_match_brute_force(spark, options):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for g in (0, 1):
        for _ in range(18):  # chains of near copies
            w = rows[g][1].split() if rng.random() < 0.5 else rows[-1][1].split()
            w[rng.integers(len(w))] = f"n{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "  ", "solo", "SOLO", "solo act"])]
    got = minhash_dedup.near_duplicates(docs_of(spark, rows), options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    got = minhash_dedup.near_duplicates(docs_of(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (3, None), (4, None), (4, None), (5, " \t"), (6, "d e f"), (6, "d e f")]
    clash = docs_of(spark, rows).withColumns({"_key": F.lit("own"), "key": F.lit(3), "vertex": F.lit(4)})
    kept = minhash_dedup.deduplicate(clash)
    assert sorted((r.doc_id, r.text or "", r._key, r.score) for r in kept.collect()) == [
        (1, "a b c", "own", "mine"), (3, "", "own", "mine"), (4, "", "own", "mine"), (4, "", "own", "mine"), (5, " \t", "own", "mine"), (6, "d e f", "own", "mine")]


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a bigint, b bigint")
    assert {r.id: r.root for r in components(links).collect()} == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_decontamination_spans_and_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, item)], "item_id bigint, text string")
    rows = [(10, f"x {item.upper()} y"), (11, "a Short, ONE b short one"), (12, " ".join(item.split()[:9])), (13, "clean text"), *EDGES]
    got = {r.doc_id: r for r in decontam.find(docs_of(spark, rows), items).select("doc_id", "items", "spans", decontam.words_hit().alias("n_hit")).collect()}
    assert got[10].items == ["1", "4"] and got[10].n_hit == 11 and len(got[10].spans) == 2
    assert got[11].items == ["2"] and got[11].n_hit == 4
    assert got[12].items == [] and got[13].n_hit == 0
    assert decontam.clean(docs_of(spark, rows), items).count() == len(rows) - 2
    assert decontam.clean(docs_of(spark, rows), items.limit(0)).count() == len(rows)


def brute_targets(rows):
    """Sizes and targets of the sources of (doc_id, text, source): cap and reshare until none is above."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * sizes[s] if s in capped else want[s] for s in names}
    return sizes, target


def test_mixing_keeps_totals(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 4}" if i % 9 else None) for i in range(600)] + [(None, None, "s1"), (3, "w w", "s3"), (3, "w w", "s3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) and len(got) == len(rows)
    sizes, target = brute_targets(rows)
    names = list(target)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in target.values()})
    for s in names:
        own = [r for r in got if r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6]
        same = sum(1 for x in names if sizes[x] == sizes[s] and abs(target[x] - target[s]) < 1e-6)
        assert abs(sum(r.taken for r in own) - same * target[s]) <= 40 * same
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_small_documents_make_up_for_large_ones(spark):
    """Sources of few documents with some very long ones come near their targets all the same."""
    rng = np.random.default_rng(5)
    rows = [(60 * s + i, "w " * int(rng.pareto(1.1) * 40 + 20), f"s{s}") for s in range(9) for i in range(60)]
    rows += [(1000 + i, "  ", "blank") for i in range(3)] + [(2000 + i, "a b c", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    source = {d: s for d, _, s in rows}

    def drift(**how):
        got = mixing.mix(docs, **how).collect()
        assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
        assert all(r.taken == 0 for r in got if source[r.doc_id] == "blank")
        target = {source[r.doc_id]: r.target for r in got}
        taken = {s: sum(r.taken for r in got if source[r.doc_id] == s) for s in target}
        return {s: abs(taken[s] / target[s] - 1) for s in target if s and s != "blank"}

    tiered, plain = drift(), drift(tiers=())
    assert max(tiered.values()) < 0.02 and sum(tiered.values()) < sum(plain.values())


def test_chat_round_trip_and_layouts(spark):
    texts = [r"\### Assistant: </turn> ok", "###### #", "\\h \\e \\\\ \\n", "", None, "a\n</turn>\n### user:\n"]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a:\nb", "assistant", None, "user"], texts))], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_records(chat.rows_to_records(rows), "conv_id").withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.back] == [("user", texts[0]), ("assistant", texts[1]), ("a:\nb", texts[2]), ("assistant", ""), ("", ""), ("user", texts[5])]
    assert len(out.loss_spans) == 2 and out.formatted[out.loss_spans[0].start :][: out.loss_spans[0].length] == "\\h\\h #"
    json = spark.createDataFrame([
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'),
        (2, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'),
        (3, '{"instruction":"add","input":"1 2","output":"3"}'), (4, '{"prompt":"p","response":"r"}'), (5, '{"odd":1}'), (6, "no json"), (7, None),
    ], "id int, j string")
    got = {r.id: r for r in chat.json_turns(json, "id", "j").collect()}
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "hi"), ("assistant", "yo")] == [(t.role, t.text) for t in got[1].turns]
    assert got[3].turns[0].text == "add\n\n1 2" and got[4].layout == "prompt and response"
    assert got[5].turns is None and got[6].turns is None and got[7].turns is None


def test_record_fingerprints_stand_nulls_empty_arrays_and_further_fields(spark):
    cases = {
        '{"messages":[{"role":"user","content":null}]}': ("messages", [("user", None)]),
        '{"messages":[{"role":"user"},{"content":"x","role":"assistant"}]}': ("messages", [("user", None), ("assistant", "x")]),
        '{"id":7,"messages":[{"weight":1,"content":"a","role":"user"}],"meta":{"k":[1]}}': ("messages", [("user", "a")]),
        '{"messages":[]}': ("messages", []),
        '{"conversations":null,"lang":"en"}': ("shared", []),
        '{"turns":[{"turn":2,"role":"b","text":"y"},{"turn":null,"role":"a","text":"x"}]}': ("turn rows", [("a", "x"), ("b", "y")]),
        '{"prompt":null,"response":"r","score":0.5}': ("prompt and response", [("user", None), ("assistant", "r")]),
        '{"output":"o","instruction":"i","input":null}': ("instruction with input", [("user", "i"), ("assistant", "o")]),
        '{"prompt":"p","messages":[]}': (None, None),
        '{"messages":[{"content":"no role"}]}': (None, None),
        '[{"prompt":"p","response":"r"}]': (None, None),
        "{}": (None, None),
        "": (None, None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, j string").withColumn("fingerprint", F.lit("mine"))
    got = {r.id: (r.layout, None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in chat.json_turns(df, "id", "j").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_conversations_of_the_query_come_in_six_layouts(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = [(9000 + k, i, r, t) for k in range(24) for i, r, t in ((0, "user", "q"), (1, "assistant", None if k % 7 else "a"))]
    made += [(9101, 0, "human", "h"), (9102, None, None, None), (9102, 0, "GPT", "")]
    records = chat.rows_to_records(docs.unionByName(spark.createDataFrame(made, "conv_id bigint, turn bigint, role string, text string")))
    got = chat.json_turns(queries._dealt_to_layouts(records), "conv_id", "json")
    assert {r.layout for r in got.select("layout").distinct().collect()} == {x.name for x in chat.LAYOUTS if x.name != "instruction"}
    direct = {r.conv_id: r.turns for r in chat.to_turns(records, "conv_id").collect()}
    plain = lambda turns: [(t.role or "", t.text or "") for t in turns]
    assert all(plain(r.turns) == plain(direct[r.conv_id]) for r in got.collect())


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 11 == 0).alias("bad"))
    cascade = url_filter.build(keys, F.xxhash64("key") % 5 == 0, bits_per_key=3)
    wrong = keys.where(cascade.contains(F.col("key")) != (F.xxhash64("key") % 5 == 0)).count()
    assert wrong == 0 and len(cascade.levels) > 1
    assert url_filter.build(keys.limit(0), F.lit(True)).levels == []
    urls = [None, "", "no scheme", "HTTP://EX.Org", "ftp://a.b?x/y", "x://example.org/es/a#b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(pages, queries.URL_RULES, url_filter.Cascade()).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None) and got[3] == ("ex.org", "", None)
    assert got[4] == ("a.b", "", None) and got[5] == ("example.org", "/es/a", "example.org/es/")


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü?x=1", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "http://c", "y" * 200_000), (5, "http://c", "y" * 200_000), (None, "n", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(0))
    folder, index = warc.archive(pages)
    back = warc.read(spark, folder, warc.frames_of(index)).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in back) == sorted(map(str, [
        (1, 9, "response", None), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 200_000, "response", None), (5, 200_000, "response", None), (None, 9, "revisit", 1)]))
    one = index.where("page_id = 1").first()
    fields, block = warc.read_record(folder, one.bundle, one.frame, one.offset)
    assert block.decode() == "<p>é</p>" and fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    assert warc.archive(pages.limit(0))[1].count() == 0


def plain_archive(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    rows, first, out = [(p, (t or "").encode()) for p, t in rows], {}, []
    for p, raw in rows:
        if p is not None:
            first[raw] = min(p, first.get(raw, p))
    for p, raw in rows:
        again = len(raw) >= least and first.get(raw, p) != p
        out.append((p, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk", [(0, 50_000), (0, 3), (40, 5)])
def test_warc_against_plain_python(spark, least, chunk):
    """Groups of equal payloads over many tasks and chunks, in rising, falling and mixed order of ids."""
    rng = np.random.default_rng(4)
    texts = ["", "short", "é" * 30, "a" * 500, None] + [f"page {i} " * 9 for i in range(20)]
    rows = [(int(i), texts[int(rng.integers(len(texts)))]) for i in rng.permutation(300)]
    rows += [(1000 - i, "a" * 500) for i in range(40)] + [(7, "twice")] * 6 + [(None, "twice"), (None, "alone"), (None, "alone")]
    pages = spark.createDataFrame([(p, f"http://h/{p}", t) for p, t in rows], "page_id bigint, url string, html string").repartition(6)
    folder = warc.scratch_path(spark, "warc-test")
    index = warc.write(warc.described(pages, least, chunk), folder)
    back = warc.read(spark, folder, warc.frames_of(index)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == plain_archive(rows, least)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in back)


def test_warc_ids_do_not_depend_on_the_run(spark):
    pages = spark.createDataFrame([(i, "u", f"t{i % 3}") for i in range(60)], "page_id bigint, url string, html string")
    ids = [sorted(r.record_id for r in warc.archive(p)[1].collect()) for p in (pages.repartition(5), pages.coalesce(1))]
    assert ids[0] == ids[1] and len(set(ids[0])) == 60
    again = pages.union(pages.where("page_id < 5")).union(pages.where("page_id < 5")).repartition(3)
    got = [r.record_id for r in warc.archive(again)[1].collect()]
    assert len(set(got)) == 70 and len(set(got) & set(ids[0])) == 55


def test_warc_revisits_are_not_shuffled(spark):
    """Of one payload in one task only the copies up to the smallest id keep it."""
    pages = spark.createDataFrame([(i, "u", "same") for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    assert warc.digested(pages).where("payload IS NOT NULL").count() == 1
    assert warc.digested(pages, least=5).where("payload IS NOT NULL").count() == 50


def test_warc_schemes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "one")], "page_id bigint, url string, html string")
    rows = warc.described(pages)
    for folder in (f"{tmp_path}/plain", f"file:{tmp_path}/uri", f"file://{tmp_path}/uri2"):
        index = warc.write(rows, folder)
        assert sorted((r.page_id, r.record_type) for r in warc.read(spark, folder, warc.frames_of(index)).collect()) == [(1, "response"), (2, "revisit")]
    assert {x.name for x in tmp_path.iterdir()} == {"plain", "uri", "uri2"}
    with pytest.raises(ValueError, match="cannot be kept"):
        warc.write(rows, "nosuch://host/folder")


def test_fingerprints_against_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: r for r in fingerprint.against_next(docs_of(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, x = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[4].fingerprint == got[5].fingerprint
    a, b = fingerprint.digests([np.frombuffer(b"some text " * 50, np.uint8), np.frombuffer(b"0123456789" * 50, np.uint8)])
    assert fingerprint.likeness(a[None], a[None])[0] == 1 > fingerprint.likeness(a[None], b[None])[0]
    assert fingerprint.against_next(docs_of(spark, [])).count() == 0


def test_ctw_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(f"{'abc'[i % 3]}{'xyz'[k % 3]}" * (k % 4) for k in range(9))) for i in range(20)]
    vocab = ctw.vocabulary(docs_of(spark, rows).withColumn("cls", F.lit(0)), 1)
    tree = ctw.train(vocab, [20], ctw.Options(depth=3))
    for context in (b"", b"\x01", b"\x01a", b"axa", b"qqq"):
        head = int.from_bytes(context, "big") << 8
        p = 10 ** tree.log10(np.array([head | b for b in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-4
    got = ctw.score(docs_of(spark, rows + EDGES), F.lit(False)).collect()
    assert len(got) == len(rows) + len(EDGES) and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    untrained = ctw.score(docs_of(spark, EDGES), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_license_scan(spark):
    rows = [(101, "Some prose.\nReleased under the MIT License.\nmore"), (102, "the general public was licensed to sell"), (103, "This work is licensed under the GNU General Public License, version 3."), *EDGES]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert got[101].families == ["mit"] and got[101].hits[0].paragraph == 1 and got[101].n_paragraphs == 3
    assert got[103].families == ["gpl"] and not got[102].families and not got[7].families


def test_license_families_and_identifiers(spark):
    said = {
        "Licensed under the GNU Affero General Public License, version 3": ["agpl"],
        "licensed under the GNU Lesser General Public License, version 3": ["lgpl"],
        "This work is licensed under the GNU General Public License, version 3": ["gpl"],
        "Licensed under the ISC license": ["isc"], "Released under the zlib License": ["zlib"],
        "available under the terms of the Eclipse Public License 2.0": ["epl"], "Licensed under the EUPL, version 1.2": ["eupl"],
        "Distributed under the Boost Software License, Version 1.0": ["bsl-1.0"],
        # one word off is another licence
        "Released under the Foo License": [], "Licensed under the Garden License, Version 2.0": [],
        "subject to the terms of the Garden Public License, version 2.0": [], "SPDX-License-Identifier: Foo": [],
        "a license to drive is granted to any person without charge": [],
    } | {f"// SPDX-License-Identifier: {name}": [family] for family, name in licenses.SPDX.items()}
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(corpus, licenses.Options(max_rows=100, max_lines=500))
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")
    got = {r.doc_id: r.families for r in licenses.scan(docs, model).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_license_probabilities_are_calibrated(spark):
    """On examples the fit has not seen, predictions made at a probability are right about as often."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(docs)
    lines, y = licenses._examples(licenses.Options(copies=20), np.random.default_rng(99))
    gram, row, _ = licenses._ngrams(licenses._chunk_of(lines))
    at = np.minimum(np.searchsorted(model.features, gram), len(model.features) - 1)
    ok = model.features[at] == gram
    x = np.zeros((len(lines), len(model.features)), np.float32)
    x[row[ok], at[ok]] = 1
    # shuffled words that hold much of a notice by chance are no examples of "unknown", here as in the fit
    chance = ((model.template_pairs(x) / model.notice_size).max(1) >= 0.4) & (np.array(y) == len(licenses.FAMILIES) - 1)
    assert chance.mean() < 0.2
    p = model.probabilities(x[~chance])
    right = p.argmax(1) == np.array(y)[~chance]
    assert right.mean() > 0.95 and abs(p.max(1).mean() - right.mean()) < 0.05


def test_license_scan_wrapped_and_several(spark):
    gpl, lgpl = "This work is licensed under the GNU General Public License, version 3", "licensed under the GNU Lesser General Public License, version 3"
    rows = [
        (201, "Some prose here.\nThis work is licensed under the\nGNU General Public License, version 3\nmore prose"),
        (202, f"A title. Released under the MIT License. Some words between them. {gpl}. The end."),
        (203, "\n".join(f"# {w}" for w in "Redistribution and use in source and binary forms with or without modification are permitted".split())),
        (204, "plain words " * 4000 + "Licensed under CC BY-SA 4.0 " + "plain words " * 4000 + "Released under the BSD License"),
        (205, lgpl.replace("GNU ", "GNU\n")), (206, "This work is\nlicensed to the general\npublic"),
        (207, "This work is licensed under the"), (208, "GNU General Public License, version 3"),
        (209, "Released under the MIT License\n" * 3),
    ]
    docs = docs_of(spark, rows).coalesce(1)
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    want = {201: ["gpl"], 202: ["gpl", "mit"], 203: ["bsd"], 204: ["bsd", "cc-by-sa"], 205: ["lgpl"], 206: [], 207: [], 209: ["mit"]}
    assert {k: got[k].families for k in want} == want
    assert [(h.paragraph, h.family) for h in got[201].hits] == [(1, "gpl")] and len(got[209].hits) == 3


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out


def test_warc_frames_are_read_by_many_tasks(spark):
    frames = warc.frames_of(spark.range(400).select(F.lit("b").alias("bundle"), F.col("id").cast("int").alias("frame")))
    tasks = frames.select(F.spark_partition_id().alias("p")).distinct().count()
    assert frames.count() == 400 and tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_rows(spark):
    """Documents with nulls in every column, long, blank and repeated texts and clashing extra columns."""
    rows = [(d, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None) for i, (d, t) in enumerate(EDGES)] + [(None, None, None, None)] * 2
    rows += [(100 + i, " ".join(f"plain{(i * 7 + k) % 50}" for k in range(30)), "en", "s1") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = ["score", "mean", "peak", "row", "key", "_key", "digest", "n_words", "size", "target", "spans", "items", "kept", "vertex"]
    return docs.withColumns({c: F.lit(f"own {c}") for c in extra})


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_edge_rows(spark, empty):
    import corpus_pipeline

    docs = stage_rows(spark)
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "mixing":
            assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == docs.count()
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r.score == "own score" and r._key == "own _key" and r.digest == "own digest" for r in rows)
        was, now = ({str(r) for r in x} for x in (docs.collect(), rows))
        assert now <= was and empty == (not now)
        if name != "near_duplicates":
            assert len(rows) == docs.count()  # clean rows all stay
        docs = spark.createDataFrame(rows, docs.schema)


def test_operators_on_edge_rows(spark):
    docs = stage_rows(spark)
    n = docs.count()
    assert fingerprint.against_next(docs).count() == n == fingerprint.fingerprints(docs).count()
    assert ctw.score(docs, F.pmod("doc_id", F.lit(10)) == 0, F.col("lang")).count() == n
    assert ctw.score(docs.limit(0), F.lit(False), F.col("lang")).count() == 0
    assert mixing.mix(docs).count() == n and decontam.find(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == n
    model = licenses.fit(docs)
    assert licenses.scan(docs, model).count() == n and licenses.scan(docs.limit(0), licenses.fit(docs.limit(0))).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, spark.createDataFrame([(100, 1), (101, 0), (102, None), (None, 1)], "doc_id bigint, toxic int"))).count() == 0
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, None, "assistant", "x" * 50_000)], "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("own"))
    out = chat.format_records(chat.rows_to_records(turns), "conv_id").withColumn("back", chat.read_back(F.col("formatted")))
    assert {r.conv_id: len(r.back) for r in out.collect()} == {None: 1, 1: 2, 2: 1}
    assert chat.format_records(chat.rows_to_records(turns.limit(0)), "conv_id").count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "http://a.org/x", "h"), (1, "http://a.org/x", "h"), (2, "http://" + "y" * 60_000, "")], "page_id bigint, url string, html string").withColumns({"host": F.lit("own"), "rule": F.lit(1), "key": F.lit(2), "digest": F.lit(3)})
    assert url_filter.judge(pages, queries.URL_RULES, url_filter.Cascade()).count() == 4
    folder, index = warc.archive(pages)
    assert warc.read(spark, folder, warc.frames_of(index)).count() == 4


def test_ctw_keeps_every_byte_string(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 12)), "xyz"[i % 3], i % 5 == 0) for i in range(120)] + [(900, "unheard banana", "x", True), (901, None, None, False)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, out boolean")
    o = ctw.Options(piece=50, max_frequent=20)
    ends = [sum(1 for r in rows if not r[3] and r[2] == c) for c in (None, "x", "y", "z")]
    most = sorted("xyz", key=lambda c: (-ends[" xyz".index(c)], c))
    ends = [ends[0], *[ends[" xyz".index(c)] for c in most]]
    # the whole tree, grown in one piece from plain Python's counts
    n = {}

    def add(k, string, times=1):
        for d in range(8):
            gram = (d, int.from_bytes(string[-d - 1 :], "big"))
            n[gram] = n.get(gram, 0) + times

    for _, text, lang, out in rows:
        k = 1 + most.index(lang) if lang else 0
        if not out:
            add(k, bytes([1 + k, 0x0A]))
            for w in split(text):
                s = bytes([1 + k]) + w.encode() + b" "
                for i in range(2, len(s) + 1):
                    add(k, s[:i])
    levels = [sorted((g, c) for (d, g), c in n.items() if d == depth) for depth in range(8)]
    tree = ctw.grow([np.array([g for g, _ in x], np.uint64) for x in levels], [np.array([c for _, c in x], float) for x in levels])

    def log10(k, text):
        total = tree.log10(np.array([(1 + k) << 8 | 0x0A], np.uint64))[0] + np.log10((ends[k] + 0.5) / (sum(ends) + 2))
        for w in split(text):
            s = bytes([1 + k]) + w.encode() + b" "
            total += tree.log10(np.array([int.from_bytes(s[max(0, i - 8) : i], "big") for i in range(2, len(s) + 1)], np.uint64)).sum()
        return total

    got = {r.doc_id: r.score for r in ctw.score(docs, F.col("out"), F.col("lang"), o).collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        want = np.log10(sum(10 ** (log10(k, text) + 60) for k in range(4))) - 60
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want) / 10), (i, got[i], want)


def test_ctw_base_columns_match_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(i % 9))) for i in range(60)] + [(70, "never seen w1 never"), (71, None)]
    held = {i for i, _ in rows if i % 10 == 0 or i == 71}
    n, docs = {}, 0
    for i, t in rows:
        if i not in held:
            docs += 1
            for w in split(t):
                n[w] = n.get(w, 0) + 1
    total = sum(n.values()) + docs
    z = total + 0.1 * (len(n) + 2)
    out = F.pmod("doc_id", F.lit(10)).isin(0) | (F.col("doc_id") == 71)
    for most in (5, 1 << 19):  # words met in a join, words at hand
        got = {r.doc_id: r for r in ctw.score(docs_of(spark, rows), out, o=ctw.Options(max_frequent=most)).collect()}
        for i, t in rows:
            words, r = split(t), got[i]
            want = sum(np.log10((n.get(w, 0) + 0.1) / z) for w in words) + np.log10((docs + 0.1) / z)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(words) + 1, sum(w in n for w in words) + 1, total)
            assert abs(r.base_score - want) < 1e-9 * max(1, abs(want))


def test_pipeline_near_duplicates_match_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice([f"w{i}" for i in range(200)], 80))) for i in range(10)]
    for g in range(4):  # near copies, and copies too far apart
        for changes in (1, 1, 2, 6):
            w = rows[g][1].split()
            for _ in range(changes):
                w[rng.integers(len(w))] = f"n{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    want = {d for d, (_, root) in brute_components(rows, k=5).items() if d == root}
    assert 10 < len(want) < len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows), SF).collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)


def plain_windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_pipeline_run_against_plain_python(spark, tmp_path):
    """Every stage, and all in a row, over planted toxic rows, copies and benchmark passages."""
    import corpus_pipeline

    rng = np.random.default_rng(21)
    calm = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    foul = ["zwg" + "".join(rng.choice(list("kqxzwg"), 4)) for _ in range(20)]
    said = lambda words, n: " ".join(rng.choice(words, n))
    texts = [said(calm, 80) for _ in range(90)]
    toxic = set(range(90, 150))
    texts += [said(calm, 20) + " " + said(foul, 20) for _ in toxic]
    for g in range(0, 24, 2):  # exact, near (0.88) and too distant copies
        w = texts[g].split()
        w[40] = "changed"
        far = w.copy()
        far[5] = far[60] = "other"
        texts += [texts[g], " ".join(w), " ".join(far)]
    items = [(i, said(calm, 14)) for i in range(6)] + [(6, "only three words"), (None, None)]
    for _, t in items[:7]:
        texts.append(said(calm, 30) + " " + t + " " + said(calm, 30))
    rows = [(int(d), t, f"s{int(d) % 4}" if d % 11 else None) for d, t in zip(rng.permutation(len(texts)), texts)]
    ids = [d for d, _, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(ids[i], 1, int(i in toxic)) for i in range(150)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    clean = [r for i, r in enumerate(rows) if i not in toxic]
    roots = brute_components([r[:2] for r in clean], k=5)
    first = [r for r in clean if roots[r[0]][1] == r[0]]
    benchmark = [plain_windows(t) for _, t in items]

    def hit(text):
        w = re.findall(r"[a-z]+", text)
        return any(tuple(w[i : i + len(x)]) == x for b in benchmark for x in b for i in range(len(w) - len(x) + 1))

    left = [r for r in first if not hit(r[1])]
    assert len(rows) - len(clean) == 60 and len(clean) - len(first) == 24 and len(first) - len(left) == 7
    want = [clean, first, left]
    spark_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        got = stage(spark, spark_docs, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in kept), name
        spark_docs = spark.createDataFrame(got, docs.schema)
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes, target = brute_targets(left)
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in mixed) == sorted((d, len(split(t)), sizes[s], round(target[s], 6)) for d, t, s in left)
    source = {d: s for d, _, s in left}
    for s in target:
        own = [r for r in mixed if source[r.doc_id] == s]
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own) and abs(sum(r.taken for r in own) - target[s]) <= 100
