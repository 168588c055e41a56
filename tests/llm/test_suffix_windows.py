"""Windows of crowded keys: dealt as arrays, not row by row; told apart beyond their hashes; nothing lost on the way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerlake.llm import suffix_dedup as S

LENGTH = 80


def crowd(spark, n):
    """Texts with one passage between bytes of their own, so that its grams have ``n`` contexts each."""
    rng = np.random.default_rng(4)
    own = lambda: "".join(rng.choice(list("abcdefgh"), 70))
    passage = "one passage that stands in the middle of every text, and a little more of the same."
    return spark.createDataFrame([(i, own() + passage + own()) for i in range(n)], "doc_id bigint, text string")


def test_windows_of_a_crowded_key_are_no_rows(spark):
    held = []
    docs = crowd(spark, 300)
    S.repeated_pieces(docs, held, LENGTH, limit=1).count()
    contexts = held[-1].where("crowded")
    windows = contexts.selectExpr(f"sum(floor(place % {S._PLACE} % 512) - floor(place % {S._PLACE} / 512) + 1) AS n").first().n
    rows = contexts.coalesce(2).mapInArrow(S._windows(LENGTH, 4), S._DEALT)
    sent = rows.agg(F.sum(F.octet_length("window") / 8).alias("n"), F.count("window").alias("rows")).first()
    for df in held:
        df.unpersist()
    assert windows > 5000 and sent.n == windows and sent.rows <= 2 * 4


def dealt(rows):
    cols = dict(zip(S._DEALT_ARROW.names, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in S._DEALT_ARROW], schema=S._DEALT_ARROW)


def asked(chunk, window, id_, key):
    return 0, chunk, 0, None, np.array(window, np.uint64).tobytes(), np.array(id_, np.uint32).tobytes(), np.array(key, np.uint32).tobytes()


def test_windows_of_one_hash_and_other_keys_are_told_apart():
    # hash 7: keys 1, 2, 1; hash 8: two of one key; hash 9: one, of a context that stands twice
    rows = [asked(5, [7, 7, 8, 9], [0, 1, 2, 3 | S._MANY], [1, 2, 3, 4]), asked(6, [7, 8], [10, 11], [1, 3])]
    got = {r["chunk"]: np.frombuffer(r["id"], np.uint32).tolist() for b in S._met_twice(iter([dealt(rows)])) for r in b.to_pylist()}
    assert got == {5: [0, 2], 6: [10, 11]}


def test_lost_windows_are_noticed():
    own = np.array([[1], [200], [90 * S._PLACE]], np.int64).tobytes()
    row = lambda *v: S._row(S._MET_ARROW, *v)
    ids = np.array([3, 4, 9], np.uint32).tobytes()
    pieces = list(S._flagged(LENGTH)(iter([row(5, 1, own, None), row(5, 0, None, ids)])))
    assert pieces[0].to_pylist() == [{"t": 1, "size": 200, "start": 86, "stop": 167}, {"t": 1, "size": 200, "start": 81, "stop": 161}]
    for rows in ([row(5, 2, own, None), row(5, 0, None, ids)], [row(5, 1, own, None), row(6, 0, None, ids)]):
        with pytest.raises(RuntimeError):
            list(S._flagged(LENGTH)(iter(rows)))
