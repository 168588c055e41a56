"""Document fingerprints: a digest of quartiles of byte-triplet buckets.

Every window of five bytes gives four hashed byte triplets (with the
window's first byte); they are counted in ``BUCKETS`` buckets. A bucket is
encoded by the quartile of the text's counts it falls into (two bits), the
length by its logarithm (one byte). The difference of two digests adds up
the distances between the quartiles of all buckets and between the lengths;
it is bounded, so likeness = 1 - difference / bound lies between 0 and 1.

Defined cases: a null text counts as empty; texts too short for a triplet
have all buckets in the lowest quartile, so they differ by length only;
equal texts have equal digests. The digest reads whole texts, byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerlake.llm import words as W
from tickerlake.llm.tables import stored

BUCKETS = 256
# Bytes of a window that make a triplet with its first byte.
PAIRS = ((1, 2), (1, 3), (2, 3), (2, 4))
LENGTH_WEIGHT = 2
BOUND = 3 * BUCKETS + 255 * LENGTH_WEIGHT


def digests(texts: list[np.ndarray]) -> np.ndarray:
    """Rows x (BUCKETS / 4 + 1) bytes: digests of byte arrays."""
    size = np.array([len(t) for t in texts], np.int64)
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for i, j in W.spans(np.concatenate([[0], np.cumsum(size)])):
        data = np.concatenate(texts[i:j]).astype(np.uint32) if j > i else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(j - i, dtype=np.int64), size[i:j])
        total = np.zeros((j - i) * BUCKETS, np.int64)
        for salt, (a, b) in enumerate(PAIRS):
            n = len(data) - b
            if n <= 0:
                continue
            code = data[:n] | (data[a : a + n] << np.uint32(8)) | (data[b : b + n] << np.uint32(16))
            code = (code + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            bucket = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(24)
            whole = row[:n] == row[b : b + n]  # no triplet runs over the end of its text
            total += np.bincount(row[:n][whole] * BUCKETS + bucket[whole], minlength=len(total))
        counts[i:j] = total.reshape(j - i, BUCKETS)
    edges = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > edges[:, None, :]).sum(2).astype(np.uint8)
    packed = (code.reshape(len(texts), -1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(2).astype(np.uint8)
    length = np.minimum(np.round(np.log(np.maximum(size, 1)) * 8) + (size > 0), 255).astype(np.uint8)
    return np.concatenate([length[:, None], packed], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - difference / bound of digests, row by row."""
    shift = np.array([6, 4, 2, 0], np.uint8)
    qa, qb = ((x[:, 1:, None] >> shift & 3).astype(np.int64) for x in (a, b))
    diff = np.abs(qa - qb).sum((1, 2)) + LENGTH_WEIGHT * np.abs(a[:, 0].astype(np.int64) - b[:, 0].astype(np.int64))
    return 1 - diff / BOUND


def _hex(d: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in d], pa.string())


def fingerprints(docs: DataFrame, column: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of a text column in hexadecimal."""
    own = docs.drop(to)
    schema = T.StructType(own.schema.fields + [T.StructField(to, T.StringType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                raw, offs = W.text_buffers(part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, _hex(digests([raw[x:y] for x, y in zip(offs[:-1], offs[1:])]))], names=schema.names)

    return own.mapInArrow(run, schema)


_ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    import hashlib

    edited = []
    for t, x in zip(texts, nexts):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + x[:half])
    raw = [[np.frombuffer(s.encode(), np.uint8) for s in side] for side in (texts, edited, nexts)]
    own, ed, nx = (digests(r) for r in raw)
    sha = [hashlib.sha256(s.encode()).hexdigest() for s in edited]
    cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), _hex(own), _hex(ed), pa.array(likeness(own, ed)), pa.array(likeness(own, nx))]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])


def against_next(docs: DataFrame, rows_at_once: int = 256) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    The next document is the one after it by descending doc_id (nulls last,
    ties by text hash), after the last the first. Documents are dealt by
    range and sorted, so neighbours meet inside a partition; of each
    partition only the first and last document meet those of the others, in
    a join over one row per partition.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    # the id leads, and the hash splits an id that very many rows share
    dealt = texts.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def pairs(batches):
        from pyspark import TaskContext

        none = {k: None for k in ("first_text", "last_text")}
        part, first, ids, held = TaskContext.get().partitionId(), None, [], []

        def flush(nexts):
            out = _compared(ids[: len(nexts)], held[: len(nexts)], nexts)
            blank = pa.nulls(out.num_rows, pa.string())
            return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.int32()), blank, blank], names=[*out.schema.names, "part", *none])

        for b in batches:
            for i in range(0, b.num_rows, rows_at_once):
                ids += b.column("doc_id").slice(i, rows_at_once).to_pylist()
                held += b.column("text").slice(i, rows_at_once).to_pylist()
                first = held[0] if first is None else first
                if len(held) > 1:
                    yield flush(held[1:])
                    ids, held = ids[-1:], held[-1:]
        if held:
            cols = [pa.array(ids, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2, pa.array([part], pa.int32()), pa.array([first]), pa.array(held)]
            yield pa.RecordBatch.from_arrays(cols, names=[*[c.split()[0] for c in _ROW.split(", ")], "part", *none])

    met = stored(dealt.select("doc_id", "text").mapInArrow(pairs, _ROW + ", part int, first_text string, last_text string"), "neighbours")
    edges = met.where("part IS NOT NULL").select("doc_id", "part", "first_text", "last_text")
    # one row per partition; the last one's next is the first of all
    w = Window.partitionBy(F.lit(0)).orderBy("part")
    place = edges.select("part", F.lead("part").over(w).alias("after"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("top"))
    follow = place.select("part", F.coalesce("after", "top").alias("after"))
    last = edges.join(follow, "part").join(edges.select(F.col("part").alias("after"), F.col("first_text").alias("next_text")), "after")

    def finish(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows_at_once):
                p = b.slice(i, rows_at_once)
                yield _compared(*(p.column(c).to_pylist() for c in ("doc_id", "last_text", "next_text")))

    ends = last.select("doc_id", "last_text", "next_text").mapInArrow(finish, _ROW)
    return met.where("part IS NULL").drop("part", "first_text", "last_text").unionByName(ends)
