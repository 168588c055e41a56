"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of WARC
records up to ``frame_bytes`` of content, closed by a footer: a skippable
frame with the seek table (compressed and content size of every frame). Any
zstd reader reads the file from start to end, and one record is read by
decompressing a single frame: the index maps each record id to bundle, frame
and offset inside the frame's content.

Files are written by the tasks through the file system that the folder's
URI names (Hadoop's names of a scheme are mapped to pyarrow's; one that it
cannot open raises before any work), under a name of the task attempt, and
moved to their final name when complete; the index lists only final names.
Equal payloads of at least ``least`` bytes are stored once: the record with
the smallest page_id is the response, the others revisit it. Which record
that is gets decided on digests and ids; a payload whose row is a revisit
already beside the rows of its own task is not shuffled at all.

A record's id is a name-based UUID of page_id and digest, so writing the same
pages again gives the same ids however they are dealt to tasks; only rows that
share both add their task and place to it.

Defined cases: a null html is an empty payload; rows that share page_id and
payload are all response; a null page_id never is the smallest, unless the
payload has no other; a null url is written as an empty target. Extra
columns are ignored. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.llm.tables import scratch_path, stored

# Fixed values of the seekable format: skippable frame and seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HEAD = "WARC/1.1"
_INDEX = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes | None, kind: str, refers_to, digest: str, size: int, record_id: str) -> bytes:
    """One WARC record; a revisit has no content of its own."""
    block = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", "" if page_id is None else str(page_id)), ("Payload-Length", str(size)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return (HEAD + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(content: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(fields, block, end) of the record at an offset."""
    stop = content.index(b"\r\n\r\n", at)
    lines = content[at:stop].decode().split("\r\n")
    if lines[0] != HEAD:
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    return fields, content[begin:end], end + 4


def footer(frames: list[tuple[int, int]]) -> bytes:
    """Seek table as a skippable frame: (compressed, content) sizes, then count, flags and magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(f) -> list[tuple[int, int, int]]:
    """(file offset, compressed size, content size) of the frames of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, out, at = f.read(8 * n), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, c, d))
        at += c
    return out


def file_system(uri: str):
    """File system and path of a folder's URI (a plain path is a local or mounted folder).

    Raises ValueError for a scheme that pyarrow cannot open. Credentials of
    object stores come from the environment of the tasks.
    """
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if scheme in ("file", "dbfs"):
        return fs.LocalFileSystem(), ("/dbfs/" if scheme == "dbfs" else "/") + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"bundles cannot be kept under {uri}: {e}") from e


_DIGESTED = "page_id bigint, url string, payload binary, size bigint, digest string, key string, part bigint, place bigint"


def _own(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))


def digested(pages: DataFrame, least: int = 0, chunk_rows: int = 50_000) -> DataFrame:
    """Rows with size, SHA-1, key (SHA-256), chunk of a task (``part``) and place among equal rows of the chunk.

    The payload is null where the same chunk has met it under a smaller
    page_id before: such a row is a revisit whatever else the table holds. A
    chunk remembers at most ``chunk_rows`` keys.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        smallest, met = {}, {}
        for b in batches:
            payload, keep = b.column("payload"), []
            size, digest, key, parts, place = [], [], [], [], []
            for page, value in zip(b.column("page_id").to_pylist(), payload):
                raw = value.as_buffer()
                k = hashlib.sha256(raw).hexdigest()
                if len(met) >= chunk_rows:
                    part, smallest, met = part + 1, {}, {}
                least_id = smallest.get(k)
                keep.append(raw.size < least or least_id is None or (page is not None and page <= least_id))
                if page is not None and (least_id is None or page < least_id):
                    smallest[k] = page
                met[k, page] = met.get((k, page), -1) + 1
                size.append(raw.size)
                digest.append(base64.b32encode(hashlib.sha1(raw).digest()).decode())
                key.append(k)
                parts.append(part)
                place.append(met[k, page])
            kept = pc.if_else(pa.array(keep, pa.bool_()), payload, pa.scalar(None, payload.type))
            columns = [b.column("page_id"), b.column("url"), kept, pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(key, pa.string()), pa.array(parts, pa.int64()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "payload", "size", "digest", "key", "part", "place"])

    return _own(pages).mapInArrow(run, _DIGESTED)


def described(pages: DataFrame, least: int = 0, chunk_rows: int = 50_000) -> DataFrame:
    """(page_id, url, payload, size, digest, place, record_type, refers_to): which record stands for equal payloads.

    Verdicts are found on keys and ids alone, for (key, page_id), which
    spreads the rows of one payload over many tasks. ``place`` tells rows
    apart that share page_id and payload; it is empty for others.
    """
    key = F.coalesce(F.sha2("payload", 256), F.lit(""))  # never null, so both uses of ``rows`` are one exchange
    rows = _own(pages).select(key.alias("key"), "page_id").groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.sum("n").alias("copies"))
    verdicts = rows.join(first.where("copies > 1"), "key", "left").select(F.col("key").alias("k"), F.col("page_id").alias("p"), "first", "n")
    met = digested(pages, least, chunk_rows).join(verdicts, (F.col("key") == F.col("k")) & F.col("page_id").eqNullSafe(F.col("p")))
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest",
        F.when(F.col("n") > 1, F.concat_ws("/", "part", "place")).otherwise("").alias("place"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def write(rows: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write ``described`` rows as bundles under ``folder``; the index (record_id, page_id, bundle, frame, offset, length)."""
    file_system(folder)  # raises here, not in the tasks

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        number = 0
        out, frames, content, index, held = None, [], [], [], 0
        name = temp = None

        def flush():
            nonlocal content, held
            raw = b"".join(content)
            packed = packer.compress(raw)
            out.write(packed)
            frames.append((len(packed), len(raw)))
            content, held = [], 0

        def close():
            nonlocal out, frames, index, number
            if content:
                flush()
            out.write(footer(frames))
            out.close()
            fs.move(temp, f"{root}/{name}")  # complete bundles only have final names
            done = pa.RecordBatch.from_pylist(index, schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            out, frames, index, number = None, [], [], number + 1
            return done

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"bundle-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
                    temp = f"{root}/.{name}.part"
                    out = fs.open_output_stream(temp)
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']}/{r['digest']}/{r['place']}"))
                rec = record(r["page_id"], r["url"], r["payload"], r["record_type"], r["refers_to"], r["digest"], r["size"], record_id)
                index.append({"record_id": record_id, "page_id": r["page_id"], "bundle": name, "frame": len(frames), "offset": held, "length": len(rec)})
                content.append(rec)
                held += len(rec)
                if held >= frame_bytes:
                    flush()
                    if sum(f[0] for f in frames) >= bundle_bytes:
                        yield close()
        if out is not None:
            yield close()

    # the index is stored at once: it names the attempts whose bundles count
    return stored(rows.mapInArrow(run, _INDEX), "warc-index")


def frames_of(index: DataFrame) -> DataFrame:
    """(bundle, frame): one row per frame, dealt to as many tasks as a shuffle has partitions.

    The rows are tiny but stand for whole frames, so they must not be merged
    into few tasks by size; hence the given number. They are dealt by a hash:
    by the columns of ``distinct`` themselves the repartition would be
    dropped as redundant, and its shuffle merged by size after all.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("bundle", "frame").distinct().repartition(n, F.xxhash64("bundle", "frame"))


_READ = "record_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(spark: SparkSession, folder: str, frames: DataFrame) -> DataFrame:
    """Records of frames, found by the seek tables; payloads of responses are checked against their digests."""

    def run(batches):
        import zstandard

        fs, root = file_system(folder)
        tables = {}
        for b in batches:
            for bundle, frame in zip(b.column("bundle").to_pylist(), b.column("frame").to_pylist()):
                with fs.open_input_file(f"{root}/{bundle}") as f:
                    if bundle not in tables:
                        tables = {bundle: seek_table(f)}
                    at, packed, size = tables[bundle][frame]
                    f.seek(at)
                    content = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
                rows, at = [], 0
                while at < len(content):
                    fields, block, at = parse(content, at)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and base32_sha1(block) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                    rows.append({
                        "record_id": fields["WARC-Record-ID"][10:-1], "page_id": int(fields["Page-ID"]) if fields["Page-ID"] else None, "url": unquote(fields["WARC-Target-URI"]),
                        "payload_bytes": int(fields["Payload-Length"]), "payload_digest": digest, "record_type": kind,
                        "refers_to": int(fields["WARC-Refers-To-Page"]) if kind == "revisit" else None, "payload": block if kind == "response" else None,
                    })
                kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return frames.mapInArrow(run, _READ)


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: a single frame is decompressed."""
    import zstandard

    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        at, packed, size = seek_table(f)[frame]
        f.seek(at)
        content = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
    return parse(content, offset)[:2]


def archive(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write ``pages`` to a new folder under the shared one: (folder, index)."""
    folder = scratch_path(pages.sparkSession, "warc")
    file_system(folder)
    return folder, write(described(pages, least), folder)
