"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of page_id. The bounds are exact: ids and sizes are sorted by range, each range's
bytes are counted, and a shard ends where the running sum passes a multiple of its size, so they do not depend on
partitioning. Records are sorted within a shard and rolled into files by compressed size. A task writes each file under
a temporary name of its own and renames it; the manifest, a table of the files, is written by Spark and renamed last. A
file's bytes follow from its records alone, so a task that runs twice leaves the same file. Readers take only files of
the manifest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, new_path, release, small_batches, table

#: Payloads under this size are never deduplicated.
LEAST_REVISIT = 1000
#: A file is closed at the first record that takes it to this many compressed bytes.
ROLL_BYTES = 8 << 20
#: Payload bytes of a shard, about.
SHARD_BYTES = 16 << 20
#: Tasks that write; where there are more shards, a task writes several in turn.
WRITERS = 20_000
#: Bytes read at once, and bytes of payloads in a batch of records.
READ_BYTES, OUT_BYTES = 1 << 20, 4 << 20
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _record_id(page_id: int) -> str:
    return f"<urn:helixframe:page:{page_id}>"


def _b32(hex_digest: str) -> str:
    import base64

    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as f:
        f.write(raw)
    return out.getvalue()


def info_member(shard: int, number: int) -> bytes:
    fields = b"software: helixframe\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:helixframe:file:{shard}-{number}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], fields)


def page_member(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the whole payload, or a revisit that keeps only the regenerated HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _b32(hashlib.sha1(payload).hexdigest())),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).hexdigest())),
    ]
    if refers_to is not None:
        headers[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to))]
    return _member(headers, block)


def _bounds(pages: DataFrame, shard_bytes: int) -> np.ndarray:
    """Least page_id of each shard (8 bytes a shard). Three jobs, whatever the ids; rows of one page_id stay together."""
    size = (F.octet_length("html") + 200).cast("long")
    dealt = pages.select("page_id", size.alias("n")).repartitionByRange("page_id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "sizes")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = dealt.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = W.partitionBy("part").orderBy("page_id", "n").rowsBetween(W.unboundedPreceding, -1)
    at = dealt.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, "part")
    shards = at.select("page_id", F.expr(f"(start + at) div {shard_bytes}").alias("shard")).groupBy("shard").agg(F.min("page_id").alias("least"))
    out = np.unique(shards.select("least").toArrow().column("least").to_numpy())
    release(dealt)
    return out


MANIFEST = "file string, shard int, number int, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html; others ignored) under ``path``; returns the manifest, a row per file.

    Null html is an empty payload, null url an empty one; rows with a null page_id have no place and raise.
    Of equal payloads (by 512 bits of SHA-2) of at least ``least_revisit`` bytes the one with the largest page_id is the
    response and the others revisit it. Repeated page_ids stay: of repeats of a response, all are responses. An empty
    table leaves an empty manifest. A record is held in memory whole, its file and the rest of its shard are not.
    """
    spark = pages.sparkSession
    pages = pages.select(F.expr("coalesce(page_id, raise_error('page_id is null'))").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    bounds = _bounds(pages, shard_bytes)
    keyed = pages.filter(F.octet_length("html") >= least_revisit).select("page_id", F.sha2("html", 512).alias("key"))
    last = keyed.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    # The references travel with the pages through one shuffle: a page's reference sorts just before it.
    refers = keyed.join(last, "key").filter("page_id != last").select("page_id", F.lit("").alias("url"), F.col("key").alias("html"), "last")
    both = refers.unionByName(pages.withColumn("last", F.lit(None).cast("long")))
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array) -> pa.Array:
        return pa.array(np.maximum(np.searchsorted(shared.value, page_id.to_numpy(zero_copy_only=False), side="right") - 1, 0), pa.int32())

    tasks = max(1, min(WRITERS, len(bounds)))
    task = F.expr(f"cast(shard * {tasks}L div {max(1, len(bounds))} as int)")
    dealt = both.withColumn("shard", shard_of("page_id")).repartitionById(tasks, task)
    dealt = dealt.sortWithinPartitions("shard", "page_id", F.col("last").isNull(), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = _fs(path)
        shard, number, count, size, digest, sink, temporary = None, 0, 0, 0, None, None, ""

        def add(member: bytes):
            nonlocal size
            sink.write(member)
            digest.update(member)
            size += len(member)

        def begin():
            nonlocal digest, sink, temporary, size, count
            temporary, digest, size, count = f"{root}/_temporary/{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
            sink = fs.open_output_stream(temporary)
            add(info_member(shard, number))

        def close():
            nonlocal sink
            sink.close()
            sink = None
            name = f"shard-{shard:06d}-{number:05d}.warc.gz"
            if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                fs.move(temporary, f"{root}/{name}")
            else:  # an attempt before this one left it, with the same bytes
                fs.delete_file(temporary)
            return name, shard, number, count, size, digest.hexdigest()

        files = []
        own: dict[str, int] = {}
        owner = None
        for batch in batches:
            for s, page, url, html, ref in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "last")), strict=True):
                if (s, page) != owner:
                    owner, own = (s, page), {}
                if ref is not None:
                    own[html] = ref
                    continue
                if s != shard:
                    if sink:
                        files.append(close())
                    shard, number = s, 0
                if not sink:
                    begin()
                payload = html.encode()
                add(page_member(page, url, payload, own.get(hashlib.sha512(payload).hexdigest()) if own else None))
                count += 1
                if size >= roll_bytes:
                    files.append(close())
                    number += 1
        if sink:
            files.append(close())
        if files:
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files, strict=True), types, strict=True)], names=names)

    fs, root = _fs(path)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    dealt.select("shard", "page_id", "url", "html", "last").mapInArrow(run, MANIFEST).write.json(f"{path}/_temporary/manifest")
    fs.move(f"{root}/_temporary/manifest", f"{root}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _parse(raw: bytes) -> tuple | None:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    if _b32(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    import base64

    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload differs in {fields['WARC-Record-ID']}")
    number = lambda x: int(x.strip("<>").rpartition(":")[2])
    refers = None if response else number(fields["WARC-Refers-To"])
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], payload if response else None, size, digest, refers


def _members(source) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    rest = b""
    while True:
        rest = rest or source.read(READ_BYTES)
        if not rest:
            return
        d, pieces = zlib.decompressobj(31), []
        while not d.eof:
            rest = rest or source.read(READ_BYTES)
            if not rest:
                raise ValueError("an archive ends within a record")
            pieces.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(pieces)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives that the manifest names; digests are verified while reading.

    A file is read by one task as a stream, record by record. An archive of no pages gives no rows.
    """
    files = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("file")
    files = files.repartition(max(1, min(WRITERS, files.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for member in _members(source):
                        if row := _parse(member):
                            rows.append(row)
                            size += len(row[3] or b"")
                        if size > OUT_BYTES or len(rows) >= 1000:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(run, RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives and reads their records back."""
    small_batches(spark, 64)
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN last_id END AS refers_to
FROM d
"""
