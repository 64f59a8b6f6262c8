"""WARC archives: a deterministic sharded writer, and the reader of what it has committed.

Records are dealt to shards by ranges of their page id, cut so that shards hold equal numbers of bytes, and sorted. A
task writes its shard as gzip members, one for each record, and begins a new file when the compressed size is reached.
Headers and digests are made anew from the payload; ids and dates depend on the records alone, so that the same pages
give the same files, byte for byte, however they are partitioned and however often a task is repeated.

Files are written under temporary names that no other attempt shares. The rows of the tasks that succeeded are settled;
the files they name are moved to their final names; the manifest is written; and last, one small file names the
manifest. A reader starts from that file, so it sees a finished archive or none, and never a lost attempt's leftovers.

Of records with equal payloads of at least ``revisit_from`` bytes, that with the largest page id is a response and the
others are revisits without payload; SHA-256 and length decide equality. Payloads are shuffled once, for the sort.

Defined cases: a null payload is empty; a null page id sorts first, and as a copy revisits a record that has one; a null
url has no target header; control characters and blanks in a url are percent-encoded; rows that are equal in id, url and
payload are records of their own, numbered; several rows with the largest page id are all responses; an empty table
gives an archive without files; further columns are never read. The folder must be one that Python in the tasks can open
(a shared file system, HDFS or an object store known to Arrow).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emblema.session import fresh_path, settled

from .common import only

#: From this size on, equal payloads are stored once.
REVISIT_FROM = 1000
#: Uncompressed bytes of a shard, a task's work; beyond the greatest number of shards they grow.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 20_000
#: Compressed bytes after which a shard goes on in a new file.
ROLL_BYTES = 256 << 20
#: Rows of the sample, for each shard, from which the ranges are cut.
SAMPLED = 50
#: Repeated payloads are broadcast up to this many; beyond, they are joined by shuffle.
BROADCAST_COPIES = 100_000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = "shard int, sequence int, temporary string, name string, records bigint, bytes bigint, sha256 string"
RECORDS = "file string, place bigint, record_id string, record_type string, page_id string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path within it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def place(url: Column, digest: Column) -> Column:
    """Order among records of one page id, which also lets a hot page id be cut into ranges."""
    return F.xxhash64(url, digest)


def with_revisits(pages: DataFrame, revisit_from: int) -> DataFrame:
    """``page_id, url, payload`` with ``digest, size``, ``keeper`` (the page that a revisit refers to, else null) and ``keeper_url``.

    A revisit's payload is null from here on, so copies are not shuffled.
    """
    read = pages.withColumns({"digest": F.sha1("payload"), "_same": F.sha2("payload", 256), "_bytes": F.octet_length("payload")})
    large = F.col("_bytes") >= revisit_from
    groups = read.where(large).groupBy("_same", "_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("of"))
    copies = settled(groups.where("n > 1").select("_same", "_bytes", F.col("of.page_id").alias("_of"), F.col("of.url").alias("_of_url")), "warc-copies")
    small = copies.count() <= BROADCAST_COPIES
    joined = read.join(F.broadcast(copies) if small else copies, ["_same", "_bytes"], "left")
    later = F.col("_of").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_of")))
    return joined.select(
        "page_id", "url", "digest", F.col("_bytes").alias("size"), F.when(F.coalesce(~later, F.lit(True)), F.col("payload")).alias("payload"),
        F.when(later, F.col("_of")).alias("keeper"), F.when(later, F.col("_of_url")).alias("keeper_url"),
    )


def shard_bounds(pages: DataFrame, shard_bytes: int, most_shards: int) -> list[tuple]:
    """Lower bounds of all shards but the first, cut from a sample that depends on the rows alone.

    The sample is of some 50 rows for each shard, a million at most, chosen by their hash; it only sets where ranges
    end. Rows equal in id, url and payload are one row of it.
    """
    size = (F.octet_length("payload") + F.lit(600)).cast("bigint")
    total = pages.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    shards = min(most_shards, math.ceil((total["bytes"] or 0) / shard_bytes))
    if shards <= 1:
        return []
    share = min(1.0, SAMPLED * shards / total["rows"])
    key = [F.col("page_id"), place(F.col("url"), F.col("digest")).alias("place")]
    chosen = F.pmod(F.xxhash64("page_id", "url", "digest", F.lit(11)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))
    sample = pages.where(chosen).groupBy(*key).agg(F.sum(size).alias("bytes")).collect()
    keys = sorted((_order(r["page_id"], r["place"]), r["bytes"]) for r in sample)
    step, sum_so_far, bounds = sum(b for _, b in keys) / shards, 0, []
    for at, b in keys:
        if sum_so_far >= step * (len(bounds) + 1):
            bounds.append(at)
        sum_so_far += b
    return bounds


def _order(page_id: object, at: int) -> tuple:
    return (page_id is not None, 0 if page_id is None else page_id, at)


def sharded(pages: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Rows in the partition of their shard, sorted by page id."""

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, _order(p, a)) for p, a in zip(page_id.to_pylist(), at.to_pylist(), strict=True)], pa.int32())

    at = place(F.col("url"), F.col("digest"))
    placed = pages.withColumn("place", at).withColumn("shard", shard_of("page_id", "place"))
    return placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "place", "digest", "url")


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _record_id(page_id: object, url: str | None, digest: str, copy: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([None if page_id is None else str(page_id), url, digest, copy])).urn


def _address(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str, keeper: object, keeper_url: str | None, copy: int, date: str) -> bytes:
    """One record, uncompressed: a response, or a revisit if there is a keeper."""
    revisit = keeper is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += b"" if revisit else payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_record_id(page_id, url, digest, copy)}>"), ("WARC-Date", date)]
    headers += [] if url is None else [("WARC-Target-URI", _address(url))]
    headers += [] if page_id is None else [("X-Page-Id", str(page_id))]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_record_id(keeper, keeper_url, digest, 0)}>"), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(keeper))]
        headers += [] if keeper_url is None else [("WARC-Refers-To-Target-URI", _address(keeper_url))]
    headers += [("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest()))]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}{chr(13)}{chr(10)}' for k, v in headers)}\r\n".encode() + block + b"\r\n\r\n"


def _file_head(name: str, date: str) -> bytes:
    fields = b"software: emblema\r\nformat: WARC File Format 1.1\r\n"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("WARC-Date", date), ("WARC-Filename", name)]
    headers += [("Content-Type", "application/warc-fields"), ("Content-Length", str(len(fields)))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}{chr(13)}{chr(10)}' for k, v in headers)}\r\n".encode() + fields + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
    return packed.compress(data) + packed.flush()


class _Files:
    """The files of one task: a shard's records in order, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int, date: str):
        self.store, self.path = opened(folder)
        self.roll_bytes, self.date = roll_bytes, date
        self.out, self.shard, self.sequence = None, None, 0

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        packed = _member(data)
        if shard != self.shard:
            yield from self.close()
            self.shard, self.sequence = shard, 0
        elif self.records and self.bytes + len(packed) > self.roll_bytes:
            yield from self.close()
            self.sequence += 1
        if self.out is None:
            self.temporary, self.name = f"{uuid.uuid4().hex}.part", f"shard-{shard:06d}-{self.sequence:06d}.warc.gz"
            self.out, self.hash, self.records, self.bytes = self.store.open_output_stream(f"{self.path}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0
            self._put(_member(_file_head(self.name, self.date)))
        self._put(packed)
        self.records += 1

    def _put(self, packed: bytes) -> None:
        self.out.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.out = None
            yield self.shard, self.sequence, self.temporary, self.name, self.records, self.bytes, self.hash.hexdigest()


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = DATE,
    revisit_from: int = REVISIT_FROM,
    shard_bytes: int = SHARD_BYTES,
    most_shards: int = MOST_SHARDS,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes a record for each row below ``path`` and gives the manifest: ``shard, sequence, name, records, bytes, sha256``."""
    spark = pages.sparkSession
    store, folder = opened(path)
    if store.get_file_info(f"{folder}/COMMIT").type != fs.FileType.NotFound:
        raise ValueError(f"{path} holds a finished archive")
    work = f"{path}/_temporary-{uuid.uuid4().hex}"
    store.create_dir(opened(work)[1], recursive=True)
    store.create_dir(f"{folder}/archive", recursive=True)
    content = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    read = only(pages, page_id, url, payload).select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), content.alias("payload"))
    known = with_revisits(read, revisit_from)
    rows = sharded(known, shard_bounds(read.withColumn("digest", F.sha1("payload")), shard_bytes, most_shards))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, before, copy = _Files(work, roll_bytes, date), None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "size", "digest", "keeper", "keeper_url")]
            for at in range(batch.num_rows):
                shard, page, address, body, size, digest, keeper, keeper_url = (c[at].as_py() for c in columns)
                copy = copy + 1 if (page, address, digest) == before else 0
                before = (page, address, digest)
                if done := list(files.add(shard, record(page, address, body, size, digest, keeper, keeper_url, copy, date))):
                    yield _batch(done, PARTS)
        yield _batch(list(files.close()), PARTS)

    parts = settled(rows.select("shard", "page_id", "url", "payload", "size", "digest", "keeper", "keeper_url").mapInArrow(written, PARTS), "warc-parts")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, temporary, final = opened(work)[0], opened(work)[1], opened(path)[1]
        for batch in batches:
            for row in batch.select(["temporary", "name"]).to_pylist():
                source, target = f"{temporary}/{row['temporary']}", f"{final}/archive/{row['name']}"
                if there.get_file_info(source).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    there.move(source, target)
            yield batch

    manifest = f"manifest-{uuid.uuid4().hex}"
    parts.mapInArrow(moved, PARTS).drop("temporary").write.parquet(f"{path}/{manifest}")
    with store.open_output_stream(f"{folder}/COMMIT.tmp") as out:
        out.write(json.dumps({"manifest": manifest}).encode())
    store.move(f"{folder}/COMMIT.tmp", f"{folder}/COMMIT")
    store.delete_dir(opened(work)[1])  # what is left there belongs to attempts that failed
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a finished archive; an error if none has been committed."""
    store, folder = opened(path)
    with store.open_input_stream(f"{folder}/COMMIT") as commit:
        name = json.loads(commit.read())["manifest"]
    return spark.read.schema(PARTS.replace("temporary string, ", "")).parquet(f"{path}/{name}")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one at a time."""
    data, unpack, parts = b"", None, []
    while True:
        data = data or stream.read(chunk)
        if not data:
            if unpack is not None:
                raise ValueError("the file ends within a record")
            return
        unpack = unpack or zlib.decompressobj(31)
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = None, []


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the one its header gives")
    return headers, rest[:size]


def _read_record(file: str, place: int, data: bytes, with_payload: bool) -> tuple | None:
    headers, block = parsed(data)
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    if headers["warc-block-digest"] != _base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"{file}: the block of record {place} is not the one its digest was taken of")
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(line.partition(":")[2]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    response = headers["warc-type"] == "response"
    if response and (len(body) != length or headers["warc-payload-digest"] != _base32(hashlib.sha1(body).hexdigest())):
        raise ValueError(f"{file}: the payload of record {place} is not the one its digest was taken of")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    return (
        file, place, headers["warc-record-id"].strip("<>"), headers["warc-type"], headers.get("x-page-id"), headers.get("warc-target-uri"),
        length, digest, headers.get("x-refers-to-page-id"), body if response and with_payload else None,
    )


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """The records of a finished archive, lengths and digests verified: a task reads whole files, a record at a time."""
    manifest = read_manifest(spark, path)
    folder = f"{path}/archive"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows, held, found = [], 0, 0
                with store.open_input_stream(f"{at}/{row['name']}", compression=None) as stream:
                    for place, data in enumerate(members(stream)):
                        if (one := _read_record(row["name"], place, data, with_payload)) is None:
                            continue
                        rows.append(one)
                        found, held = found + 1, held + 600 + len(one[-1] or b"")
                        if held > 8 << 20:
                            yield _batch(rows, RECORDS)
                            rows, held = [], 0
                yield _batch(rows, RECORDS)
                if found != row["records"]:
                    raise ValueError(f"{row['name']} holds {found} records, not {row['records']}")

    files = manifest.select("name", "records")
    many = max(1, min(manifest.count(), 8 * spark.sparkContext.defaultParallelism))
    return files.repartition(many).mapInArrow(read, RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``page_id, url, html`` to archives in the shared folder, reads them back, and gives what the records say."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM (SELECT *, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS keeper
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
