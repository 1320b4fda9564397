"""WARC archives from pages: a deterministic sharded writer and its reader.

Pages are cut into shards by ranges of the page id that hold about equal payload bytes (from an exact histogram),
sorted in their shard, and written by one task each. A task rolls its file once the compressed size
passes ``roll_bytes``. Headers, digests and record ids are made anew from the rows alone, so a repeated task
writes the same bytes. A file gets a temporary name, then its final one; only files named in the
manifest, written after all tasks ended, are part of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: int | None, turn: int, url: str | None, payload: bytes, refers: tuple[int | None] | None, date: str) -> bytes:
    """One uncompressed record; ``refers`` holds the page whose response has the same payload."""
    name = f"urn:page:{'' if page is None else page}:{turn}"
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else name
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
             f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}"]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers[0] is None else refers[0]}:0>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """The open file of a shard; closing it gives the file its final name."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.store, self.root = filesystems.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.number, self.out = shard, roll_bytes, 0, None
        self.done: list[tuple] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4()}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.records = self.bytes = 0
            self.digest = hashlib.sha256()
        data = _member(record)
        self.out.write(data)
        self.digest.update(data)
        self.records += 1
        self.bytes += len(data)
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"pages-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.store.move(self.temporary, f"{self.root}/{name}")
            self.done.append((name, self.shard, self.records, self.bytes, self.digest.hexdigest()))
            self.number, self.out = self.number + 1, None


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, done = None, (), []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for row, (at, own, is_page, digest, refers) in enumerate(zip(*columns)):
                if shard is None or at != shard.shard:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(folder, at, roll_bytes)
                if page != (at, own):
                    page, marks, turn = (at, own), {}, 0
                if not is_page:  # a mark: this payload of the page is elsewhere, or comes again
                    marks[digest] = [refers, 0]
                    continue
                payload = (batch.column(6)[row].as_py() or "").encode("utf-8")
                mark = marks.get(digest)
                known = None
                if mark is not None:
                    known = (mark[0],) if mark[0] != own or mark[1] else None
                    mark[1] += 1
                shard.add(record_bytes(own, turn, batch.column(4)[row].as_py(), payload, known, date))
                turn += 1
        if shard is not None:
            shard.close()
            done += shard.done
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "shard", "records", "bytes", "sha256"])

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 1000, shards: int | None = None, roll_bytes: int = 64 << 20,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row to ``folder`` (any store the workers reach by URI); returns the manifest.

    Equal payloads of at least ``least_bytes`` are stored once, with the largest page id; the others are
    revisits of it. Null pages are empty payloads; null urls are named after the page. Null ids sort first and
    never win over an id. Of rows that repeat the winning id and payload the first is the response. ``shards``
    is the session's number of shuffle partitions by default. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    low, high = rows.agg(F.min("page"), F.max("page")).first()
    width = ((high or 0) - (low or 0)) // BUCKETS + 1
    bucket = F.coalesce(((F.col("page") - F.lit(low or 0)) / width).cast("int"), F.lit(0))
    # At most BUCKETS rows; a record's headers weigh about 500 bytes.
    sizes = dict(rows.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("bytes") + 500)).collect())
    total, before, cuts = sum(sizes.values()) or 1, 0, []
    for b in range(BUCKETS + 1):
        cuts.append(min(before * shards // total, shards - 1))
        before += sizes.get(b, 0)
    shard = F.get(F.split(F.lit(",".join(map(str, cuts))), ","), bucket).cast("int")
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page").alias("refers"), F.count("*").alias("n"))
    marks = rows.select("page", "digest", "bytes").join(groups.where("n > 1"), ["digest", "bytes"]).select(
        shard.alias("shard"), "page", F.lit(False).alias("is_page"), "digest", F.lit(None).cast("string").alias("url"), "refers",
        F.lit(None).cast("string").alias("html")).distinct()
    bodies = rows.select(shard.alias("shard"), "page", F.lit(True).alias("is_page"), "digest", "url", F.lit(None).cast("bigint").alias("refers"), "html")
    ordered = bodies.unionByName(marks).repartition(shards, "shard").sortWithinPartitions("shard", "page", "is_page", "digest", "url")
    store, root = filesystems.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    manifest = ordered.mapInArrow(_writer(folder, roll_bytes, date), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest.parquet")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    opener, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if parts:
                raise ValueError("archive ends inside a record")
            return
        parts.append(opener.decompress(data))
        data = b""
        if opener.eof:
            yield b"".join(parts)
            data, opener, parts = opener.unused_data, zlib.decompressobj(31), []


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises when a digest or length doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != size or _sha1(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"broken payload {fields['WARC-Record-ID']}")
    page = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    return {"page": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "kind": fields["WARC-Type"], "bytes": size,
            "digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
            "refers": page("WARC-Refers-To") if "WARC-Refers-To" in fields else None, "payload": payload}


_FIELDS = (("page_id", "page", pa.int64()), ("url", "url", pa.string()), ("record_type", "kind", pa.string()),
           ("payload_bytes", "bytes", pa.int64()), ("payload_digest", "digest", pa.string()), ("refers_to", "refers", pa.int64()),
           ("payload", "payload", pa.binary()))


def _reader(folder: str, payloads: bool):
    fields = _FIELDS if payloads else _FIELDS[:-1]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for _, k, t in fields], [n for n, _, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystems.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parse_record(member))
                        seen += 1
                        held += len(member) if payloads else 300
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, its manifest says {records}")
                yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Records of the files in the manifest, checked against their digests: ``page_id, url, record_type,
    payload_bytes, payload_digest (hex), refers_to`` and, if wanted, ``payload`` (empty for revisits)."""
    manifest = spark.read.parquet(f"{folder}/manifest.parquet").select("file", "records")
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    shape = ", ".join(f"{n} {names[t]}" for n, _, t in (_FIELDS if payloads else _FIELDS[:-1]))
    files = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return files.mapInArrow(_reader(folder, payloads), shape)
