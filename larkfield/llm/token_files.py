"""Token ids of documents in bit-plane or byte-plane files, and their reader.

Documents are range-partitioned by id; a task encodes its range in order and writes files. A file is a row of
blocks of ``block_ids`` ids (the last may be shorter). A block's 32-bit ids are transposed: plane i holds bit i (or
byte i) of every id, so that the planes ids never reach are empty and the others hold alike values. Each plane is
compressed by itself with zstandard; a plane of zeros takes no bytes.

A file: the magic ``PLANEIDS``; the planes of all blocks; the footer, an Arrow stream (zstandard) of the documents
(id, number of ids); the chunk index, little-endian unsigned 64-bit numbers: per block its place, number of ids, crc32
of its ids and each plane's length; then six such numbers (bits of a plane, planes of a block, ids of a block, blocks, place of the
footer, place of the index) and the magic again. Files get names of their own per attempt; those named in the manifest,
which Spark commits after all tasks ended, are the table, and what lost attempts left is removed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkfield.llm.token_ids import id_encoder

MAGIC = b"PLANEIDS"
BLOCK_IDS, ROLL_IDS = 1 << 16, 1 << 26
PLANE_BITS = {"bit": 1, "byte": 8}
_END = struct.Struct("<6Q8s")


def planes_of(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first; empty for a plane of zeros."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little") if bits == 1 else raw.T
    return [row.tobytes() if row.any() else b"" for row in rows]


def ids_of(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of a block from its planes."""
    size = -(-n // 8) if bits == 1 else n
    rows = np.stack([np.frombuffer(p or bytes(size), np.uint8) for p in planes])
    if bits == 1:
        rows = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        return np.packbits(rows.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


class PlaneFile:
    """Writes one file; ids come in document by document."""

    def __init__(self, store: filesystems.FileSystem, path: str, id_type: pa.DataType, bits: int, block_ids: int, level: int):
        self.out = store.open_output_stream(path, compression=None)
        self.bits, self.block_ids, self.id_type = bits, block_ids, id_type
        self.packer = zstandard.ZstdCompressor(level=level)
        self.digest, self.place = hashlib.sha256(), 0
        self.waiting, self.n_waiting = [], 0
        self.index, self.docs, self.sizes, self.n_ids = [], [], [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.place += len(data)

    def _blocks(self, least: int) -> None:
        if self.n_waiting < least:
            return
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        done = len(ids) if least == 1 else len(ids) // self.block_ids * self.block_ids
        for low in range(0, done, self.block_ids):
            part = ids[low:min(low + self.block_ids, done)]
            packed = [self.packer.compress(p) if p else b"" for p in planes_of(part, self.bits)]
            self.index.append([self.place, len(part), zlib.crc32(part), *map(len, packed)])
            self._write(b"".join(packed))
        self.waiting, self.n_waiting = [ids[done:].tobytes()], len(ids) - done

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        self._blocks(self.block_ids)

    def close(self) -> None:
        self._blocks(1)
        footer = self.place
        table = pa.table({"doc": pa.array(self.docs, self.id_type), "n": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        self._write(sink.getvalue().to_pybytes())
        index = self.place
        self._write(np.array(self.index, "<u8").tobytes())
        planes = 32 // self.bits
        self._write(_END.pack(self.bits, planes, self.block_ids, len(self.index), footer, index, MAGIC))
        self.out.close()


class PlaneReader:
    """One file: its documents, its chunk index, and any of its blocks."""

    def __init__(self, store: filesystems.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(_END.size, size - _END.size) if size >= _END.size else b""
        if end[-8:] != MAGIC:
            raise ValueError(f"{path} has no end mark")
        self.path = path
        self.bits, planes, self.block_ids, blocks, footer, index, _ = _END.unpack(end)
        self.index = np.frombuffer(self.file.read_at(size - _END.size - index, index), "<u8").reshape(blocks, 3 + planes)
        self.docs = pa.ipc.open_stream(pa.py_buffer(self.file.read_at(index - footer, footer))).read_all()
        self.unpacker = zstandard.ZstdDecompressor()

    def block(self, i: int) -> np.ndarray:
        """Ids of block ``i``; raises when they don't have the checksum of the index."""
        place, n, crc, *lengths = (int(x) for x in self.index[i])
        data, planes, low = self.file.read_at(sum(lengths), place), [], 0
        for length in lengths:
            planes.append(self.unpacker.decompress(data[low:low + length]) if length else b"")
            low += length
        ids = ids_of(planes, n, self.bits)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {i} of {self.path} is broken")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        held = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return held[start - first * self.block_ids:stop - first * self.block_ids]

    def documents(self, low=None, high=None) -> Iterator[tuple[object, int, np.ndarray]]:
        """Id, place in the file and ids of every document (with an id from ``low`` to ``high``), in order, block by block."""
        place, block, ids = 0, -1, np.empty(0, "<u4")
        for doc, n in zip(self.docs["doc"].to_pylist(), self.docs["n"].to_pylist()):
            if (low is None or (doc is not None and doc >= low)) and (high is None or (doc is not None and doc <= high)):
                parts, at = [], place
                while at < place + n:
                    if at // self.block_ids != block:
                        block = at // self.block_ids
                        ids = self.block(block)
                    inside = at - block * self.block_ids
                    parts.append(ids[inside:inside + place + n - at])
                    at += len(parts[-1])
                yield doc, place, parts[0] if len(parts) == 1 else np.concatenate(parts or [ids[:0]])
            place += n


def _writer(folder: str, vocabulary: str, end_id: int, bits: int, block_ids: int, roll_ids: int, level: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = filesystems.FileSystem.from_uri(folder)
        encoder, part, file, done = id_encoder(vocabulary), TaskContext.get().partitionId(), None, []

        def close() -> None:
            file.close()
            done.append((name, part, len(done), len(file.docs), file.n_ids, file.place, file.digest.hexdigest()))

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.stream(texts)):
                if file is None:
                    name = f"ids-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.planes"
                    file = PlaneFile(store, f"{root}/{name}", kind, bits, block_ids, level)
                file.add(doc, ids + end)
                if file.n_ids >= roll_ids:
                    close()
                    file = None
        if file is not None:
            close()
        columns = list(zip(*done)) or [()] * 7
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         ["file", "part", "number", "docs", "ids", "bytes", "sha256"])

    return run


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k",
                      end_id: int = 0, planes: str = "byte", block_ids: int = BLOCK_IDS, roll_ids: int = ROLL_IDS, level: int = 3,
                      parts: int | None = None) -> DataFrame:
    """Write the ids of every text and ``end_id`` after each, in ascending order of ids, to ``folder`` (a new one, in any store that
    workers reach by URI); returns the manifest ``file, part, number, docs, ids, bytes, sha256``.

    Texts are encoded whole; a null text is empty. Null ids come first; rows that repeat an id are ordered by a hash of their text
    and all kept, and may lie in several parts. A file ends after the document that brings it to ``roll_ids``. ``parts`` is the session's number of
    shuffle partitions by default. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # The row's place tells fully repeated rows apart, so that any number of them can be cut into ranges.
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text"), F.col("place")]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    store, root = filesystems.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    shape = "file string, part int, number int, docs long, ids long, bytes long, sha256 string"
    manifest = rows.select("doc", "text").mapInArrow(
        _writer(folder, vocabulary, end_id, PLANE_BITS[planes], block_ids, roll_ids, level), shape)
    manifest.write.parquet(f"{folder}/manifest.parquet")
    manifest = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest.parquet")
    named = {r.file for r in manifest.select("file").toLocalIterator()}  # one name for every ``roll_ids`` ids
    for left in store.get_file_info(filesystems.FileSelector(root)):
        if left.base_name.endswith(".planes") and left.base_name not in named:
            store.delete_file(left.path)
    return manifest


def _reader(folder: str, with_ids: bool, low, high, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystems.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids = list(zip(*rows)) or ((), (), ())
            columns = [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()),
                       pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in ids], pa.int64())]
            names = ["doc", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for name, before, docs, total in zip(*(batch.column(i).to_pylist() for i in range(4))):
                reader, rows, held = PlaneReader(store, f"{root}/{name}"), [], 0
                sizes = reader.docs["n"].to_numpy()
                if len(sizes) != docs or sizes.sum() != total:
                    raise ValueError(f"{name} doesn't hold what its manifest says")
                for doc, place, ids in reader.documents(low, high):
                    rows.append((doc, before + place, ids))
                    held += len(ids) if with_ids else 1
                    if held >= 1 << 14 or len(rows) >= 1 << 14:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return run


def read_token_files(spark: SparkSession, folder: str, *, id_col: str = "doc_id", id_type: str = "bigint", ids: bool = False,
                     low=None, high=None) -> DataFrame:
    """``<id>, start, n_tokens, ids_crc32`` (and ``ids``, if wanted) of the documents in the files of the manifest.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is taken from the ids read. With ``low`` or ``high`` only documents
    with ids in that range are returned, and only blocks that hold one are read and unpacked.
    """
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"), "docs", "ids")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    kind = spark.createDataFrame([], f"x {id_type}").schema
    from pyspark.sql.pandas.types import to_arrow_type
    shape = f"doc {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return files.mapInArrow(_reader(folder, ids, low, high, to_arrow_type(kind[0].dataType)), shape).withColumnRenamed("doc", id_col)
