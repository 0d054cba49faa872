"""Token-id files: independent zstandard frames, a checksum for each, and a seek table at the end.

A file holds documents in ascending doc_id order. Layout, integers little-endian:

    frame, frame, ...            zstandard frames; a frame decompresses to the ids (u32) of some whole documents
    documents                    for each: doc_id i64, ids u64
    seek table                   for each frame: offset u64, bytes u64, first document u64, documents u64, crc32 u32 of the bytes
    footer                       frames u64, documents u64, ids u64, crc32 u32 of documents and seek table, b"TIDS"

A reader takes the footer, the tables, and then only the frames that hold what it wants, each checked before use.

Documents are range-partitioned by doc_id. A task writes its file under a name of its own and then moves it in place, so
a task that runs again replaces nothing that was read; a task that fails removes what it began. Files are written through
pyarrow's file systems: any store with a URI that it knows.

Defined results: null text is empty, so the end id alone; a very long text is encoded whole and makes one frame, however
large; rows with a null doc_id take no part; rows that repeat a doc_id are kept each, one after another, in any order
among them; an empty table gives no file and no row; other columns play no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm import common, tokens

END_ID = 1
#: Bytes of ids after which a frame is closed, and bytes of text that a file is to get.
FRAME_BYTES, FILE_BYTES = 1 << 20, 32 << 20
GROUP = 1000
DOC, FRAME, FOOT, MAGIC = struct.Struct("<qQ"), struct.Struct("<QQQQI"), struct.Struct("<QQQI4s"), b"TIDS"


class Writer:
    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.most, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.at = self.ids = self.docs_before = 0
        self.docs: list[bytes] = []
        self.frames: list[tuple] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append(DOC.pack(doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.most:
            self._close()

    def _close(self) -> None:
        if self.open:
            data = self.zstd.compress(b"".join(self.open))
            self.frames.append((self.at, len(data), self.docs_before, len(self.open), zlib.crc32(data)))
            self.out.write(data)
            self.at, self.docs_before = self.at + len(data), self.docs_before + len(self.open)
            self.open, self.size = [], 0

    def finish(self) -> None:
        self._close()
        tail = b"".join(self.docs) + b"".join(FRAME.pack(*f) for f in self.frames)
        self.out.write(tail + FOOT.pack(len(self.frames), len(self.docs), self.ids, zlib.crc32(tail), MAGIC))


class Reader:
    """source: a random-access file with read(), seek() and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, docs, self.ids, crc, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        tail = self._read(size - FOOT.size - frames * FRAME.size - docs * DOC.size, docs * DOC.size + frames * FRAME.size)
        if zlib.crc32(tail) != crc:
            raise ValueError("the tables of a token-id file are damaged")
        self.docs = list(DOC.iter_unpack(tail[: docs * DOC.size]))
        self.frames = list(FRAME.iter_unpack(tail[docs * DOC.size :]))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) of the documents of a frame."""
        import zstandard

        at, size, first, n, crc = self.frames[k]
        data = self._read(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"frame {k} of a token-id file is damaged")
        ids, place = zstandard.ZstdDecompressor().decompress(data), 0
        for doc_id, count in self.docs[first : first + n]:
            yield doc_id, ids[place : place + 4 * count]
            place += 4 * count

    def get(self, doc_id: int) -> list[bytes]:
        """The ids of every document of that id, from its frames alone."""
        return [ids for k, f in enumerate(self.frames) if any(d == doc_id for d, _ in self.docs[f[2] : f[2] + f[3]]) for d, ids in self.frame(k) if d == doc_id]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


FILES = "part int, path string, documents long, n_ids long, first_doc long, frames int"


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns a written table of them: part, path, documents, n_ids, first_doc, frames."""
    spark = docs.sparkSession
    common.small_batches(spark)
    path = path or tokens.vocabulary("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")
    own = common.own_ids(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_bytes), min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("frames", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), tokens.encoder("word", path)
        store, base = _file_system(folder)
        name = f"{base}/{part:06d}-{uuid.uuid4().hex}"
        out = first = None
        try:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), common.words_of(b.column(1)), strict=True):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out, first = store.open_output_stream(name + ".tmp"), doc_id
                        writer = Writer(out, frame_bytes)
                    writer.add(doc_id, encode(text) + end)
            if out is not None:
                writer.finish()
                out.close()
                store.move(name + ".tmp", name + ".tids")
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(name + ".tmp")
            raise
        if out is not None:
            uri = f"{folder}/{name.rsplit('/', 1)[1]}.tids"
            yield common.batch(schema, [part], [uri], [len(writer.docs)], [writer.ids], [first], [len(writer.frames)])

    ranged = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return common.written(ranged.mapInArrow(run, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32. A task reads single frames.

    The ids before a file are summed within groups of GROUP files and over the groups; those before a document in its
    frame come from the file's own tables.
    """
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = files.withColumn("group", F.floor(F.col("part") / GROUP))  # parts are in the order of doc_id
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", before(Window.orderBy("group")).alias("group_before"))
    placed = grouped.withColumn("in_group", before(Window.partitionBy("group").orderBy("part"))).join(groups, "group").withColumn("ids_before", F.col("group_before") + F.col("in_group"))
    frames = placed.select("path", "ids_before", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    spark: SparkSession = files.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = reader = None
        for b in batches:
            for uri, base, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if uri != seen:
                    store, name = _file_system(uri)
                    seen, reader = uri, Reader(store.open_input_file(name))
                start = base + sum(n for _, n in reader.docs[: reader.frames[k][2]])
                rows = []
                for doc_id, ids in reader.frame(k):
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                yield common.batch(schema, *zip(*rows, strict=True))

    n = max(1, min(4 * spark.sparkContext.defaultParallelism, 10_000))
    return frames.repartition(n, "path", (F.col("frame") / 8).cast("int")).sortWithinPartitions("path", "frame").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = common.new_path(docs.sparkSession, "token-ids")
    return read(write(docs, folder, path))
