"""Token ids in seekable files of independent zstandard frames.

A file holds the ids of documents in ascending order of doc_id:

* data frames: plain zstandard frames with a content checksum, each with ids
  (little-endian, 16 bits) of one document. A document of more than
  FRAME_IDS ids continues in the next frames; any other has one frame.
* a skippable frame (magic 0x184D2A50) with a zstandard frame inside, the
  document table: 64-bit little-endian columns doc_id, is-NULL flag, ids, number of frames.
* a skippable frame (magic 0x184D2A5E), the seek table of the public
  "zstandard seekable format": per frame its compressed size, its
  decompressed size and the low 32 bits of the XXH64 of its content (32 bits
  each), then the number of frames, a descriptor byte and the magic 0x8F92EAB1.

Any zstandard program decompresses such a file. A reader that wants some
documents reads the tail, adds up sizes and reads and decompresses only those
documents' frames, each held against its checksum.

Writing: ids are made once and stored; Spark deals the stored rows out by
ranges of (doc_id, ids hash, place in the stored table), so an id that many
rows share is spread over files as well, and each task writes one file under
a temporary name and renames it when whole. A repeated task writes the same
bytes. Files of other tasks are never needed.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarmac.llm.common import materialise, prepare
from tarmac.llm.tokens import BlankTokenizer, shared
from tarmac.session import ensure_parent, work_dir

TOKENIZER = "byte_bpe_50k.json"
CLOSING = 2                # id after each document
FRAME_IDS = 1 << 20        # ids in a frame
FILE_IDS = 1 << 24         # ids that a file aims at
LEVEL = 3
TABLE_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80           # descriptor: the seek table has checksums
WIDTH = np.dtype("<u2")

IDS_SCHEMA = ("doc_id long, frames array<binary>, sizes array<long>, checks array<long>, n long, mark long, part long, "
              "row long")


# ---------------------------------------------------------------- ids
def frames_of(zipper, ids: bytes, frame_ids: int) -> list[tuple[bytes, int, int]]:
    """(frame, size of its content, checksum) of a document's ids."""
    step = frame_ids * WIDTH.itemsize
    parts = [ids[at:at + step] for at in range(0, max(len(ids), 1), step)]
    return [(zipper.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF) for raw in parts]


def compressor():
    import zstandard
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)


def encode(docs: DataFrame, path: str, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Rows of IDS_SCHEMA, written to the shared folder: the ids of each whole
    text with the closing id, ``n`` of them, already in compressed frames (so
    the shuffle moves those); ``mark`` is a hash of the ids, (part, row) the
    place of the row among the tasks."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, tok, row = TaskContext.get().partitionId(), shared(BlankTokenizer, path), 0
        closing, zipper = np.array([CLOSING], dtype=WIDTH).tobytes(), compressor()
        for b in batches:
            ids = [x.astype(WIDTH, copy=False).tobytes() + closing for x in tok(b.column(1))]
            made = [frames_of(zipper, x, frame_ids) for x in ids]
            lists = [pa.array([[f[k] for f in fs] for fs in made], pa.list_(kind))
                     for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *lists, pa.array([len(x) // WIDTH.itemsize for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(np.full(len(ids), part, np.int64)),
                 pa.array(np.arange(row, row + len(ids), dtype=np.int64))],
                names=["doc_id", "frames", "sizes", "checks", "n", "mark", "part", "row"])
            row += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS_SCHEMA)
    return materialise(rows, "tokenids")


# ---------------------------------------------------------------- file format
def file_system(uri: str):
    """(pyarrow file system, path there) of a qualified path."""
    from pyarrow import fs
    scheme, _, rest = uri.partition(":")
    if scheme == "file":                                    # Hadoop writes file:/x
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


class Writer:
    """One file: documents are added in order, then ``close``."""

    def __init__(self, stream):
        self.stream = stream
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, frames: list[tuple[bytes, int, int]]) -> None:
        for packed, size, check in frames:
            self.stream.write(packed)
            self.frames.append((len(packed), size, check))
        n = sum(size for _, size, _ in frames) // WIDTH.itemsize
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, n, len(frames)))

    def close(self) -> int:
        """Write both tables; returns the number of ids."""
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 4)
        table = compressor().compress(np.ascontiguousarray(docs.T).tobytes())
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        seek = np.array(self.frames, dtype="<u4").reshape(-1, 3).tobytes()
        seek += struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOT_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        return int(docs[:, 2].sum())


class Reader:
    """The tables of one file, and its documents by number."""

    def __init__(self, stream, size: int):
        import zstandard
        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable token file")
        seek_at = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(seek_at, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("seek table is damaged")
        frames = np.frombuffer(self._at(seek_at + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.check = frames.T
        self.begin = np.cumsum(self.packed) - self.packed
        table_at = int(self.packed.sum())
        magic, length = struct.unpack("<II", self._at(table_at, 8))
        if magic != TABLE_MAGIC or table_at + 8 + length != seek_at:
            raise ValueError("document table is damaged")
        table = self.unzip.decompress(self._at(table_at + 8, length))
        self.doc_id, self.null, self.n, self.n_frames = np.frombuffer(table, "<i8").reshape(4, -1)
        self.start = np.cumsum(self.n) - self.n             # ids of the file before each document
        self.first = np.cumsum(self.n_frames) - self.n_frames

    def _at(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        got = self.stream.read(size)
        if at < 0 or len(got) != size:
            raise ValueError("file is too short")
        return got

    def frames(self, doc: int) -> Iterator[bytes]:
        """Content of a document's frames, each read alone and checked."""
        for f in range(int(self.first[doc]), int(self.first[doc] + self.n_frames[doc])):
            raw = self.unzip.decompress(self._at(int(self.begin[f]), int(self.packed[f])), max_output_size=int(self.raw[f]))
            if len(raw) != self.raw[f] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[f]:
                raise ValueError(f"frame {f} does not match its checksum")
            yield raw


# ---------------------------------------------------------------- Spark jobs
def write(ids: DataFrame, folder: str, file_ids: int = FILE_IDS) -> None:
    """Write stored ids (the columns of ``encode``) as files in ``folder``, in
    ascending order of doc_id (NULL first) over the files in name order."""
    spark = ids.sparkSession
    ensure_parent(spark, f"{folder}/part")
    uri = qualified(spark, folder)
    total = ids.agg(F.sum("n").alias("n")).first()["n"] or 0
    files = max(1, math.ceil(int(total) / file_ids))
    order = ["doc_id", "mark", "part", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, out, stream = TaskContext.get(), None, None
        fs, root = file_system(uri)
        name = f"part-{task.partitionId():07d}.zst"
        temp = f"{root}/_{name}-{task.taskAttemptId()}"
        docs = 0
        for b in batches:
            for doc_id, frames, sizes, checks in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:                             # a task without rows writes no file
                    stream = fs.open_output_stream(temp)
                    out = Writer(stream)
                out.add(doc_id, list(zip(frames, sizes, checks)))
                docs += 1
        if out is not None:
            total = out.close()
            stream.close()
            if type(fs).__name__ != "LocalFileSystem" and fs.get_file_info(f"{root}/{name}").type.name != "NotFound":
                fs.delete_file(f"{root}/{name}")            # an earlier attempt's, with the same content
            fs.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())],
                                             names=["name", "docs", "n"])

    done = (ids.repartitionByRange(files, *order).sortWithinPartitions(*order)
            .select("doc_id", "frames", "sizes", "checks").mapInArrow(run, "name string, docs long, n long"))
    done = materialise(done, "tokenfiles").agg(F.sum("n").alias("n")).first()["n"] or 0
    if done != total:
        raise RuntimeError(f"{done} of {total} ids written")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files; Spark lists them, their content is not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.zst").load(folder)
            .select("path", F.col("length").alias("size")))


def _open(path: str):
    fs, p = file_system(path)
    return fs.open_input_file(p)


TABLE_SCHEMA = "path string, size long, doc long, doc_id long, start_in_file long, n_tokens long"
ROWS = 4096                # rows of an output batch


def document_table(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, doc, doc_id, start_in_file, n_tokens) of every document,
    from the files' tails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(path) as stream:
                    r = Reader(stream, size)
                n = len(r.doc_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(np.full(n, size, np.int64)), pa.array(np.arange(n, dtype=np.int64)),
                     pa.array(r.doc_id, mask=r.null.astype(bool)), pa.array(r.start), pa.array(r.n)],
                    names=["path", "size", "doc", "doc_id", "start_in_file", "n_tokens"])

    return files(spark, folder).mapInArrow(run, TABLE_SCHEMA)


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted`` (NULL asks
    for those without one): only their frames are read and decompressed."""
    ask = wanted.select(F.col("doc_id").cast("long").alias("_ask")).distinct()
    found = document_table(spark, folder).join(ask, F.col("doc_id").eqNullSafe(F.col("_ask")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, r = None, None, None
        for b in batches:
            ids, of = [], []
            for p, size, doc, doc_id in zip(*(c.to_pylist() for c in b.columns)):
                if p != path:
                    if stream is not None:
                        stream.close()
                    path, stream = p, _open(p)
                    r = Reader(stream, size)
                of.append(doc_id)
                ids.append(b"".join(r.frames(doc)))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        if stream is not None:
            stream.close()

    return found.select("path", "size", "doc", "doc_id").sortWithinPartitions("path", "doc").mapInArrow(run, "doc_id long, ids binary")


DIGEST_SCHEMA = "path string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files
    alone: each frame is decompressed and held against its checksum. ``start``
    adds the ids of the files before, one row for each file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with _open(path) as stream:
                    r = Reader(stream, size)
                    for at in range(0, len(r.doc_id), ROWS):
                        docs = range(at, min(at + ROWS, len(r.doc_id)))
                        n, crc = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                        for k, d in enumerate(docs):
                            c = 0
                            for raw in r.frames(d):
                                c = zlib.crc32(np.frombuffer(raw, WIDTH).astype("<u4").tobytes(), c)
                                n[k] += len(raw) // WIDTH.itemsize
                            crc[k] = c
                        span = slice(at, at + len(docs))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(docs), pa.string()), pa.array(r.doc_id[span], mask=r.null[span].astype(bool)),
                             pa.array(r.start[span]), pa.array(n), pa.array(crc)],
                            names=["path", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    rows = materialise(files(spark, folder).mapInArrow(run, DIGEST_SCHEMA), "tokendigests")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("path").agg(F.sum("n_tokens").alias("total"))       # one row for each file
               .select("path", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))
    return rows.join(offsets, "path").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"),
                                             "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all ``docs`` and read them back, see ``read_digests``.

    A NULL or empty text is the closing id alone. Repeated ids and repeated
    rows are documents of their own, in the order of their ids' hash; a NULL
    doc_id comes first. An empty table writes no file and gives an empty
    result. Only doc_id and text are read; a text is never cut.
    """
    spark = docs.sparkSession
    folder = folder or os.path.join(work_dir(spark, "llm-tokenfiles"), "files")
    write(encode(docs, path), folder, file_ids)
    return read_digests(spark, folder)
