"""Token files of independent zstandard frames with a trailing seek table.

Layout: 8 bytes magic; frames; the seek table in a skippable frame; a fixed footer. A frame holds the
ids of some whole documents as little-endian integers of 2 or 4 bytes and can be decompressed without
any other. The seek table holds for each frame its place, sizes, first document and the xxh64 of its
compressed bytes, and for each document its id, length and kind; its own checksum is in the footer.
A reader fetches the footer, the table and then only the frames of the documents asked for. As the
table is a skippable frame, the part between magic and footer is an ordinary zstandard stream.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, scratch_path
from factorloom.llm.tokens import encoder, slices

MAGIC = b"FLTOK\x00\x01\n"
SKIPPABLE = 0x184D2A5E
FOOTER = struct.Struct("<QQQ8s")  # place and size of the table, its xxh64, magic
FRAME_IDS = 1 << 16
#: A file is closed when it has about so many ids.
FILE_IDS = 1 << 27
FRAME_TABLE = np.dtype([("at", "<u8"), ("size", "<u8"), ("raw", "<u8"), ("first", "<u8"), ("docs", "<u8"), ("check", "<u8")])


class CorruptFile(ValueError):
    """A checksum or the magic of a token file does not fit."""


class Writer:
    """Appends documents; ``close`` writes the table and the footer, without which no reader opens the file."""

    def __init__(self, system: fs.FileSystem, path: str, width: int) -> None:
        self.system, self.path, self.width = system, path, width
        self.sink = system.open_output_stream(path)
        self.sink.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.frames: list[tuple[int, ...]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        self.compressor = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.ids += len(ids)
        if self.held_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        raw = np.concatenate(self.held).astype(f"<u{self.width}").tobytes()
        frame = self.compressor.compress(raw)
        self.frames.append((self.at, len(frame), len(raw), len(self.doc_ids) - len(self.held), len(self.held), xxhash.xxh64_intdigest(frame)))
        self.sink.write(frame)
        self.at += len(frame)
        self.held, self.held_ids = [], 0

    def close(self) -> None:
        self._flush()
        known = np.array([d is not None for d in self.doc_ids], "u1")
        parts = [np.array(self.frames, FRAME_TABLE).tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), np.array(self.sizes, "<u8").tobytes(), known.tobytes()]
        head = json.dumps({"width": self.width, "frames": len(self.frames), "docs": len(self.sizes)}).encode()
        table = struct.pack("<I", len(head)) + head + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)))
        self.sink.write(table)
        self.sink.write(FOOTER.pack(self.at + 8, len(table), xxhash.xxh64_intdigest(table), MAGIC))
        self.sink.close()

    def abort(self) -> None:
        self.sink.close()
        self.system.delete_file(self.path)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.source = system.open_input_file(path)
        at, size, check, magic = FOOTER.unpack(self._read(self.source.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise CorruptFile(f"{path} is not a token file")
        table = self._read(at, size)
        if xxhash.xxh64_intdigest(table) != check:
            raise CorruptFile(f"{path}: the seek table is damaged")
        n = struct.unpack_from("<I", table)[0]
        head = json.loads(table[4 : 4 + n])
        body = zstandard.ZstdDecompressor().decompress(table[4 + n :])
        self.path, self.width, docs = path, head["width"], head["docs"]
        self.frames = np.frombuffer(body, FRAME_TABLE, head["frames"])
        rest = len(self.frames) * FRAME_TABLE.itemsize
        self.doc_ids = np.frombuffer(body, "<i8", docs, rest)
        self.sizes = np.frombuffer(body, "<u8", docs, rest + 8 * docs).astype(np.int64)
        self.known = np.frombuffer(body, "u1", docs, rest + 16 * docs).astype(bool)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> list[np.ndarray]:
        """The documents of one frame; only this frame is read."""
        f = self.frames[k]
        packed = self._read(int(f["at"]), int(f["size"]))
        if xxhash.xxh64_intdigest(packed) != f["check"]:
            raise CorruptFile(f"{self.path}: frame {k} is damaged")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(f["raw"])), f"<u{self.width}")
        first, docs = int(f["first"]), int(f["docs"])
        return np.split(raw, np.cumsum(self.sizes[first : first + docs])[:-1])

    def document(self, ordinal: int) -> np.ndarray:
        k = int(np.searchsorted(self.frames["first"], ordinal, "right")) - 1
        return self.frame(k)[ordinal - int(self.frames["first"][k])]


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_tokens`` has written: a row for each file, in the order of the documents."""

    folder: str
    files: DataFrame  # part, seq, path, docs, ids


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder:  # a plain path, or Hadoop's short form of a local one
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, file_ids: int = FILE_IDS) -> TokenFiles:
    """Write all documents in ascending doc_id order below ``folder``, which all executors share.

    Null and empty texts are the end id alone; null ids come first; rows of one id go by text, so
    that repeated rows are written as often as they occur; an empty table writes no file; other
    columns are not written. Each attempt of a task writes files of its own name, and only those of the
    attempt that Spark commits are in the list of files, so a repeated task needs no rename and changes
    nothing; what a failing attempt has begun it deletes, and files of a lost one are in no list.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        writer, done = None, []
        try:
            with encoder(vocabulary) as coder:
                width = 2 if len(coder.ends_piece) <= 1 << 16 else 4
                for batch in batches:
                    doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                    for first, last in slices(texts):
                        ids, counts = coder.encode(texts.slice(first, last - first))
                        ends = np.cumsum(counts)
                        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                            if writer is None:
                                writer = Writer(system, f"{root}/part-{part:06d}-{len(done):06d}-{attempt}.fltok", width)
                            writer.add(doc_ids[first + i], np.append(ids[end - count : end], np.uint32(end_id)))
                            if writer.ids >= file_ids:
                                writer.close()
                                done.append(writer)
                                writer = None
            if writer is not None:
                writer.close()
                done.append(writer)
        except BaseException:
            for begun in [*done, *([writer] if writer is not None and writer not in done else [])]:
                begun.abort()
            raise
        rows = [{"part": part, "seq": k, "path": w.path, "docs": len(w.sizes), "ids": w.ids} for k, w in enumerate(done)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(run, "part int, seq int, path string, docs bigint, ids bigint"), "token-files")
    return TokenFiles(folder, files)


def read_tokens(written: TokenFiles, id_type: str = "bigint") -> DataFrame:
    """A row for each document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    The start counts the ids of all documents before it. There is one row for each file in the sum of
    the files before it, so what that window holds is bounded by the number of files.
    """
    before = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = written.files.withColumn("before", F.coalesce(before, F.lit(0).cast("bigint")))
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folder = written.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader = Reader(_open(folder)[0], path)
                starts = before + np.cumsum(reader.sizes) - reader.sizes
                for k, f in enumerate(reader.frames):
                    first, last = int(f["first"]), int(f["first"] + f["docs"])
                    crc = [zlib.crc32(ids.astype("<u4")) for ids in reader.frame(k)]
                    doc_ids = pa.array(reader.doc_ids[first:last], mask=~reader.known[first:last])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array(starts[first:last], pa.int64()), pa.array(reader.sizes[first:last], pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.select("path", "before").repartition(parts, "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("doc_id", F.col("doc_id").cast(id_type))


def fresh_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "tokens")
