"""Token ids in files of independent zstandard frames with a trailing seek table, read a document at a time.

A file is, one behind the other: data frames, each with a run of one document's ids as little-endian unsigned 32-bit
integers; a skippable frame with the directory (ids, sizes and frames of the documents, in order); a skippable frame with
the seek table in the seekable zstandard format, whose entries have the sizes of every frame, the directory included, and
a checksum of what it holds. A plain decoder gives the ids of all documents; a reader that wants a few documents fetches
the table, the directory and these documents' frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, kept, partitions, slices, written
from tidemark.llm.chunk_encoders import ByteLevelEncoder

#: Ids that one frame holds at most (a longer document has several frames), and compressed bytes that close a file.
FRAME_IDS = 65_536
FILE_BYTES = 64_000_000
LEVEL = 3
#: Bytes that a reader of a whole file fetches at a time, at least.
READ_BYTES = 4_000_000
#: Bytes of text that are encoded together.
TEXT_BYTES = 2_000_000
MAX_FILE_BYTES = 64_000_000
#: Fixed values of the seekable format: magic numbers of the seek table's frame and at its end, and the checksum flag.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Another of the skippable magic numbers, for the directory, and what the directory begins with.
DIRECTORY_MAGIC = 0x184D2A50
DIRECTORY_MARK = b"ids1"

SUFFIX = ".ids.zst"


class StoreError(ValueError):
    """A file that breaks the format, or a frame that differs from its checksum."""


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents into one open file, frame by frame; close() adds the directory and the seek table."""

    def __init__(self, out):
        import zstandard

        self.out, self.coder, self.size = out, zstandard.ZstdCompressor(level=LEVEL), 0
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document by the little-endian bytes of its ids."""
        frames = range(0, len(ids), 4 * FRAME_IDS)
        for start in frames:
            data = ids[start : start + 4 * FRAME_IDS]
            frame = self.coder.compress(data)
            self.out.write(frame)
            self.size += len(frame)
            self.entries.append((len(frame), len(data), checksum(data)))
        self.documents.append((doc_id or 0, doc_id is None, len(ids) // 4, len(frames)))

    def close(self) -> None:
        columns = zip(*self.documents, strict=True) if self.documents else [(), (), (), ()]
        packed = [np.array(c, t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<u8", "<u4"), strict=True)]
        content = DIRECTORY_MARK + struct.pack("<Q", len(self.documents)) + b"".join(packed)
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(content)) + content)
        self.entries.append((8 + len(content), 0, checksum(content)))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads a file of documents by its seek table and directory. file needs seek, read and, for its end, size."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.decoder = file, zstandard.ZstdDecompressor()
        if size < 17:
            raise StoreError("too short for a seek table")
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        length = 12 * frames + 9
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS or size < 8 + length:
            raise StoreError("no seek table with checksums at the end")
        table = self._at(size - 8 - length, 8 + length)
        if struct.unpack_from("<II", table) != (SEEK_TABLE_MAGIC, length):
            raise StoreError("the seek table's frame is broken")
        self.entries = np.frombuffer(table, "<u4", 3 * frames, 8).reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        if not frames or self.starts[-1] != size - 8 - length:
            raise StoreError("the frames do not fill the file")
        content = self._at(int(self.starts[-2]), int(self.entries[-1, 0]))[8:]
        if content[:4] != DIRECTORY_MARK or checksum(content) != self.entries[-1, 2]:
            raise StoreError("the directory is broken")
        n, at = struct.unpack_from("<Q", content, 4)[0], 12
        columns = []
        for kind in ("<i8", "u1", "<u8", "<u4"):
            columns.append(np.frombuffer(content, kind, n, at))
            at += columns[-1].nbytes
        self.doc_ids, self.no_id, sizes, counts = columns
        self.sizes = sizes.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.starts_of = np.concatenate([[0], np.cumsum(self.sizes)])

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(n)
        if len(data) != n:
            raise StoreError("the file is cut off")
        return data

    def _decoded(self, frame: int, data: bytes) -> bytes:
        import zstandard

        _, size, sum_ = (int(x) for x in self.entries[frame])
        try:
            out = self.decoder.decompress(data, max_output_size=size)
        except zstandard.ZstdError as e:
            raise StoreError(f"frame {frame} is broken: {e}") from e
        if len(out) != size or checksum(out) != sum_:
            raise StoreError(f"frame {frame} differs from its checksum")
        return out

    def document(self, number: int) -> bytes:
        """The ids of one document, from its frames alone."""
        a, b = int(self.first[number]), int(self.first[number + 1])
        data, base = self._at(int(self.starts[a]), int(self.starts[b] - self.starts[a])), int(self.starts[a])
        out = b"".join(self._decoded(f, data[int(self.starts[f]) - base : int(self.starts[f + 1]) - base]) for f in range(a, b))
        if len(out) != 4 * int(self.sizes[number]):
            raise StoreError(f"document {number} has another size than its directory entry")
        return out

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, ids) of all documents in order, fetched in long runs."""
        held, base = b"", 0
        for number in range(len(self.doc_ids)):
            a, b = int(self.first[number]), int(self.first[number + 1])
            start, end = int(self.starts[a]), int(self.starts[b])
            if end > base + len(held):
                stop = min(max(end, start + READ_BYTES), int(self.starts[-2]))
                held, base = self._at(start, stop - start), start
            out = b"".join(self._decoded(f, held[int(self.starts[f]) - base : int(self.starts[f + 1]) - base]) for f in range(a, b))
            if len(out) != 4 * int(self.sizes[number]):
                raise StoreError(f"document {number} has another size than its directory entry")
            yield None if self.no_id[number] else int(self.doc_ids[number]), int(self.starts_of[number]), out


def _address(folder: str) -> str:
    """folder as an address that pyarrow opens."""
    return folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)


def write_tokens(df: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row's whole text, end_id behind each, to folder in ascending order of ids.

    Files are named <partition>-<number>.ids.zst, so that their names' order is the documents'. Rows without an id come
    first; rows that share one are ordered by a hash of their text and the text. Null and empty texts hold end_id alone.
    Rows are dealt to partitions by ranges of id and hash, and sorted there: a task that runs again writes the same
    files, and moves each to its name once it is whole. folder may be on any file system that pyarrow opens.
    """
    path = Path(tokenizer_file)
    if path.stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{tokenizer_file} is larger than {MAX_FILE_BYTES} bytes")
    spark, name = df.sparkSession, str(path)
    ByteLevelEncoder(path.read_text(encoding="utf-8"))
    definition = spark.sparkContext.broadcast(path.read_text(encoding="utf-8"))
    at, end = _address(folder), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(at)
        system.create_dir(base, recursive=True)
        encoder = kept(("token_store", name), lambda: ByteLevelEncoder(definition.value))
        partition, number, out, writer, part = TaskContext.get().partitionId(), 0, None, None, ""
        for rows in slices(batches, "text", TEXT_BYTES):
            encoded = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoded, strict=True):
                if writer is None:
                    out = system.open_output_stream(part := f"{base}/_{uuid.uuid4().hex}")
                    writer = Writer(out)
                writer.add(doc_id, ids + end)
                if writer.size >= FILE_BYTES:
                    writer.close()
                    out.close()
                    system.move(part, f"{base}/{partition:07d}-{number:05d}{SUFFIX}")
                    number, writer = number + 1, None
        if writer is not None:
            writer.close()
            out.close()
            system.move(part, f"{base}/{partition:07d}-{number:05d}{SUFFIX}")
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    dealt.mapInArrow(frugal(run, ("token_store", name)), "files long").write.format("noop").mode("overwrite").save()
    # An empty table writes no file; its folder is there all the same.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the store's files; their content is not read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").schema("path string, modificationTime timestamp, length long, content binary")
    return files.load(folder).select("path", "length")


def _opened(path: str, length: int, use: Callable[[Reader], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(_address(path))
    with system.open_input_file(place) as file:
        try:
            yield from use(Reader(file, length))
        except StoreError as e:
            raise StoreError(f"{path}: {e}") from e


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    """path, length, partition, before (ids in the earlier files of the same partition) of the store's files, by their
    directories; and how many ids lie before each partition. One number for each partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                yield from _opened(path, length, lambda r: iter([pa.RecordBatch.from_pydict({"path": [path], "length": [length], "ids": [int(r.starts_of[-1])]})]))  # noqa: B023

    name = F.element_at(F.split("path", "/"), -1)
    sizes, _ = written(_files(spark, folder).mapInArrow(frugal(run), "path string, length long, ids long").withColumn("partition", F.split(name, "-")[0]), "sizes")
    starts, before = {}, 0
    for r in sorted(sizes.groupBy("partition").agg(F.sum("ids").alias("ids")).collect()):
        starts[r["partition"]], before = before, before + r["ids"]
    earlier = F.sum("ids").over(Window.partitionBy("partition").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select("path", "length", "partition", F.coalesce(earlier, F.lit(0)).alias("before"))
    # A row is a whole file to read: as many tasks as there are partitions, however few bytes the rows have.
    return placed.repartition(partitions(spark), "path"), starts


def read_tokens(spark: SparkSession, folder: str, wanted: Iterable[int] | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the little-endian ids) and token_ids (null
    unless ids) of the documents in folder; with wanted, a list of ids, only of those, whose frames alone are read.

    Every frame read is held against its checksum, every directory too; a broken file fails the query.
    """
    files, known = _placed(spark, folder)
    starts = spark.sparkContext.broadcast(known)
    chosen = None if wanted is None else spark.sparkContext.broadcast(np.array(sorted(set(wanted)), np.int64))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def documents(reader: Reader) -> Iterator[tuple[int | None, int, bytes]]:
        if chosen is None:
            yield from reader.documents()
        else:
            for i in np.flatnonzero(np.isin(reader.doc_ids, chosen.value) & (reader.no_id == 0)).tolist():
                yield int(reader.doc_ids[i]), int(reader.starts_of[i]), reader.document(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, partition, before in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "partition", "before")), strict=True):
                base = starts.value[partition] + before

                def rows(reader: Reader, base: int = base) -> Iterator[pa.RecordBatch]:
                    held, size = [], 0
                    for doc_id, start, data in documents(reader):
                        held.append((doc_id, base + start, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4").astype(np.int64) if ids else None))
                        size += 60 + (2 * len(data) if ids else 0)
                        if size > READ_BYTES:
                            yield packed(held)
                            held, size = [], 0
                    if held:
                        yield packed(held)

                yield from _opened(path, length, rows)

    return files.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids array<long>")


def round_trip(df: DataFrame, folder: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write df's token ids into folder and read them back: doc_id, start, n_tokens, ids_crc32 of every row.

    See write_tokens for nulls, repeats and order. Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    write_tokens(df, folder, tokenizer_file, end_id)
    return read_tokens(df.sparkSession, folder, ids=False).drop("token_ids")
