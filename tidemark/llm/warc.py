"""WARC archives compressed by zstandard, one frame for each record, the dictionary in a leading skippable frame.

write_archives puts the records of each partition into files of a shared folder; read_archives loads the dictionary
from the leading frame, decodes frame by frame, and validates headers, lengths and digests of every record. Payloads
that occur again are written once: their other captures are revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices, written

#: Payloads from this many bytes on are written once.
MIN_REVISIT_BYTES = 1000
#: A file is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 8_000_000
#: Pages, and code points of each, that the dictionary is made of at most.
DICTIONARY_PAGES = 64
DICTIONARY_CHARS = 1_000
#: Payloads of more captures than this, and than the table's rows divided by HOT_PAYLOADS, are joined by a broadcast.
HOT = 10_000
HOT_PAYLOADS = 50_000
LEVEL = 3
#: Magic numbers of a skippable frame with a dictionary and of a frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: refers_to is the largest id with an equal payload of at least
    min_bytes bytes, null for that page itself and for all others.

    Null html is an empty payload. Rows that repeat the largest id are all responses; a null id never is the largest,
    so that equal payloads that all lack an id are all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha1("payload"))
    copies = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    copies, _ = written(copies.filter("n > 1 AND first_id IS NOT NULL"), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT, total // HOT_PAYLOADS)
    # Captures of a payload that very many pages share find it by a broadcast, and are spread by their ids in the second join.
    large = copies.filter(hot).select(F.col("payload_digest").alias("d"), F.col("first_id").alias("large"))
    found = rows.join(F.broadcast(large), F.col("payload_digest") == F.col("d"), "left")
    own = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))
    keyed = found.withColumn("key", F.when(F.col("large").isNotNull() | (F.octet_length("payload") < min_bytes), own).otherwise(F.col("payload_digest")))
    small = copies.filter(~hot).select(F.col("payload_digest").alias("key"), F.col("first_id").alias("small"))
    joined = keyed.join(small, "key", "left").withColumn("first_id", F.coalesce("large", "small"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit's block is the HTTP head alone, which still names the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        # The address as it is, but for what would break the header.
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', '') + '%')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    return out


def _page_id(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise WarcError(f"bad record id {value!r}")
    return int(value[10:-1]) if value[10:-1] else None


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload); WarcError if anything is amiss."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or not first.startswith(b"WARC/1."):
        raise WarcError("no WARC version line, or headers without end")
    fields = _fields(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise WarcError(f"missing headers: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("the block differs from its digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP head")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    kind, named = fields["warc-type"], fields.get("warc-payload-digest", "")
    refers_to = None
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if size != len(payload) or named and named != f"sha1:{digest}":
            raise WarcError("the payload differs from its length or digest")
    elif kind == "revisit":
        if payload or not named.startswith("sha1:") or "warc-refers-to" not in fields:
            raise WarcError("a revisit has a payload, or lacks what it refers to")
        digest, refers_to, payload = named[5:], _page_id(fields["warc-refers-to"]), None
    else:
        raise WarcError(f"unknown record type {kind!r}")
    return _page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, refers_to, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive, frame by frame; an archive without a dictionary frame is read without one."""
    import zstandard as zstd

    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise WarcError("the dictionary frame is cut off")
        raw = data[8 : 8 + size]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
        known, at = zstd.ZstdCompressionDict(raw), 8 + size
    decoder, view = zstd.ZstdDecompressor(dict_data=known) if known else zstd.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise WarcError("the last frame is cut off")
            step = view[at : at + 65_536]
            try:
                out.append(frame.decompress(step))
            except zstd.ZstdError as e:
                raise WarcError(f"broken frame at byte {at}: {e}") from e
            at += len(step) - len(frame.unused_data)
        yield parse_record(b"".join(out))


def sample_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """Raw content for a dictionary from a few pages' beginnings and ends; what it holds only matters to the archives' size."""
    html = F.col(html_col).cast("string")
    rows = pages.filter(html.isNotNull()).select(F.concat(F.left(html, F.lit(DICTIONARY_CHARS)), F.right(html, F.lit(DICTIONARY_CHARS // 4)))).limit(DICTIONARY_PAGES).collect()
    return "".join(r[0] for r in rows).encode()


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> None:
    """Write the rows of plan_records to folder, as <partition>-<number>.warc.zst of about ARCHIVE_BYTES each.

    A partition's rows are sorted, so that a task that runs again writes the same files; a file is moved to its name
    once it is whole. folder may be on any file system that pyarrow opens.
    """
    spark = records.sparkSession
    shipped = spark.sparkContext.broadcast(dictionary)
    at = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard as zstd
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(at)
        system.create_dir(base, recursive=True)
        coder = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(shipped.value, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_checksum=True) if len(shipped.value) >= 8 else zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
        partition, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> None:
            nonlocal number, size
            if held:
                name = f"{base}/{partition:06d}-{number:05d}.warc.zst"
                with system.open_output_stream(part := f"{base}/_{uuid.uuid4().hex}") as out:
                    if len(shipped.value) >= 8:
                        out.write(dictionary_frame(shipped.value))
                    for frame in held:
                        out.write(frame)
                system.move(part, name)
                number, size = number + 1, 0
                held.clear()

        for part in slices(batches, "payload"):
            for page_id, url, payload, digest, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                held.append(coder.compress(record_bytes(page_id, url, payload, digest, refers_to)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    records.sortWithinPartitions("page_id", "payload_digest", "url").mapInArrow(frugal(run), "files long").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record in the archives of folder, columns as in RECORD_SCHEMA; a revisit's payload is null.

    Every record is decoded and validated, payloads or not; a broken archive fails the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                try:
                    for record in read_archive(content.as_py()):
                        rows.append(record if payloads else (*record[:6], None))
                        size += len(rows[-1][6] or b"") + 200
                        if size > 4_000_000:
                            yield packed(rows)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(frugal(run), RECORD_SCHEMA)


def round_trip(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages as archives into folder and read the archives back (without payloads).

    Every row gives a record; see plan_records for nulls and repeats. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = pages.sparkSession
    write_archives(plan_records(pages, min_bytes), folder, sample_dictionary(pages))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return read_archives(spark, folder, payloads=False)
