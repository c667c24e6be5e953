"""A content-addressed WARC archive.

An archive is a folder with two tables. ``payloads`` holds every distinct payload once,
under its SHA-256. ``headers`` holds every record's exact header bytes, its block's own
bytes before the payload, and the digest that its payload is stored under. Joining the two
gives every original record back, byte by byte; on the way each payload is hashed again,
and a payload that doesn't have its digest is an error.

Equal payloads are aggregated before they are shuffled, so a payload that a third of the
records share costs one row for each task. The join is on the digest of stored payloads;
of the headers' side, a hot digest's partition can be split.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, remove, scratch_dir, written

#: From so many bytes on, a repeated payload is a revisit of the first record that has it.
LEAST = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    """A name-based UUID (version 5 layout) of the page id."""
    h = F.sha1(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """Writes one WARC record for each row of ``pages`` (page_id, url, html).

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads
    of at least ``least`` bytes the one with the smallest page_id is the response (null ids
    come last) and the others revisit it; rows that repeat that page_id are responses as
    well. Smaller payloads are all responses. Control characters and blanks in a URL are
    percent-encoded, as a header has one line; a null URL has no header. Other columns are
    not read. An empty table writes an empty archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.col("url")
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id")), F.lit(">"))),
        F.coalesce(line("WARC-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("first_id")), F.lit(">"))),
            line("WARC-Refers-To-Page-ID", F.col("first_id").cast("string")),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length("head") + F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    (
        rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
        .join(first, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("head", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")))
        .select(record_id(F.col("page_id")).alias("record_id"), header.cast("binary").alias("header"), F.col("head").cast("binary").alias("head"), "digest", (F.col("record_type") != "revisit").alias("inline"))
        .write.parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, header, head, digest, payload and inline of every record, payloads verified.

    ``inline`` is whether the record's own bytes hold the payload. A revisit has the payload of the record that it refers to. A missing or damaged
    payload raises an error rather than giving other bytes.
    """
    headers = spark.read.schema("record_id string, header binary, head binary, digest string, inline boolean").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, first_id long, payload binary").parquet(f"{path}/payloads").select("digest", "payload")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload without its digest: "), F.col("digest"))).cast("binary")))
    joined = headers.join(checked, "digest", "left")
    whole = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("digest"))).cast("binary"))
    return joined.select("record_id", "header", "head", "digest", whole.alias("payload"), "inline")


def field(header: Column, name: str) -> Column:
    """A header's value, null if the record lacks it."""
    found = F.regexp_extract(header.cast("string"), rf"(?i)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def records(archive: DataFrame) -> DataFrame:
    """record_id and the exact bytes of each WARC record (header, block and the closing lines)."""
    end = F.lit("\r\n\r\n").cast("binary")
    return archive.select("record_id", F.when(F.col("inline"), F.concat("header", "head", "payload", end)).otherwise(F.concat("header", "head", end)).alias("record"))


#: Bytes of a file that is read as one value.
HELD = 1 << 30
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n")
_HTTP = re.compile(rb"(?i)\r\nContent-Type:[ \t]*application/http")
_ID = re.compile(rb"(?i)\r\nWARC-Record-ID:[ \t]*<([^>\r\n]*)>")
_PARSED = "record_id string, header binary, head binary, payload binary"


def parse_records(data: bytes | io.BufferedIOBase) -> Iterator[tuple[str | None, bytes, bytes, bytes]]:
    """(record id, header, head, payload) of the records of a WARC file (its bytes, or a stream of them), plain or gzipped.

    The three parts and the two closing lines are the record's exact bytes. head is what an
    HTTP message has before its body, else empty. A gzipped file is unpacked as it is read,
    so that of a stream one record at a time is held. ValueError at the first byte that isn't part of a
    record.
    """
    raw = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    stream, at = (gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw), 0
    try:
        while header := _header(stream):
            length = _LENGTH.search(header)
            if not header.endswith(b"\r\n\r\n") or not header.startswith(b"WARC/") or not length:
                raise ValueError(f"no record at byte {at}")
            block = stream.read(int(length[1]))
            if len(block) < int(length[1]) or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} doesn't end where its length says")
            cut = block.find(b"\r\n\r\n") + 4 if _HTTP.search(header) else 0
            cut = 0 if cut < 4 else cut
            found = _ID.search(header)
            yield found and found[1].decode("utf-8", "replace"), header, block[:cut], block[cut:]
            at += len(header) + len(block) + 4
    except (EOFError, OSError, zlib.error) as e:
        raise ValueError(f"the record at byte {at} can't be unpacked: {e}") from None


def _header(stream) -> bytes:
    """All up to the next empty line, with it; less at the end of the stream."""
    lines: list[bytes] = []
    while line := stream.readline():
        lines.append(line)
        if line == b"\r\n" and (len(lines) == 1 or lines[-2].endswith(b"\r\n")):
            break
    return b"".join(lines)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``.warc`` and ``.warc.gz`` files under a path; a damaged file is an error.

    Files of up to ``HELD`` bytes are read by Spark, from any store that it knows. Larger ones are streams, of any length, which a
    task opens by Arrow from the path's address.
    """
    names = [f.split()[0] for f in _PARSED.split(", ")]

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for record in found:
            yield pa.RecordBatch.from_arrays([pa.array([record[0]], pa.string()), *(pa.array([x], pa.binary()) for x in record[1:])], names=names)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from rows(parse_records(content.as_py()))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                store, own = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", at))
                with store.open_input_stream(own, compression=None) as f:
                    yield from rows(parse_records(f))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").option("recursiveFileLookup", "true").load(path)
    small, large = files.where(F.col("length") <= HELD).select("content"), files.where(F.col("length") > HELD).select("path")
    return small.mapInArrow(held, _PARSED).unionByName(large.mapInArrow(streamed, _PARSED))


def write_files(archive: DataFrame, path: str) -> DataFrame:
    """Writes the exact records as ``part-*.warc.gz`` files, each record a member of its own; tells file, records and bytes.

    ``path`` is a folder that all executors share, by a URI that Arrow can write to. A task
    writes one file, under a name of its own until it is whole, so one that is repeated
    replaces its file. Partitions without records write none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, own, out, n, size = f"part-{TaskContext.get().partitionId():05d}.warc.gz", f"{root}/.{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            for record in batch.column(0):
                out = out or store.open_output_stream(own, compression=None)
                data = gzip.compress(record.as_py(), mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            store.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "records", "bytes"])

    bound_batches(archive.sparkSession)
    return written(records(archive).select("record").mapInArrow(run, "file string, records long, bytes long"))[0]


def store_records(records: DataFrame, path: str) -> None:
    """Archives parsed records (record_id, header, head, payload): equal payloads once, all else as it is. Null parts count as empty."""
    part = lambda name: F.coalesce(name, F.lit("").cast("binary")).alias(name)
    rows = records.select("record_id", part("header"), part("head"), part("payload")).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.lit(None).cast("long").alias("first_id"), F.min("payload").alias("payload")).write.parquet(f"{path}/payloads")
    rows.select("record_id", "header", "head", "digest", F.lit(True).alias("inline")).write.parquet(f"{path}/headers")


def archive_report(pages: DataFrame) -> DataFrame:
    """Archives ``pages``, reads the archive back and tells of each record what it is.

    Sizes and digests are taken from the reconstructed payloads, all else from the header bytes.
    The archive is gone when the report is written.
    """
    spark = pages.sparkSession
    path = scratch_dir(spark)
    write_archive(pages, path)
    header = F.col("header")
    report = read_archive(spark, path).select(
        field(header, "WARC-Page-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        field(header, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )
    out, _ = written(report)
    remove(spark, path)
    return out
