"""WARC archives: a writer with revisit records, and a reader that splits files anywhere.

Every record is a gzip member of its own. A reader task scans its byte range for gzip's magic bytes, takes a place for
a record only if the member's first bytes decode to a WARC version line, and owns the records that start inside its
range, reading past the end of the range where the last one does. From there on it walks from member to member.

Archives are written by tasks under temporary names and moved into place, so a repeated task replaces its own file.
Paths are opened through the file system of their URI, so the folder may be any that all executors share.

Defined results: a null payload is empty; a null id is an id like others; a repeated row gives a record of its own
(each but one group's first by id is a revisit, and equal ids share the first's role); ties need no order, since only
the smallest id counts; an empty table gives an archive folder without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceworks.session import checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
           "payload binary, intact boolean")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _urn_id(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record as a gzip member; a revisit names the first record and leaves the payload out."""
    block = b"" if revisit else payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {record_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    raw = VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        task = TaskContext.get()
        final = f"{root}/part-{task.partitionId():06d}.warc.gz"
        hidden = f"{root}/_writing-{task.partitionId():06d}-{task.taskAttemptId()}"
        size = 0
        with fs.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    member = record(r["page_id"], r["uri"], r["payload"],
                                    base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["first_id"], r["revisit"])
                    out.write(member)
                    size += len(member)
        if size:
            if fs.get_file_info(final).is_file:  # left by an attempt that was lost after the move
                fs.delete_file(final)
            fs.move(hidden, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task.partitionId():06d}.warc.gz"]),
                                              pa.array([size], pa.int64())], ["file", "bytes"])
        else:
            fs.delete_file(hidden)

    return work


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write one record per row below ``folder`` and return (file, bytes) of the archives.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id is the response.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"),
                         payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = F.length("payload") >= least
    first = pages.where(large).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where(
        "n > 1").select("sha1", "first_id")
    rows = pages.join(first, "sha1", "left").withColumn(
        "revisit", F.coalesce(large & (F.col("page_id") != F.col("first_id")), F.lit(False)))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    listing = f"{folder}/_files"
    rows.select("page_id", "uri", "payload", "sha1", "first_id", "revisit").mapInArrow(
        _writer(folder), "file string, bytes long").write.parquet(listing)
    return spark.read.schema("file string, bytes long").parquet(listing)


def _member(read, at: int, block: int) -> tuple[bytes, int] | None:
    """The decoded gzip member that starts at ``at`` and where it ends, or null if none can be decoded there."""
    unpacker, out, place = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        data = read(place, block)
        if not data:
            return None
        try:
            out.append(unpacker.decompress(data))
        except zlib.error:
            return None
        if place == at and not b"".join(out).startswith(VERSION[: max(1, len(out[0]))]):
            return None
        place += len(data)
    raw = b"".join(out)
    return (raw, place - len(unpacker.unused_data)) if raw.startswith(VERSION) else None


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(block).digest()).decode()
        intact, size = found == digest, len(block)
        digest = found
    else:
        intact, size = True, int(fields.get("x-payload-length", 0))
    return {"page_id": _urn_id(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "record_type": kind,
            "payload_digest": digest, "payload_bytes": size, "refers_to": _urn_id(fields.get("warc-refers-to")),
            "payload": block if kind == "response" else None, "intact": intact}


def records_in_range(handle, start: int, end: int, total: int, block: int = 1 << 16) -> Iterator[dict]:
    """Records whose first byte lies in ``start`` to ``end`` of an opened file of ``total`` bytes."""
    def read(at: int, n: int) -> bytes:
        if at >= total:
            return b""
        handle.seek(at)
        return handle.read(n)

    at = start
    while at < end:
        found = _member(read, at, block)
        if found is None:
            # Look for the next magic bytes; the last two bytes of a block are seen again with the next.
            at += 1
            while at < end:
                hit = read(at, block).find(MAGIC)
                if hit >= 0:
                    at += hit
                    break
                at += block - len(MAGIC) + 1
            continue
        raw, after = found
        yield _parse(raw)
        at = after


def _reader(folder: str):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            for split in batch.to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{root}/{split['file']}") as handle:
                    for r in records_in_range(handle, split["start"], split["end"], split["bytes"]):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if len(rows) >= 500 or size > 8_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return work


def read_archives(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives: ``files`` has (file, bytes), files are read in ranges of ``split_bytes``."""
    step = F.lit(split_bytes).cast("long")
    splits = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start")).withColumn(
        "end", F.least(F.col("start") + step, F.col("bytes")))
    # A number, since the splits' own rows are so small that they would all be given to one task.
    tasks = min(max(1, splits.count()), MOST_TASKS)
    return splits.repartition(tasks, "file", "start").mapInArrow(_reader(folder), RECORDS)


#: Tasks that read archives at once, beyond which a task takes several ranges.
MOST_TASKS = 100_000


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
