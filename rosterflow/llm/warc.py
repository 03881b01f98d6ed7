"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged archives.

Archives hold one gzip member a record. The reader checks each member (gzip's own check), each record's header and length, and its
payload digest. Where a check fails it searches for the next member that opens with a record, or the next version line, goes on from
there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MembershipFilter, Spread, materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record. A revisit has the response's HTTP header, with the full payload's length, but not its payload."""
    one_line = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", one_line(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place after it."""
    m = VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at)
    if not m or end < 0:
        raise Damaged("no version line" if not m else "header does not end")
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[k.strip().lower().decode(errors="replace")] = v.strip().decode(errors="replace")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block and length disagree")
    block = data[start:stop]
    body = block.find(b"\r\n\r\n")
    http = re.search(rb"(?im)^content-length:\s*(\d+)", block[: max(body, 0)])
    fields["payload"] = block[body + 4 :] if body >= 0 else block
    fields["payload_bytes"] = int(http[1]) if http else len(fields["payload"])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "response" and digest and base32_sha1(fields["payload"]) != digest:
        raise Damaged("payload and digest disagree")
    return fields, stop + 4


def inflate(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The member at ``at`` and the place after it. It is fed in growing steps, so that what stands behind it is not copied."""
    z, view, out, step = zlib.decompressobj(31), memoryview(data), [], 4096
    try:
        if most:  # a start is enough to see what a member holds
            return z.decompress(view[at : at + most], 64), at
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + step]))
            at, step = min(at + step, len(data)), min(2 * step, 1 << 20)
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    if not z.eof:
        raise Damaged("gzip member is cut off")
    return b"".join(out), at - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, dict]]:
    """('record', fields) and ('gap', {start, end, reason}) along an archive's bytes, plain or gzipped by record."""
    at, gap, reason = 0, None, ""

    def resume(after: int) -> int:
        """The next place that opens a record."""
        k = after
        while True:
            m = VERSION.search(data, k)
            found = [x for x in (data.find(MAGIC, k), m.start() if m else -1) if x >= 0]
            if not found:
                return len(data)
            k = min(found)
            if data[k : k + 4] == b"WARC":
                return k
            try:
                if VERSION.match(inflate(data, k, 4096)[0]):
                    return k
            except Damaged:
                pass
            k += 1

    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                inner, after = inflate(data, at)
                if not VERSION.match(inner):
                    raise Damaged("member without a record")
                yield from within(inner, at, after)
            else:
                fields, after = parse_record(data, at)
                yield "record", fields | {"offset": at}
            at = after
        except Damaged as e:
            gap, reason = at, str(e)
            at = resume(at + 1)
            yield "gap", {"start": gap, "end": at, "reason": reason}


def within(inner: bytes, start: int, end: int) -> Iterator[tuple[str, dict]]:
    """Records of one member; bytes that fail inside it are reported as a gap of the member's own bytes."""
    at = 0
    while at < len(inner):
        try:
            fields, at = parse_record(inner, at)
            yield "record", fields | {"offset": start}
        except Damaged as e:
            m = VERSION.search(inner, at + 1)
            at = m.start() if m else len(inner)
            yield "gap", {"start": start, "end": end, "reason": str(e)}


def payload_roles(pages: DataFrame, id_col: str, html_col: str, least: int = 0) -> DataFrame:
    """id, leader of pages that repeat another's payload of at least ``least`` bytes: the largest id of those is the response."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    rows = materialize(rows, "payloads")
    groups = materialize(rows.groupBy("digest").agg(F.max("id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "shared")
    # one payload may stand on a large part of all pages
    return Spread(groups, "digest").join(rows, groups.select("digest", "leader"), "digest", by="id").filter("not id <=> leader").select("id", "digest", "leader")


def archive_folder(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    if folder.startswith("file:/") and "://" not in folder:
        folder = folder.replace("file:/", "file:///", 1)
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, roll_bytes: int = 16_000_000) -> DataFrame:
    """Writes archives of about ``roll_bytes`` into ``folder`` and returns the list of files: file, size, records.

    Only pages that may be revisits are shuffled, to meet their response; the others are written where they are read. A file appears
    under its own name once it is whole, so a task that is run again replaces what it wrote.
    """
    revisits = materialize(payload_roles(pages, id_col, html_col, least), "revisits")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marked = MembershipFilter(revisits, "id").mark(rows, "id", "maybe")
    # a repeated page id may stand for several payloads
    again = marked.filter("maybe").drop("maybe").withColumn("digest", F.unhex(F.sha2("html", 256)))
    leaders = revisits.distinct().select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "leader")
    again = again.join(leaders, F.expr("id <=> _id and digest = _digest"), "left").select("id", "url", "html", "leader").sortWithinPartitions("id", "url", "html")
    first = marked.filter("not maybe").select("id", "url", "html", F.lit(None).cast(pages.schema[id_col].dataType).alias("leader"))

    def write(part: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = archive_folder(folder)
            fs.create_dir(root, recursive=True)
            task = TaskContext.get()
            made: list[tuple[str, int, int]] = []
            buffer, count = bytearray(), 0

            def close() -> None:
                nonlocal buffer, count
                if count:
                    name = f"{part}-{task.partitionId():06d}-{len(made):05d}.warc.gz"
                    with fs.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None) as f:
                        f.write(bytes(buffer))
                    fs.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
                    made.append((name, len(buffer), count))
                    buffer, count = bytearray(), 0

            for batch in batches:
                for page_id, url, html, leader in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    buffer += member(record(page_id, url, html.encode(), leader, leader is not None))
                    count += 1
                    if len(buffer) >= roll_bytes:
                        close()
            close()
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "size", "records"])

        return run

    schema = "file string, size bigint, records bigint"
    return materialize(first.mapInArrow(write("first"), schema).unionByName(again.mapInArrow(write("again"), schema)), "files")


def read_archives(spark: SparkSession, folder: str, names: str = "*.warc.gz", listed: DataFrame | None = None) -> DataFrame:
    """Every record and every gap of the archives: kind, file, start, end, reason, page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload. listed: the list that write_archives returned; then no other file of the folder is read."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = archive_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    yield from run(iter([pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], ["path", "content"])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["kind", "file", "start", "end", "reason", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        urn = lambda x: m[1] if (m := re.fullmatch(r"<urn:page:(.+)>", x or "")) else None
        for batch in batches:
            for k in range(batch.num_rows):
                file, out = batch.column(0)[k].as_py(), []
                for kind, f in salvage(batch.column(1)[k].as_py()):
                    if kind == "gap":
                        out.append((kind, file, f["start"], f["end"], f["reason"], *[None] * 7))
                    else:
                        revisit = f.get("warc-type") == "revisit"
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(f["payload"])
                        size = f["payload_bytes"] if revisit else len(f["payload"])
                        out.append((kind, file, f["offset"], None, None, urn(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, f.get("warc-type"), urn(f.get("warc-refers-to")), None if revisit else f["payload"]))
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "kind string, file string, start bigint, end bigint, reason string, page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
    if listed is not None:
        return listed.select("file").repartition("file").mapInArrow(opened, schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "content")
    return files.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes pages and reads them back: one row per record, with id_col, payload_bytes, payload_digest, record_type, refers_to.

    A null page has an empty payload. Pages that repeat one id and payload are written once each, with one role; a page without an id
    has the least of all. Gaps are logged as a table beside the archives, in the folder ``gaps``: file, start, end, reason. Other
    columns are not read. An empty table writes nothing and reads nothing.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    folder = folder or scratch_path(spark, "archives")
    written = write_archives(pages, folder, id_col, url_col, html_col, least)
    if written.isEmpty():
        return spark.createDataFrame([], f"{id_col} {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    found = materialize(read_archives(spark, folder, listed=written).drop("payload", "url"), "read")
    found.filter("kind = 'gap'").select("file", "start", "end", "reason").write.mode("overwrite").parquet(f"{folder}/gaps")
    r = found.filter("kind = 'record'")
    return r.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
