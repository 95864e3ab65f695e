"""WARC archives: gzip records written and read by Spark, with a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactloom.llm.staging import shared_dir, stage

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SLICE = 4096
#: A gzip member without content. Spark's text writer needs a separator between rows; this one is valid between members.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(col):
    """A hex SHA-1 in base 32: each five hex digits are four base-32 ones."""
    parts = [F.lpad(F.conv(F.substring(col, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def plan_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Adds payload_bytes, digest and refers_to (null for responses) to page_id, payload.

    Of equal payloads of at least min_bytes, the row with the largest page_id is the response. Only digests go through
    the shuffle of the aggregate; of its result, the groups of several rows are joined back.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_of_hex(F.sha1("payload")))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, ["digest", "payload_bytes"], "left").withColumn("refers_to", F.when(F.col("owner") != F.col("page_id"), F.col("owner"))).drop("owner")


def write_archives(planned: DataFrame, path: str, archive_bytes: int = 32 << 20, level: int = 4) -> None:
    """One gzip member a record, written by Spark's text writer, whose commit protocol covers lost tasks.

    A file is one row: members of archive_bytes together, or the one that passes them, so that a reader can hold a whole archive
    however long the records are. Pages keep their URL out of the record id: urn:page:<page_id>, empty for a null page_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["members"])

        for b in batches:
            digest, size, page, refers = (b.column(n).to_pylist() for n in ("digest", "payload_bytes", "page_id", "refers_to"))
            for d, n, i, p, r in zip(digest, size, page, b.column("payload"), refers, strict=True):
                head = {"WARC-Type": "response" if r is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if i is None else i}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{d}", "WARC-Payload-Length": str(n)}
                if r is not None:
                    head |= {"WARC-Refers-To": f"<urn:page:{r}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.append(pack.compress(record(head, p.as_py().encode() if r is None else b"")) + pack.flush())
                held += len(out[-1])
                if held >= archive_bytes:
                    yield archive()
                    out, held = [], 0
        if out:
            yield archive()

    members = planned.mapInArrow(run, "members binary").select(F.col("members").cast("string").alias("value"))
    members.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


@dataclass
class Found:
    """A record of an archive, or with a reason the byte gap [start, end) that was set aside."""

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Damaged(Exception):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """A member's content and its end, fed in slices: what lies behind the member is never copied."""
    unpack, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(view[at : at + SLICE]))
            at += SLICE
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    if not unpack.eof:
        raise Damaged("gzip: cut short")
    return b"".join(out), min(at, len(data)) - len(unpack.unused_data)


def _part(data: bytes, at: int) -> bytes:
    """What a damaged member holds before its first error: the slice that fails is fed again byte by byte."""
    unpack, view, out = zlib.decompressobj(31), memoryview(data), []
    while at < len(data):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[at : at + SLICE]))
        except zlib.error:
            try:
                for k in range(at, min(at + SLICE, len(data))):
                    out.append(before.decompress(view[k : k + 1]))
            except zlib.error:
                break
        at += SLICE
    return b"".join(out)


def _records(inner: bytes, start: int, end: int, proven: bool = False) -> Iterator[Found]:
    """The sound records of a member's content, and its gaps; proven: only those with a payload digest that holds and a next record behind."""
    at, lost, why = 0, None, ""
    while at < len(inner):
        try:
            headers, block, stop = _parse(inner, at)
            if proven and (headers.get("warc-type") == "revisit" or not headers.get("warc-payload-digest", "").startswith("sha1:")):
                raise Damaged("no digest in a damaged member")
            if proven and not inner.startswith(VERSION, stop):
                raise Damaged("touches the damage")
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            nxt = inner.find(VERSION, at + 1)
            at = nxt if nxt >= 0 else len(inner)
            continue
        if lost is not None:
            yield Found(start, end, f"{why} (inflated bytes {lost} to {at})")
            lost = None
        yield Found(start, end, None, headers, block)
        at = stop
    if lost is not None:
        yield Found(start, end, f"{why} (inflated bytes {lost} to {len(inner)})")


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """One record at `at`, checked: version line, length, end mark, payload digest."""
    if not data.startswith(VERSION, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers without an end")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length and end mark disagree")
    block = data[start:stop]
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and headers.get("warc-type") != "revisit" and base32_sha1(block) != digest[5:]:
        raise Damaged("digest")
    return headers, block, stop + 4


def salvage(data: bytes) -> Iterator[Found]:
    """All sound records of an archive in order. After a failed check, the next valid member or version line is sought.

    The bytes in between come as one gap with the reason of its first failure. Members may hold several records or none;
    a damaged record in one is a gap of its own, with its place in the inflated bytes. Of a member that doesn't inflate
    to its end, the records before the error are kept: all of one cut short at the end of the archive, else those whose
    digest holds and which another record follows; the one that touches the error is set aside with it.
    """
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                inner, end = _member(data, at)
                found = _records(inner, at, end)
                if inner and VERSION not in inner:
                    raise Damaged("no version line")
            else:
                headers, block, end = _parse(data, at)
                found = [Found(at, end, None, headers, block)]
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            nxt = _CANDIDATE.search(data, at + 1)
            end = nxt.start() if nxt else len(data)
            if str(e).startswith("gzip"):
                yield from (f for f in _records(_part(data, at), at, end, proven="cut short" not in str(e)) if f.reason is None)
            at = end
            continue
        if lost is not None:
            yield Found(lost, at, why)
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield Found(lost, len(data), why)


FIELDS = "archive string, start bigint, stop bigint, gap_reason string, record_type string, record_id string, refers_to string, stated_digest string, stated_bytes bigint, block_bytes bigint, block_digest string"


def read_archives(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """Rows of FIELDS (and block binary, if asked for) of all files below path.

    A row with gap_reason is a quarantined byte range; all others are checked records. Both plain and gzip archives
    are read, each by one task that holds it, so they must be below 2 GB, the limit of a value. Empty files give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for f in salvage(content.as_py()):
                    h = f.headers
                    size = h.get("warc-payload-length", "")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    # a response's digest was checked against its block just now
                    own = None if f.reason else digest if digest and h.get("warc-type") != "revisit" else base32_sha1(f.block)
                    rows.append((name, f.start, f.end, f.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), digest, int(size) if size.isdigit() else None, None if f.reason else len(f.block), own, *([f.block] if blocks else [])))
                    held += len(f.block) if blocks else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    spec = [x.split() for x in (FIELDS + ", block binary" * blocks).split(", ")]
    names = [n for n, _ in spec]
    schema = pa.schema([(n, kinds[k]) for n, k in spec])
    return files.mapInArrow(run, FIELDS + ", block binary" * blocks)


def gaps(records: DataFrame) -> DataFrame:
    """The quarantined byte ranges of read_archives: archive, start, stop, gap_reason."""
    return records.where("gap_reason is not null").select("archive", "start", "stop", "gap_reason")


def page_of(col):
    return F.nullif(F.regexp_extract(col, "<urn:page:(.*)>", 1), F.lit("")).cast("bigint")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back, one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html counts as an empty payload;
    payloads of any length are whole records; rows that repeat the largest page_id of equal payloads are all responses,
    and so are rows of null page_id; no rows give no rows. What is read back is written once more: the records, and the
    log of quarantined gaps beside them, which must be empty for archives that were just written.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    write_archives(plan_revisits(pages, min_bytes), f"{folder}/archives")
    records = stage(read_archives(spark, f"{folder}/archives"), "records")
    lost = gaps(records)
    lost.write.json(f"{folder}/gaps")
    if n := lost.count():
        raise ValueError(f"{n} byte ranges of the archives were quarantined, see {folder}/gaps")
    got = records
    revisit = F.col("record_type") == "revisit"
    return got.select(
        page_of(F.col("record_id")).alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("block_digest")).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"),
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS owner FROM p),
g AS (SELECT h.*, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i::INT + 1, 5))::BIGINT) AS words FROM h),
d AS (SELECT g.*, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((words[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM d"""
