"""WARC archives: writing pages as records, and reading archives back with their segments put together.

Writing. A page's HTTP response is framed in chunks and stored in a ``response`` record; a block of more than
``segment_bytes`` continues in ``continuation`` records that name the first record as their origin. Of pages with equal
payloads of ``dedupe_bytes`` or more, the one of the smallest id is stored and the others become ``revisit`` records that
refer to it. Records are written by Spark's text writer with the two line ends that close a WARC record as its separator,
so a file is a WARC file, goes through Spark's own committer (a lost task leaves nothing behind) and to any store.

Reading. Files are parsed record by record. Records in one piece are decoded where they are; only segments are shuffled,
grouped by origin, put in order of their number and checked for gaps and against the stated total length. Chunked framing
is decoded, digests are compared, and a revisit takes its figures from the record that it refers to.

Bounded memory: a file has at most ``file_records`` records of at most ``segment_bytes`` and their headers.

Defined cases: null html is an empty payload; a null url has no target header; control characters in a url are
percent-encoded; a null page id is the largest and comes back null; rows that repeat the smallest page id of a payload are
responses too, and repeated rows come back as often as they were written; incomplete or damaged records (a missing segment, a
wrong total or digest, broken chunks, a length that is no number or runs past the end of the file, a file cut short) come back
with ``complete`` false and a null payload; a page id that is not of ``id_type`` comes back null; no pages make no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32 << 10, 8 << 10, 4000
#: The most that is sent to every task when pages are written.
SENT_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url}|{digest}')}>"


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most ``most`` bytes that never split a character of UTF-8."""
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        yield data[at:to]
        at = to


def chunked(payload: bytes, most: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces(payload, most)) + b"0\r\n\r\n"


#: Digits of a chunk's size, and an extension that is ignored.
CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?")


def unchunked(body: bytes) -> bytes | None:
    """The payload in chunked framing; None if the framing is broken."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = CHUNK_SIZE.fullmatch(body, at, end)
        if size is None:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            return None
        out.append(body[end + 2 : at])
        at += 2
    return None


def record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}{CRLF}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1{CRLF}{head}{CRLF}{block.decode()}"


def records(page_id, url: str | None, payload: bytes, leader: dict | None, segment_bytes: int, chunk_bytes: int) -> Iterator[str]:
    """The records of one page. leader: the page that has the same payload and is stored, if it is another."""
    digest = base32_sha1(payload)
    own = record_id(page_id, url, digest)
    target = None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common_ = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = [("Content-Type", "application/http; msgtype=response")]
    if leader is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common_, ("WARC-Refers-To", record_id(leader["id"], leader["url"], digest)), ("WARC-Profile", IDENTICAL), *http], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = list(pieces(block, segment_bytes))
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common_, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), *http], parts[0])
    for n, part in enumerate(parts[1:], 2):
        this = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own}#{n}')}>"
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", this), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), *last], part)


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedupe_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS,
) -> None:
    """Writes gzipped WARC files of ``pages`` to the folder ``path``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("_key", F.sha1("html"))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    # Pages that share a payload: digests and ids alone are counted, and only digests that occur twice are joined. Few of them
    # are sent to every task, so that no page moves; more are joined by shuffling.
    shared = common.cut(
        rows.where(F.octet_length("html") >= dedupe_bytes).groupBy("_key").agg(F.count("*").alias("_n"), F.min(order).alias("_leader")).where("_n > 1").select("_key", "_leader"), "warc-shared"
    )
    small = shared.agg(F.coalesce(F.sum(F.lit(100) + F.coalesce(F.octet_length("_leader.url"), F.lit(0))), F.lit(0))).first()[0] <= SENT_BYTES
    joined = rows.join(F.broadcast(shared) if small else shared, "_key", "left").select(
        "id", "url", "html", F.when(F.col("_leader").isNotNull() & ~F.col("_leader.id").eqNullSafe(F.col("id")), F.struct("_leader.id", "_leader.url")).alias("leader")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "html"):
                cols = (part.column(c).to_pylist() for c in ("id", "url", "html", "leader"))
                made = [r for i, u, h, to in zip(*cols, strict=True) for r in records(i, u, h.encode(), to, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    out = joined.mapInArrow(run, "value string")
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


PARSED = "record_id string, type string, page_id string, digest string, refers_to string, origin string, segment int, total long, sound boolean, block binary"


def number(value: str | None, most: int) -> int | None:
    """A count in decimal digits; None for anything else."""
    return int(value) if value is not None and re.fullmatch("[0-9]{1,18}", value) and int(value) <= most else None


class Unpacked(io.RawIOBase):
    """Gzipped members on end, unpacked; it ends where the data ends or is no gzip."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member = data, 0, None

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while self.at < len(self.data) or (self.member is not None and self.member.unconsumed_tail):
            self.member = self.member or zlib.decompressobj(31)
            packed = self.member.unconsumed_tail
            if not packed:
                packed = self.data[self.at : self.at + (1 << 16)]
                self.at += len(packed)
            try:
                out = self.member.decompress(packed, len(to))
            except zlib.error:
                self.at, self.member = len(self.data), None
                return 0
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = None
            if out:
                to[: len(out)] = out
                return len(out)
        return 0


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped, whole or record by record. ``sound`` is false for a record that is damaged."""
    stream = io.BufferedReader(Unpacked(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode(errors="replace")] = v.strip().decode(errors="replace")
        whole = line != b""
        length = number(head.get("content-length", "0"), 1 << 40)
        # Blocks are read in parts, so that a length that is made up takes no memory.
        parts, left = [], length or 0
        while left and (part := stream.read(min(left, 1 << 20))):
            parts.append(part)
            left -= len(part)
        segment, total = number(head.get("warc-segment-number"), 2**31 - 1), number(head.get("warc-segment-total-length"), 2**62)
        readable = all(v is not None or k not in head for k, v in (("warc-segment-number", segment), ("warc-segment-total-length", total)))
        yield {
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "page_id": head.get("warc-page-id"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": head.get("warc-refers-to"), "origin": head.get("warc-segment-origin-id"), "segment": segment, "total": total,
            "sound": whole and length is not None and not left and readable, "block": b"".join(parts),
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, segments as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for r in parse(data.as_py()):
                    rows.append(r)
                    size += len(r["block"])
                    if size > common.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)


def reassemble(found: DataFrame) -> DataFrame:
    """Records in one piece: record_id, type, page_id, digest, refers_to, blocks (parts in order), and whether all of it was there.

    Segments are grouped by origin, so a group is one record. A record that was written twice has each of its segments
    twice; it comes out twice.
    """
    whole = found.where("segment is null").select("record_id", "type", "page_id", "digest", "refers_to", F.array("block").alias("blocks"), F.col("sound").alias("complete"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = (
        found.where("segment is not null").withColumn("record_id", F.coalesce("origin", "record_id")).groupBy("record_id")
        .agg(first("type"), first("page_id"), first("digest"), F.max("total").alias("_total"), F.count_if(F.col("segment") == 1).alias("_copies"), F.min("sound").alias("_sound"),
             F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("_parts"))
    )
    n, size = F.size("_parts"), F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    ordered = (F.element_at("_parts", 1)["segment"] == 1) & (F.element_at("_parts", -1)["segment"] == n)
    joined = groups.select(
        "record_id", F.coalesce("type", F.lit("response")).alias("type"), "page_id", "digest", F.lit(None).cast("string").alias("refers_to"), F.transform("_parts", lambda p: p["block"]).alias("blocks"),
        F.coalesce(ordered & (size == F.col("_total")) & F.col("_sound"), F.lit(False)).alias("complete"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_copies").cast("int")))).alias("_copy"),
    ).drop("_copy")
    return whole.unionByName(joined)


def read_warc(spark: SparkSession, path: str, *, id_type: str = "long") -> DataFrame:
    """record_id, type, page_id, digest, refers_to, complete, payload, payload_bytes and payload_digest of every record."""
    out = "record_id string, type string, page_id string, digest string, refers_to string, complete boolean, payload binary, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):  # a record may be long, so one is worked on at a time
                (r,) = batch.slice(i, 1).to_pylist()
                head, _, body = b"".join(r.pop("blocks")).partition(b"\r\n\r\n")
                payload = None
                if r["type"] == "response" and r["complete"]:
                    payload = unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body
                    r["complete"] = payload is not None and r["digest"] in (None, base32_sha1(payload))
                ok = payload is not None and r["complete"]
                row = r | {"payload": payload if ok else None, "payload_bytes": len(payload) if ok else None, "payload_digest": base32_sha1(payload) if ok else r["digest"]}
                rows.append(row)
                size += len(body)
                if size > common.SLICE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out))
    return reassemble(read_records(spark, path)).mapInArrow(run, out).withColumn("page_id", F.col("page_id").try_cast(id_type))


def resolve(found: DataFrame) -> DataFrame:
    """Figures of each page; a revisit's are those of the response that it refers to. Payloads are not moved."""
    thin = found.select("record_id", "type", "page_id", "refers_to", "payload_bytes", "payload_digest", "complete")
    said = thin.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes"))
    return thin.join(said, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("_page").alias("refers_to"), "complete"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to archives in the shared folder, then reads the archives."""
    path = common.shared_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # The parsed figures are cut off from the archive scan: they are a few bytes a page, and both sides of the join need them.
    found = read_warc(spark, path).drop("payload")
    return resolve(common.cut(found, "warc-figures")).drop("complete")
