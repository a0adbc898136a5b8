"""WARC archives: writing with revisit records, segments and chunked framing, and reassembly.

Writing.  The largest page of each group of equal payloads is a ``response``, the others are ``revisit``
records without a body, which name it by its record identifier, URI and payload digest.  A response is an HTTP
message with ``Transfer-Encoding: chunked``; a block longer than SEGMENT_BYTES is cut into a first record and
``continuation`` records, the last with the total length.  Every record is a gzip member of its own, so a reader can
begin at any; Spark's text writer puts the members into files in any store, its line end being an empty member.

Reading.  Files are read whole (their size is bounded by RECORDS_PER_FILE records of about SEGMENT_BYTES)
and decompressed as a stream.  A record that is whole is decoded at once and only its figures go on.
Segments are grouped by the identifier of their origin, ordered by segment number, checked for gaps and
against the total length, joined, and the chunked framing of the result is decoded.  A revisit has the figures
of the response that it names (by identifier, else by digest), not of what its writer says.

Defined cases: a null html is an empty payload; equal means the same SHA-256 and length; of rows that repeat
the largest page_id of a group each is a response, which revisits name by digest alone if they repeat it whole; a
null page_id counts as the smallest and is read back as null; a null or odd url is written percent-encoded; an
origin with a missing or repeated segment, or whose length, framing or digest is wrong, and a revisit whose response
is not there, are returned with ``complete`` false and null figures; so is a record that is cut or has a number that
is none, and reading goes on at the next record, or the next gzip member after a damaged one; a record without an
identifier is an origin of its own; records that share one are read each; a page of any length is written in segments; other columns of the input, whatever their
names, are not read; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.llm.storage import fresh_path, join_groups, settle, tidy

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: What ends a written record: a gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The entity in a chunked body; chunk extensions and trailers are passed over.  ValueError if cut or wrong."""
    at, out = 0, []
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is cut")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


class Keeper(NamedTuple):
    """The page that is the response of a group of equal payloads, and how many rows are that very page."""

    page_id: int | None
    url: str | None
    copies: int


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + CRLF + block


def record_name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join(map(str, parts)).encode()).hexdigest())}>"


def uri(url: str | None) -> str:
    return quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")


def page_records(page_id: int | None, url: str | None, payload: bytes, keeper: Keeper, is_response: bool, token: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, a whole response, or a response in segments."""
    sha = hashlib.sha256(payload).hexdigest()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri(url))]
    page = [] if page_id is None else [("X-Page-Id", str(page_id))]
    digest = [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    http = [("Content-Type", "application/http; msgtype=response")]
    alone = keeper.copies == 1
    if not is_response:
        to = [("WARC-Refers-To", record_name(keeper.page_id, sha))] if alone else []
        to += [("WARC-Refers-To-Target-URI", uri(keeper.url)), ("WARC-Refers-To-Date", DATE)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_name(page_id, sha, token)), *common, *page, *digest, ("WARC-Profile", PROFILE), *to, *http], REVISIT_HEAD)
        return
    name = record_name(page_id, sha) if alone and page_id == keeper.page_id else record_name(page_id, sha, token)
    block = HTTP_HEAD + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *page, *digest]
    if len(block) <= segment_bytes:
        yield record([*first, *http], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([*first, ("WARC-Segment-Number", "1"), *http], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_name(name, number)), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *total], part)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into archives under ``path``, gzipped by record.

    Payloads of fewer than ``min_bytes`` bytes are responses always.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "n": F.octet_length("payload")})
    copies = rows.groupBy("sha", "n", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    keeper = F.max(F.struct("page_id", "url", "copies"))
    groups = copies.groupBy("sha", "n").agg(keeper.alias("keeper"), F.sum("copies").alias("members"))
    joined = join_groups(rows, groups, ["sha", "n"], "members", pages.count())
    is_response = F.col("page_id").eqNullSafe(F.col("keeper.page_id")) | (F.col("n") < min_bytes)
    # a response with the largest page_id but another url is not the row that revisits name
    same = F.col("url").eqNullSafe(F.col("keeper.url"))
    copies = F.when(~is_response | same, F.col("keeper.copies")).otherwise(F.lit(0))
    ready = joined.select(
        "page_id", "url", "payload", F.col("keeper.page_id").alias("keeper_id"), F.col("keeper.url").alias("keeper_url"), copies.alias("copies"),
        is_response.alias("is_response"), F.monotonically_increasing_id().alias("row"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, body, keeper, keeper_url, copies, kept, row in zip(*batch.columns, strict=True):
                group = Keeper(keeper.as_py(), keeper_url.as_py(), copies.as_py())
                for made in page_records(page.as_py(), url.as_py(), body.as_py(), group, kept.as_py(), str(row), segment_bytes):
                    out.append(gzip.compress(made + CRLF + CRLF, 6, mtime=0))
                    held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = ready.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    ended = members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    ended.option("compression", "none").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields in lower case, block) of each record of an archive, gzipped as a whole or by record, or plain.

    The block of a record that is cut, or whose length is no number, is None; reading goes on at the next record."""
    stream = _inflate(bytes(content)) if bytes(content[:2]) == MAGIC[:2] else iter([bytes(content)])
    held = bytearray()
    damaged = False

    def more() -> bool:
        """Whether the record at hand goes on; not past a damaged member."""
        nonlocal damaged
        part = None if damaged else next(stream, None)
        damaged |= part == DAMAGED
        held.extend(part or b"")
        return part is not None and not damaged

    def skip(start: int) -> None:
        """Leave what comes before the next record."""
        while (at := held.find(b"\nWARC/", start)) < 0:
            del held[: max(0, len(held) - 6)]
            start = 0
            if not more():
                held.clear()
                return
        del held[: at + 1]

    while True:
        while held[:2] == CRLF:
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if more():
                continue
            if not damaged:
                return
            held.clear()  # a cut head tells nothing
            damaged = False
            continue
        if not held.startswith(b"WARC/"):
            skip(0)
            continue
        fields = {}
        for line in bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        size = _number(fields.get("content-length"))
        if size is None or size < 0:
            yield fields, None
            skip(end + 3)
            continue
        stop = end + 4 + size
        while len(held) < stop and more():
            pass
        if len(held) < stop:
            yield fields, None
            held.clear()
            if not damaged:
                return
            damaged = False
            continue
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        yield fields, block


MAGIC = b"\x1f\x8b\x08"
DAMAGED = b""


def _inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of all gzip members; DAMAGED after what could be read of one that is wrong or cut.

    A member is fed in pieces that grow, as what lies after its end is copied."""
    view, start = memoryview(content), 0
    while start < len(view):
        member, at, piece = zlib.decompressobj(31), start, 2048
        try:
            while at < len(view) and not member.eof:
                data = view[at : at + piece]
                at, piece = at + len(data), min(2 * piece, step)
                while len(data) and not member.eof:
                    if part := member.decompress(data, step):
                        yield part
                    data = member.unconsumed_tail
            fine = member.eof
        except zlib.error:
            fine = False
        if fine:
            start = at - len(member.unused_data)
            continue
        yield DAMAGED
        start = content.find(MAGIC, start + 1)
        if start < 0:
            return


def entity(block: bytes) -> bytes:
    """The payload of an HTTP response: its body, with any chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


PARSED = "origin string, segment int, total long, page_id long, record_type string, digest string, refers string, payload_bytes long, block binary, whole boolean"
PAGE = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string, segments int, complete boolean"


def _number(value: str | None) -> int | None:
    """A whole number of at most 18 digits; None for anything else."""
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PARSED.split(", ")])

    for batch in batches:
        for path, value in zip(*batch.columns, strict=True):
            rows, held = [], 0
            for place, (f, block) in enumerate(parse(value.as_buffer())):
                kind = f.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                origin = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                origin = origin or f"{path}#{place}"
                numbers = {k: _number(f.get(k)) for k in ("warc-segment-number", "warc-segment-total-length", "x-page-id")}
                whole = block is not None and all(n is not None for k, n in numbers.items() if k in f)
                segment = numbers["warc-segment-number"]
                segment = segment if segment is None or 0 < segment < 2**31 else 0
                digest, size, body = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
                if segment is not None or kind == "continuation":
                    body = block
                elif kind == "response" and whole:  # decoded here, so that no payload is shuffled
                    try:
                        payload = entity(block)
                        found = base32_sha1(payload)
                        whole = digest in (None, found)
                        size, digest = len(payload), found
                    except ValueError:
                        whole = False
                rows.append((origin, segment, numbers["warc-segment-total-length"], numbers["x-page-id"], kind, digest, f.get("warc-refers-to"), size, body, whole))
                held += len(body or b"") + 200
                if held > 4 << 20:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined(parts: list[dict]) -> tuple[int | None, str | None, bool]:
        """(payload bytes, digest, whether complete) of the segments of one origin."""
        block = b"".join(p["block"] or b"" for p in parts)
        in_order = [p["segment"] for p in parts] == list(range(1, len(parts) + 1))
        if in_order and parts[-1]["total"] == len(block) and all(p["whole"] for p in parts):
            try:
                payload = entity(block)
            except ValueError:
                return None, None, False
            found = base32_sha1(payload)
            if parts[0]["digest"] in (None, found):
                return len(payload), found, True
        return None, None, False

    for batch in batches:
        out = []
        for origin, parts in zip(*batch.columns, strict=True):
            parts = parts.as_py()
            alone = [p for p in parts if p["segment"] is None and p["record_type"] != "continuation"]
            for p in alone:
                good = p["whole"]
                out.append((origin.as_py(), p["page_id"], p["payload_bytes"] if good else None, p["digest"] if good else None, p["record_type"], p["refers"], 1, good))
            if pieces := [p for p in parts if p not in alone]:
                size, digest, complete = joined(pieces)
                out.append((origin.as_py(), next((p["page_id"] for p in pieces if p["record_type"] == "response"), None), size, digest, "response", None, len(pieces), complete))
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PAGE.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit record under ``path``: page_id, payload_bytes, payload_digest, record_type,
    refers_to, segments, complete.  The figures are of decoded payloads, a revisit's those of its response."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parsed = files.select("path", "content").mapInArrow(_parsed, PARSED)
    names = ["segment", "total", "page_id", "record_type", "digest", "refers", "payload_bytes", "block", "whole"]
    grouped = parsed.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("parts"))
    pages = settle(grouped.select("origin", "parts").mapInArrow(_assembled, PAGE), "warc-pages")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete"]
    responses = pages.where(F.col("record_type") == "response")
    revisits = pages.where(F.col("record_type") == "revisit").withColumn("name", F.coalesce("refers", F.concat(F.lit("sha1:"), "payload_digest"), "origin"))
    names = responses.where("complete").withColumn("name", F.explode(F.array("origin", F.concat(F.lit("sha1:"), "payload_digest"))))
    named = names.groupBy("name").agg(F.max(F.struct("page_id", "payload_bytes", "payload_digest")).alias("to"))
    asked = revisits.groupBy("name").agg(F.count(F.lit(1)).alias("revisits"))
    told = join_groups(revisits, asked.join(named, "name", "left"), ["name"], "revisits", pages.count())
    fine = F.col("complete") & F.col("to").isNotNull() & F.coalesce(F.col("payload_digest") == F.col("to.payload_digest"), F.lit(True))
    resolved = told.select(
        "page_id", F.when(fine, F.col("to.payload_bytes")).alias("payload_bytes"), F.when(fine, F.col("to.payload_digest")).alias("payload_digest"),
        "record_type", F.when(fine, F.col("to.page_id")).alias("refers_to"), "segments", fine.alias("complete"),
    )
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(resolved)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    tidy(pages.sparkSession)
    return read_archives(pages.sparkSession, path)
