"""WARC writing and reassembly: exact round trips, and archives that are cut or out of order."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest

from sylvatica.llm import warc as W


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, min_bytes=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for body, pages in groups.items():
        keeper = max((p for p in pages if p is not None), default=None)
        for page in pages:
            response = page == keeper or len(body) < min_bytes
            out.append((page, len(body), digest(body), "response" if response else "revisit", None if response else keeper))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r.complete for r in rows)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


LONG = "".join(random.Random(2).choices("abcé\r\n <>0123", k=300_000)) + "WARC/1.0\r\n\r\n0\r\n\r\n"
ROWS = [(1, "http://a/é x\r\nX: y", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "u", None), (4, "u", ""), (5, "u", LONG), (6, "u", LONG), (7, "u", "\r\n\r\n"), (8, "u", "WARC/1.0\r\n"), (8, "u", "WARC/1.0\r\n"), (None, "u", "<p>hi</p>"), (None, "u", "only")]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*r, b"x", 5) for r in ROWS], "page_id long, url string, html string, payload binary, n int").repartition(4)
    assert found(W.round_trip(pages, min_bytes)) == expected(ROWS, min_bytes)


def test_many_copies(spark):
    rng = random.Random(9)
    rows = [(i, f"u{i}", rng.choice(["hot", "hot", f"<p>{rng.randrange(90)}</p>"])) for i in range(1500)]
    assert found(W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(11))) == expected(rows)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("payload", [b"", b"x", b"y" * 8192, bytes(range(256)) * 300])
def test_chunks(payload):
    assert W.dechunked(W.chunked(payload)) == payload
    assert W.dechunked(W.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        W.dechunked(W.chunked(payload)[:-5])


def test_chunk_extensions_and_trailers():
    assert W.dechunked(b"3;name=v\r\nabc\r\nA\r\n0123456789\r\n0\r\nX-Trailer: y\r\n\r\n") == b"abc0123456789"


K5 = W.Keeper(5, "u", 1)


def archive(records):
    return b"".join(r + b"\r\n\r\n" for r in records)


@pytest.mark.parametrize("pack", [lambda r: archive(r), lambda r: gzip.compress(archive(r)), lambda r: b"".join(gzip.compress(x + b"\r\n\r\n") for x in r)])
def test_parse_plain_and_gzipped_archives(pack):
    records = list(W.page_records(5, "u", LONG.encode(), K5, True, "t", 1000)) + list(W.page_records(6, "u", b"z", K5, False, "t"))
    parsed = list(W.parse(pack(records)))
    assert len(parsed) == len(records) > 300
    assert b"".join(b for f, b in parsed[:-1]) == W.HTTP_HEAD + W.chunked(LONG.encode())
    assert parsed[-1][0]["warc-type"] == "revisit" and parsed[-1][0]["warc-refers-to-target-uri"] == "u"


@pytest.mark.parametrize(("change", "complete"), [
    (lambda r: r, True), (lambda r: r[::-1], True), (lambda r: r[:1] + r[2:], False), (lambda r: r[:-1], False), (lambda r: [*r, r[1]], False),
    (lambda r: [r[0], r[1].replace(b"\r\n\r\n", b"\r\n\r\n", 1)[:-1] + b"?", *r[2:]], False), (lambda r: r[1:], False),
])
def test_reassembly(spark, tmp_path, change, complete):
    """Segments out of order are put right; missing, repeated or altered ones are told."""
    body = LONG.encode()[:5000]
    records = list(W.page_records(5, "u", body, K5, True, "t", 900))
    for i, r in enumerate(change(records)):  # a file per record, so that segments lie in many files
        (tmp_path / f"{i:03}.gz").write_bytes(gzip.compress(r + b"\r\n\r\n"))
    rows = W.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].complete is complete
    assert (rows[0].payload_bytes, rows[0].payload_digest) == ((len(body), digest(body)) if complete else (None, None))


def page(number, body=b"some text", keeper=None, response=True):
    return next(iter(W.page_records(number, f"u{number}", body, keeper or W.Keeper(number, f"u{number}", 1), response, "t")))


BAD = {
    "length_is_no_number": lambda r: r.replace(b"Content-Length: ", b"Content-Length: abc"),
    "length_is_missing": lambda r: r.replace(b"Content-Length: ", b"X-Other: "),
    "length_is_negative": lambda r: r.replace(b"Content-Length: ", b"Content-Length: -"),
    "page_is_no_number": lambda r: r.replace(b"X-Page-Id: ", b"X-Page-Id: p"),
    "segment_is_no_number": lambda r: r.replace(b"WARC-Date", b"WARC-Segment-Number: one\r\nWARC-Date"),
    "chunk_is_wrong": lambda r: r.replace(b"9\r\nsome", b"z\r\nsome"),
    "text_is_altered": lambda r: r.replace(b"some text", b"same text"),
}


@pytest.mark.parametrize("name", BAD)
@pytest.mark.parametrize("pack", [archive, lambda r: gzip.compress(archive(r)), lambda r: b"".join(gzip.compress(x + b"\r\n\r\n") for x in r)])
def test_one_bad_record_costs_no_other(spark, tmp_path, name, pack):
    records = [page(1, b"one"), BAD[name](page(2)), page(3, b"three"), page(4, b"three", W.Keeper(3, "u3", 1), False)]
    (tmp_path / "a.warc").write_bytes(pack(records))
    rows = sorted(W.read_archives(spark, str(tmp_path)).collect(), key=lambda r: str(r.payload_bytes))
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.complete] == [(1, 3, "response", None), (3, 5, "response", None), (4, 5, "revisit", 3)]
    assert [(r.payload_bytes, r.payload_digest) for r in rows if not r.complete] == [(None, None)]


def test_damaged_members_and_cut_files(spark, tmp_path):
    members = [gzip.compress(page(i, b"%d" % i * 50) + b"\r\n\r\n") for i in range(1, 6)]
    members[1] = members[1][:-30] + b"?" * 22 + members[1][-8:]
    (tmp_path / "a").write_bytes(b"".join(members)[:-9])  # and the last is cut
    (tmp_path / "b").write_bytes(b"junk\r\n\r\nmore junk\r\n\r\n" + page(9, b"nine") + b"\r\n\r\n" + page(10)[:-4])
    rows = W.read_archives(spark, str(tmp_path)).collect()
    assert {r.page_id for r in rows if r.complete} >= {1, 3, 4, 9}
    assert {r.page_id for r in rows if r.complete} <= {1, 3, 4, 5, 9}
    assert all(r.payload_bytes is None for r in rows if not r.complete)
    assert any(r.page_id == 10 and not r.complete for r in rows)


def test_a_revisit_has_its_responses_figures(spark, tmp_path):
    records = [page(1, b"one", W.Keeper(7, "u7", 1), False), page(7, b"one"), page(2, b"gone", W.Keeper(8, "u8", 1), False), page(3, b"one", W.Keeper(7, "u7", 2), False)]
    records += [r.replace(b"WARC-Record-ID", b"X-None") for r in (page(11, b"eleven"), page(12, b"twelve"))]
    (tmp_path / "a").write_bytes(archive(records))
    rows = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.complete) for r in W.read_archives(spark, str(tmp_path)).collect()}
    assert rows == {1: (3, "revisit", 7, True), 7: (3, "response", None, True), 2: (None, "revisit", None, False), 3: (3, "revisit", 7, True), 11: (6, "response", None, True), 12: (6, "response", None, True)}


def test_written_files_are_gzipped_by_record(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(i, "u", f"text {i}") for i in range(30)], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    data = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert len(list(W.parse(data))) == 30 and len(list(W.parse(gzip.decompress(data)))) == 30
    assert data.count(W.MAGIC) >= 60  # each record and what ends it
