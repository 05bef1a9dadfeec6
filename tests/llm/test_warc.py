from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from netkpi.llm.common import scratch
from netkpi.llm.warc import chunked, page_records, parsed, read_archives, unchunked, write_archives

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    big = "<p>ä big page</p>" * 5000
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", "same"), (3, "u3", "same"), (4, None, None), (5, "a b\r\nc", "")]
    rows += [(6, "u6", big), (7, "u7", big + "!"), (None, "n", "same"), (None, "n", "alone"), (8, "u8", "x" * 16384)]
    return spark.createDataFrame([(*r, "d") for r in rows], SCHEMA).repartition(3), rows


def expected(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        keeper = max(ids) if ids and len(data) >= min_bytes else i
        revisit = i != keeper
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, "revisit" if revisit else "response", keeper if revisit else None, len(data), digest, data))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("segment", "file", "least"), [(16_384, 32 << 20, 0), (100, 2000, 0), (50_000, 1, 5)])
def test_round_trip(spark, segment, file, least):
    df, rows = pages(spark)
    folder = scratch(spark)
    write_archives(df, folder, least, segment, file)
    found = read_archives(spark, folder, with_payload=True).collect()
    assert all(r.problem is None for r in found)
    want = expected(rows, least)
    assert ordered((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found) == ordered(w[:5] for w in want)
    payloads = {r.payload_digest: bytes(r.data) for r in found if r.record_type == "response"}
    assert payloads == {w[4]: w[5] for w in want if w[1] == "response"}


def test_empty_table(spark):
    folder = scratch(spark)
    write_archives(pages(spark)[0].limit(0), folder)
    assert read_archives(spark, folder).collect() == []


def test_framing():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        assert unchunked(chunked(os.urandom(n)[:n])) is not None
        body = os.urandom(n)
        assert unchunked(chunked(body)) == body
    assert unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"4\r\nabc\r\n0\r\n\r\n")


def records(payload: bytes, segment: int):
    return list(page_records(9, "u", payload, None, "0.0", segment))


@pytest.mark.parametrize("harm", ["missing", "repeated", "last", "changed"])
def test_damage_is_found(spark, harm):
    parts = records(b"payload " * 500, 700)
    assert len(parts) > 4
    if harm == "missing":
        del parts[2]
    elif harm == "repeated":
        parts.append(parts[2])
    elif harm == "last":
        del parts[-1]
    else:
        parts[1] = gzip.compress(gzip.decompress(parts[1]).replace(b"load pay", b"load pax", 1))
    folder = scratch(spark)
    path = folder.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-000000-0000.warc.gz", "wb") as out:
        out.write(b"".join(parts))
    found = read_archives(spark, folder, strict=False).collect()
    assert any(r.problem for r in found) and all(r.payload_bytes is None for r in found)
    with pytest.raises(Exception, match="urn:x-page:9"):
        read_archives(spark, folder).collect()


def test_records_are_warc():
    headers, block = parsed(gzip.decompress(records(b"abc", 10_000)[0]))
    assert headers["warc-type"] == "response" and headers["content-length"] == str(len(block))
    numbers = [parsed(gzip.decompress(r))[0].get("warc-segment-number") for r in records(b"abc" * 200, 300)]
    assert numbers == [str(i + 1) for i in range(len(numbers))] and len(numbers) > 2
