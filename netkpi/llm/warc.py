"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing: payloads of at least ``min_bytes`` that several pages share are stored once, in the
response of the page with the largest id; the others become revisits that refer to it. Each task
writes its pages as gzipped WARC/1.1 records and starts a new file after ``file_bytes``. The body
is sent in chunks (HTTP transfer framing). A record whose block is longer than ``segment_bytes``
is cut: the first segment is the response, the rest are continuation records, which may come to
lie in later files; the last one has the total length.

Reading: files are streamed record by record. Whole records are decoded where they are read;
segments are grouped by their origin and ordered by number over a shuffle, their numbers and
their total length are verified, and the chunked framing is decoded. Digests of blocks and
payloads are verified too. What fails ends the job or, if not ``strict``, has a ``problem`` and no
payload.

A task holds one record, or the segments of one record. The digest that many pages share costs
one row per task when the keepers are found, and their join with the pages can be split.

Defined cases: a null html is an empty payload. Rows that repeat the id of the response are
responses themselves. A page without id revisits the response of its payload, or is a response if
no page with that payload has an id. An empty table makes no files and gives no rows. Only the
columns named are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netkpi.llm.common import workers_import, written
from netkpi.llm.files import file_paths, make_folders, new_file, open_stream

CRLF = b"\r\n"
#: Date of all records: the table has none.
DATE = "2000-01-01T00:00:00Z"
#: Bytes of a chunk of the body.
CHUNK = 8192


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def chunked(body: bytes) -> bytes:
    parts = []
    for start in range(0, len(body), CHUNK):
        data = body[start : start + CHUNK]
        parts += [b"%x" % len(data), CRLF, data, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunked(data: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        start = end + 2
        if data[start + size : start + size + 2] != CRLF:
            raise ValueError("a chunk has another length than it says")
        parts.append(data[start : start + size])
        at = start + size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + CRLF + CRLF, compresslevel=1, mtime=0)


def page_records(
    page_id: int | None, url: str | None, payload: bytes, keeper: int | None, place: str, segment_bytes: int
) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations. ``place`` is unique."""
    digest = digest_of(payload)
    origin = f"<{page_urn(page_id)}:{place}>"
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if keeper is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record(
            [
                ("WARC-Type", "revisit"),
                ("WARC-Record-ID", origin),
                *common,
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", f"<{page_urn(keeper)}>"),
                ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
                ("Content-Type", "application/http; msgtype=response"),
            ],
            block,
        )
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, start=1):
        own = [("WARC-Block-Digest", f"sha1:{digest_of(part)}")]
        if number == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common]
            own.append(("Content-Type", "application/http; msgtype=response"))
        else:
            head = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"{origin[:-1]}:{number}>"),
                *common[:2],
                ("WARC-Segment-Origin-ID", origin),
            ]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", str(number)))
        if 1 < number == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(head + own, part)


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    segment_bytes: int = 16_384,
    file_bytes: int = 32 << 20,
) -> None:
    """WARC files of all pages (``page_id``, ``url``, ``html``) under ``folder``."""
    spark = pages.sparkSession
    workers_import(spark)
    make_folders(spark, folder)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"))
    shared = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "keeper")
    )
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    found = rows.join(shared, "digest", "left").select("page_id", "url", "html", keeper.alias("keeper"))

    def write(batches: Iterator) -> Iterator:
        import contextlib

        import pyarrow as pa
        from pyspark import TaskContext

        task, number, size, nth = TaskContext.get().partitionId(), 0, 0, 0
        with contextlib.ExitStack() as stack:
            out = None
            for batch in batches:
                for page_id, url, text, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for data in page_records(page_id, url, text.encode(), kept, f"{task}.{nth}", segment_bytes):
                        if out is None or size >= file_bytes:
                            stack.close()  # completes the file before
                            out, size = stack.enter_context(new_file(f"{folder}/part-{task:06d}-{number:04d}.warc.gz")), 0
                            number += 1
                        out.write(data)
                        size += len(data)
                    nth += 1
        yield pa.RecordBatch.from_arrays([pa.array([nth], pa.int64())], names=["n"])

    written(found.mapInArrow(write, "n long"), f"{folder}/written")


# --- reading ------------------------------------------------------------------


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped file."""
    buffer, engine, data = b"", zlib.decompressobj(31), []
    while True:
        if not buffer:
            buffer = stream.read(1 << 20)
            if not buffer:
                if data:
                    raise ValueError("the file ends inside a record")
                return
        data.append(engine.decompress(buffer))
        buffer = engine.unused_data
        if engine.eof:  # one record per gzip member
            yield parsed(b"".join(data))
            engine, data = zlib.decompressobj(31), []


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF + CRLF)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != CRLF + CRLF:
        raise ValueError("a record has another length than it says")
    return headers, rest[:length]


def _body(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _page_of(urn: str | None) -> int | None:
    number = urn.strip("<>").split(":")[2] if urn else ""
    return int(number) if number else None


_READ = (
    "origin string, segment int, total long, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, problem string, data binary"
)


def _decoded(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    """Payload length, digest, problem and, if asked for, payload of a whole response."""
    try:
        payload = _body(block)[1]
    except ValueError as e:
        return None, None, f"bad framing: {e}", None
    digest = digest_of(payload)
    if f"sha1:{digest}" != headers.get("warc-payload-digest"):
        return None, None, "payload digest differs", None
    return len(payload), digest, None, payload if keep else None


def _row(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind, record_id = headers["warc-type"], headers["warc-record-id"]
    segment = headers.get("warc-segment-number")
    origin = headers.get("warc-segment-origin-id", record_id)
    page = _page_of(origin)
    right = headers.get("warc-block-digest", "") in ("", f"sha1:{digest_of(block)}")
    if not right:
        return origin, None, None, page, kind, None, None, None, "block digest differs", None
    if segment:
        total = headers.get("warc-segment-total-length")
        expected = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        return origin, int(segment), int(total) if total else None, page, kind, None, None, expected, None, block
    if kind == "revisit":
        http, _ = _body(block)
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        return origin, None, None, page, kind, _page_of(headers["warc-refers-to"]), int(http["content-length"]), digest, None, None
    size, digest, problem, payload = _decoded(headers, block, keep)
    return origin, None, None, page, kind, None, size, digest, problem, payload


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """One row per page: ``page_id``, ``record_type``, ``refers_to``, ``payload_bytes``,
    ``payload_digest``, ``problem`` and ``data`` (the payload of responses, if asked for)."""
    workers_import(spark)

    def checked(row: tuple) -> tuple:
        if strict and row[8]:
            raise ValueError(f"{row[0]}: {row[8]}")
        return row

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = _arrow_schema(pa)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_stream(path) as stream:
                    for headers, block in records_in(stream):
                        rows.append(checked(_row(headers, block, with_payload)))
                        size += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or size > 4 << 20:
                            yield _batch(pa, schema, rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(pa, schema, rows)

    def join(batches: Iterator) -> Iterator:
        """Rows come ordered by origin and segment number."""
        import pyarrow as pa

        schema = _arrow_schema(pa)
        held: list[tuple] = []
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[1] is None or row[0] != held[0][0]):
                    rows.append(checked(_joined(held, with_payload)))
                    held = []
                if row[1] is None:
                    rows.append(row)
                else:
                    held.append(row)
            yield _batch(pa, schema, rows)
        if held:
            yield _batch(pa, schema, [checked(_joined(held, with_payload))])

    files = file_paths(spark, folder, "*.warc.gz").select("path")
    n = max(1, min(files.count(), 10_000))
    rows = files.repartition(n).mapInArrow(read, _READ)
    by_origin = rows.repartition("origin").sortWithinPartitions("origin", "segment")
    return by_origin.mapInArrow(join, _READ).drop("origin", "segment", "total")


def _joined(held: list[tuple], keep: bool) -> tuple:
    """The row of a record from its segments, in order."""
    origin, _, _, page, kind, *_ = held[0]
    total = held[-1][2]
    block = b"".join(x[9] for x in held)
    problem = None
    if [x[1] for x in held] != list(range(1, len(held) + 1)):
        problem = "segments are missing or repeated"
    elif total is None or len(held) < 2:
        problem = "the last segment is missing"
    elif total != len(block):
        problem = "total length differs"
    size = digest = payload = None
    if problem is None:
        headers = {"warc-payload-digest": f"sha1:{held[0][7]}"}
        size, digest, problem, payload = _decoded(headers, block, keep)
    return origin, None, None, page, kind, None, size, digest, problem, payload


def _arrow_schema(pa):
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))])


def _batch(pa, schema, rows: list[tuple]):
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
