"""WARC archives: writing pages as records, reading them back, segment reassembly.

Archives are written by Spark's text sink with the record terminator as line
separator, and read with the binary file source, so any store that Spark
reaches will do.  A block larger than a segment becomes a response record with
segment number 1 and continuation records; they meet again by their origin's
identifier, in segment order, and count only if the numbers have no gap and the
lengths add up to the total the last segment states.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import scratch_path, stash

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
#: Bounds an archive to this many records of a segment each.
ARCHIVE_RECORDS = 4096
#: Shorter payloads are never revisits.
REVISIT_BYTES = 100
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_FLUSH = 8 << 20


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Transfer framing: hexadecimal length, data, and a last chunk of length 0."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Takes the framing off; chunk extensions and trailers are skipped, bad framing raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk length missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields (names lower-cased) and decoded payload of an HTTP response."""
    head, split, body = block.partition(b"\r\n\r\n")
    if not split:
        raise ValueError("no end of header")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return fields, dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record; the block's length is its Content-Length, whatever it holds."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("record has no version line")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields[b"content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record cut short")
        yield fields, block


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(row: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in one or more segments."""
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    name = f"urn:page:{page}"
    base = [("WARC-Target-URI", uri), ("WARC-Date", _DATE), ("X-Row", row), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}")]
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        block = start + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *base, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>"), kind], block)
        return
    block = start + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *base, kind]
    yield _record(first + ([("WARC-Segment-Number", 1)] if len(pieces) > 1 else []), pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        total = len(block) if k == len(pieces) else None
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), *base, ("WARC-Segment-Origin-ID", f"<{name}>"),
             ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], piece)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Writes (page_id, url, html) as gzipped archives under path.

    Of pages with equal payloads of at least REVISIT_BYTES, those with the
    smallest page_id are responses and the others revisit it; null ids revisit
    any other and are responses among themselves.  Null html is an empty
    payload, null url leaves out the target.
    """
    given = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    groups = given.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stash(groups.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("key"), "first"), "payload-groups")
    # small payloads never match; their keys differ so that they spread
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = given.join(groups, key == F.col("key"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns)):
                n += 1
                for record in page_records(f"{part}-{n}", *row, segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)


_PARTS = (
    "row string, page_id long, url string, record_type string, refers_to long, stated string, payload_bytes long, payload_digest string,"
    " payload binary, origin string, segment int, total long, block binary"
)
_PARTS_ARROW = pa.schema([
    ("row", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("origin", pa.string()), ("segment", pa.int32()),
    ("total", pa.int64()), ("block", pa.binary()),
])


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").split(":")[2:3]
    return int(number[0]) if number and number[0] != "None" else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, intact; one row per page.

    Responses are decoded and digested anew; revisits give the length and
    digest they state and a null payload, as does anything when with_payload is
    false.  intact is false, and length and digest null, where segments miss,
    overlap or don't add up, framing is bad, or the digest isn't the stated one.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))
                for fields, block in parse_records(stream):
                    text = {k.decode(): v.decode("utf-8", "replace") for k, v in fields.items()}
                    segment = int(text["warc-segment-number"]) if "warc-segment-number" in text else None
                    row = {
                        "row": text.get("x-row"), "page_id": int(text["x-page-id"]) if "x-page-id" in text else None, "url": text.get("warc-target-uri"),
                        "record_type": text["warc-type"], "refers_to": _page_of(text.get("warc-refers-to")),
                        "stated": text.get("warc-payload-digest", "").removeprefix("sha256:"),
                    }
                    if segment is not None:
                        origin = text.get("warc-segment-origin-id") or text["warc-record-id"]
                        total = text.get("warc-segment-total-length")
                        row |= {"origin": origin, "segment": segment, "total": None if total is None else int(total), "block": block}
                    elif row["record_type"] == "revisit":
                        row |= {"payload_bytes": int(http_payload(block)[0][b"content-length"]), "payload_digest": row["stated"]}
                    else:
                        row |= _decoded(block, with_payload)
                    rows.append(row)
                    size += len(block)
                    if size > _FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARTS_ARROW)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_digest", "payload"]
        for b in batches:
            got = []
            for pieces in b.column(b.schema.get_field_index("pieces")):
                block = reassemble([(p["segment"].as_py(), p["total"].as_py(), p["block"].as_py()) for p in pieces])
                got.append(_decoded(block, with_payload))
            kept = [k for k, c in enumerate(b.schema.names) if c != "pieces"]
            new = [pa.array([g.get(c) for g in got], t) for c, t in zip(names, (pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *new], [*(b.schema.names[k] for k in kept), *names])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = stash(archives.mapInArrow(parse, _PARTS), "warc-parts")
    cols = ["page_id", "url", "record_type", "refers_to", "stated", "payload_bytes", "payload_digest", "payload"]
    whole = parts.where("segment IS NULL").select(*cols)
    # a group is the segments of one page, which was one value of the table before
    pieces = F.array_sort(F.collect_list(F.struct("segment", "total", "block")))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.where("segment IS NOT NULL").groupBy("origin", "row").agg(
        F.max("page_id").alias("page_id"), first("url"), F.lit("response").alias("record_type"), F.max("stated").alias("stated"), pieces.alias("pieces")
    )
    joined = grouped.mapInArrow(
        join_up, "origin string, row string, page_id long, url string, record_type string, stated string, payload_bytes long, payload_digest string, payload binary"
    ).withColumn("refers_to", F.lit(None).cast("long"))
    intact = F.coalesce(F.col("payload_digest") == F.col("stated"), F.lit(False))
    return (
        whole.unionByName(joined.select(*cols)).withColumn("intact", intact)
        .withColumn("payload_bytes", F.when(intact, F.col("payload_bytes"))).withColumn("payload_digest", F.when(intact, F.col("payload_digest")))
        .drop("stated")
    )


def reassemble(pieces: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of segments (number, stated total, data), or None: numbers must run from 1 and the lengths must add up."""
    pieces = sorted(pieces, key=lambda p: p[0])
    block = b"".join(p[2] for p in pieces)
    if [p[0] for p in pieces] != list(range(1, len(pieces) + 1)) or pieces[-1][1] != len(block):
        return None
    return block


def _decoded(block: bytes | None, with_payload: bool) -> dict:
    try:
        payload = http_payload(block)[1] if block is not None else None
    except ValueError:
        payload = None
    if payload is None:
        return {}
    return {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if with_payload else None}


def round_trip(pages: DataFrame, with_payload: bool = False, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back; see write_archives and read_archives."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes)
    return read_archives(pages.sparkSession, path, with_payload)
