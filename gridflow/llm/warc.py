"""WARC archives: writing, and reading back with segment reassembly.

Payloads are written as HTTP responses in chunked transfer framing. A block
longer than the segment size is cut: the first part is the ``response`` record
(segment 1), the rest are ``continuation`` records that name it as their
origin. Records are laid out round-robin over the lines of a task's output, so
a reader cannot count on segments standing together.

Reading parses records by their declared lengths, streaming through each
archive; groups the segments of a record by origin, orders them by number,
checks that none is missing and that the total length is as declared, decodes
the chunked framing and checks the payload digest. Only segmented records are
shuffled. Archives are written by Spark's own committed writer, so lost and
repeated tasks leave no partial file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.session import land, scratch_path

# Names and layout of the WARC format, version 1.1.
VERSION = b"WARC/1.1"
RECORD_END = b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT_BYTES = 16 << 10   # longest block of one record
CHUNK_BYTES = 4 << 10      # payload bytes per transfer chunk
FILE_RECORDS = 20_000      # records per archive

RECORDS = ("record_id string, type string, page_id string, uri string, refers_to string, digest string, "
           "segment int, origin string, total_bytes long, block binary, problem string")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are passed over.
    Raises ValueError for framing that breaks off or does not add up."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:end].split(b";", 1)[0], 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION] + [f"{k}: {v}".encode() for k, v in headers] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def _one_line(text: str) -> str:
    return " ".join(text.split())   # header values hold no line breaks


def page_records(page_id, uri: str, payload: bytes, refers_to, row: int, segment_bytes: int,
                 chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations.
    ``row`` makes record ids unique where page ids are not."""
    pid = "" if page_id is None else str(page_id)
    rid = f"<urn:page:{pid}:{row}>"
    named = [("WARC-Record-ID", rid), ("WARC-Target-URI", _one_line(uri or "")), ("WARC-Page-ID", pid),
             ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", SAME_PAYLOAD),
                       ("WARC-Refers-To", f"<urn:page:{refers_to}>"), *named], http)
        return
    block = http + chunked(payload, chunk_bytes)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        seg = [("WARC-Segment-Number", str(n))] if len(parts) > 1 else []
        if n == 1:
            yield _record([("WARC-Type", "response"), *named, *seg], part)
            continue
        if n == len(parts):
            seg.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{pid}:{row}:{n}>"),
                       ("WARC-Segment-Origin-ID", rid), *seg], part)


def revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``__refers_to``: the largest key of equal payloads of at
    least ``min_bytes``, null on the row(s) of that key itself.

    Payloads are compared by SHA-1 and length; groups of one are gone before
    the join, and hot groups are pre-aggregated to a row per task.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    d = pages.withColumns({"__sha": F.sha1(body), "__len": F.length(body)})
    same = (d.where(F.col("__len") >= min_bytes).groupBy(F.col("__sha").alias("s"), F.col("__len").alias("l"))
            .agg(F.max(key).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"))
    same = land(same, "warc-same")
    d = d.join(same, (d["__sha"] == same["s"]) & (d["__len"] == same["l"]), "left").drop("s", "l", "__sha", "__len")
    ref = F.when(F.col("top").isNotNull() & ~F.col(key).eqNullSafe(F.col("top")), F.col("top"))
    return d.withColumn("__refers_to", ref).drop("top")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                   min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write a record (or a response and its continuations) per row to gzip
    archives under ``path``. Null payloads are empty, null keys are allowed;
    rows that repeat a key and a payload are responses of their own."""
    d = revisits(pages.select(F.col(key).alias("k"), F.col(uri).alias("u"), F.col(payload).alias("p")), "k", "p",
                 min_revisit_bytes)
    d = d.select("k", "u", F.coalesce("p", F.lit("")).cast("binary").alias("p"), F.col("__refers_to").alias("r"),
                 F.monotonically_increasing_id().alias("row"))

    def records(batches):
        for b in batches:
            waves: list[list[bytes]] = []
            for k, u, p, r, row in zip(*(c.to_pylist() for c in b.columns)):
                for n, rec in enumerate(page_records(k, u, p, r, row, segment_bytes, chunk_bytes)):
                    while len(waves) <= n:
                        waves.append([])
                    waves[n].append(rec)
            # later segments first: reading must not depend on their order
            for wave in reversed(waves):
                for i in range(0, len(wave), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(wave[i:i + 500], pa.binary())], ["value"])
    # the text writer puts a string's bytes as they are and ends each record
    (d.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", RECORD_END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).mode("overwrite").text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives (``.gz``, whole-file or per-record members)
    under ``path``, columns ``RECORDS``; ``problem`` tells what is wrong with a
    record, its block is then what could be read."""
    # gzip archives are not split: a task streams through a whole archive, in
    # pieces that start where a record may start
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(
        F.input_file_name().alias("f"), F.col("value").cast("binary").alias("v"))

    def parse(batches):
        file, held, out = None, None, []
        for b in batches:
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f != file:
                    if held is not None:
                        out.append(_parsed(held, True))
                    file, held = f, None
                    if not v.strip():
                        continue   # before an archive's first record
                # a payload may hold the version text: the piece before was then cut short
                held = v if held is None else held + VERSION + v
                got = _parsed(held, False)
                if got is not None:
                    out.append(got)
                    held = None
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if held is not None:
            out.append(_parsed(held, True))
        if out:
            yield _batch(out)
    return raw.mapInArrow(parse, RECORDS)


def _parsed(raw: bytes, last: bool):
    """A row of ``RECORDS`` from a record's bytes after the version, or None if
    more may follow."""
    end = raw.find(b"\r\n\r\n")
    h = {}
    for line in raw[:max(end, 0)].split(b"\r\n"):
        k, _, v = line.partition(b":")
        h[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    size = h.get("content-length", "")
    if end < 0 or not size.isdigit():
        return ("", "unknown", None, None, None, None, None, None, None, raw, "no record header") if last else None
    block = raw[end + 4:end + 4 + int(size)]
    problem = None
    if len(block) < int(size):
        if not last:
            return None
        problem = "record shorter than declared"
    num = lambda k: int(h[k]) if h.get(k, "").isdigit() else None
    return (h.get("warc-record-id", ""), h.get("warc-type", "unknown"), h.get("warc-page-id"),
            h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"),
            num("warc-segment-number"), h.get("warc-segment-origin-id"), num("warc-segment-total-length"),
            block, problem)


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.string()), ("uri", pa.string()),
                    ("refers_to", pa.string()), ("digest", pa.string()), ("segment", pa.int32()),
                    ("origin", pa.string()), ("total_bytes", pa.int64()), ("block", pa.binary()),
                    ("problem", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: ``record_id, type, page_id, uri,
    refers_to, digest, block, problem``.

    The segments of a record are its first segment and the continuations that
    name it as origin, in order of number. A missing, repeated or
    unnumbered segment, a total length that differs, or continuations without
    a first segment are a ``problem``; the block is then null.
    """
    whole = records.where("segment is null and origin is null")
    seg = records.where("segment is not null or origin is not null")
    meta = ["record_id", "type", "page_id", "uri", "refers_to", "digest"]
    g = seg.groupBy(F.coalesce("origin", "record_id").alias("o")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_bytes").alias("total"), F.max("problem").alias("problem"),
        F.max(F.when(F.col("origin").isNull(), F.struct(*meta))).alias("m"))
    numbers = F.transform("parts", lambda x: x["segment"])
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + F.length(x["block"]))
    problem = (F.when(F.col("problem").isNotNull(), F.col("problem"))
               .when(F.col("m").isNull(), F.lit("first segment missing"))
               .when(~F.coalesce(numbers == F.sequence(F.lit(1), F.size("parts")), F.lit(False)),
                     F.lit("segments missing or repeated"))
               .when(~F.col("total").eqNullSafe(size), F.lit("total length differs")))
    joined = F.concat_ws("", F.transform("parts", lambda x: F.hex(x["block"])))
    orphan = {"record_id": F.col("o"), "type": F.lit("unknown")}   # a first segment was never read
    g = g.select("o", *[F.coalesce(F.col("m")[c], orphan.get(c, F.lit(None))).alias(c) for c in meta],
                 problem.alias("problem"), F.unhex(joined).alias("block"))
    return whole.select(*meta, "block", "problem").unionByName(
        g.select(*meta, F.when(F.col("problem").isNull(), F.col("block")).alias("block"), "problem"))


def decode(assembled: DataFrame, payloads: bool = True) -> DataFrame:
    """Payload, its length and digest of every reassembled record:
    ``page_id, type, uri, refers_to, payload, payload_bytes, payload_digest, problem``.
    Revisits have no payload here; their digest is the declared one.
    ``payloads=False`` leaves the payload bytes out."""
    cols = ["page_id", "type", "uri", "refers_to", "digest", "block", "problem"]

    def run(batches):
        for b in batches:
            rows = []
            for page, kind, uri, ref, digest, block, problem in zip(*(c.to_pylist() for c in b.columns)):
                payload, told = None, (digest or "").removeprefix("sha1:") or None
                if problem is None and kind == "response":
                    head, sep, body = block.partition(b"\r\n\r\n")
                    try:
                        if not sep:
                            raise ValueError("no end of HTTP header")
                        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    except ValueError as e:
                        problem = f"bad transfer framing: {e}"
                    else:
                        own = payload_digest(payload)
                        if told is not None and told != own:
                            problem = "payload digest differs"
                        told = own
                size = None if payload is None else len(payload)
                rows.append((page or None, kind, uri, ref, payload if payloads else None, size, told, problem))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(),
                        pa.string()))],
                    ["page_id", "type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest", "problem"])
    return assembled.select(*cols).mapInArrow(
        run, "page_id string, type string, uri string, refers_to string, payload binary, payload_bytes long, "
             "payload_digest string, problem string")


def read_payloads(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``decode`` of all records under ``path``; a revisit gets the length of
    the response it refers to (null and a problem if there is none)."""
    d = land(decode(reassemble(read_records(spark, path)), payloads), "warc-decoded")
    refd = F.regexp_extract("refers_to", r"^<urn:page:(.*)>$", 1)
    responses = d.where("type = 'response'").groupBy(
        F.col("page_id").alias("rp"), F.col("payload_digest").alias("rd")).agg(F.max("payload_bytes").alias("rb"))
    again = d.where("type = 'revisit'").withColumn("target", refd)
    again = again.join(responses, (F.col("target") == F.col("rp")) & (F.col("payload_digest") == F.col("rd")), "left")
    again = again.select("page_id", "type", "uri", F.col("target").alias("refers_to"), "payload",
                         F.col("rb").alias("payload_bytes"), "payload_digest",
                         F.when(F.col("rb").isNull(), F.lit("revisited response not found")).otherwise(
                             F.col("problem")).alias("problem"))
    return d.where("type <> 'revisit'").unionByName(again)


def archive_round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html",
                       path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives (to the shared folder by default) and read
    them back: ``read_payloads`` without the bytes. An empty table gives an
    empty result."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, key, uri, payload, **options)
    return read_payloads(pages.sparkSession, path, payloads=False)
