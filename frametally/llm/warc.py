"""WARC archives: writing pages as records, and reassembling what was read.

Writing.  Each page is one record with an HTTP response in chunked transfer
framing; a page whose payload digest another page with a smaller id has is a
revisit record without payload.  A record's block longer than ``SEGMENT`` bytes
is split: the first record has segment number 1, the others are continuation
records that name it as their origin, the last with the total length.  Spark's
text writer writes the files: a record is a line, and the two line ends after a
record are the line separator, so files go to any store Spark can write.

Reading.  Archives are read as files of bounded size and parsed by their
Content-Length headers only.  Continuations are grouped with their origin by its
identifier, put in order by segment number, checked for gaps and against the
total length, and joined; the chunked framing is then decoded and the payload's
digest compared with the header.

Defined results: null html is an empty payload; a null url is an empty target
address; records are told apart by page id and payload, so repeated rows and
rows without an id are written as often as they occur (an id that is null
never is what others revisit); payloads below ``least`` bytes are always
responses; a damaged record (a header that is no number, a length that isn't the
block's, missing segments, a wrong digest) has ``valid`` false and a reason, and
the read goes on with the next record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.llm.shared import shared_dir, stored

SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Records in one file: with SEGMENT this bounds a file's size.
RECORDS = 400
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest(html: Column) -> Column:
    """The bare upper-case base32 SHA-1 of the UTF-8 bytes."""

    @F.arrow_udf("string")
    def sha1(texts: pa.Array) -> pa.Array:
        raw = texts.fill_null("").cast(pa.binary())
        return pa.array([base64.b32encode(hashlib.sha1(x.as_buffer()).digest()).decode() for x in raw])

    return sha1(html)


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(f"{len(p):x}".encode() + CRLF + p + CRLF for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != CRLF or size < 0:
            raise ValueError("chunk cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def page_records(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, copy: int | None = None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the two line ends that close each.

    ``copy`` tells apart pages of one id and payload: segments meet under their record's name.
    """
    name = f"<urn:page:{'none' if page_id is None else page_id}:{sha1}{'' if copy is None else f':{copy}'}>"
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common]
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}:{sha1}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_headers([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head))]) + head]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for i, part in enumerate(parts):
        if i == 0:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response")]
            if len(parts) > 1:
                fields.append(("WARC-Segment-Number", 1))
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", name[:-1] + f"/{i + 1}>"), ("WARC-Target-URI", url), ("WARC-Date", DATE)]
            fields += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i + 1)]
            if i == len(parts) - 1:
                fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_headers([*fields, ("Content-Length", len(part))]) + part)
    return out


def _written(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Records of (page_id, url, html, digest, first, copies); at most some MB at a time.

    Rows that may occur repeatedly are numbered by task and place in it.
    """
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        raw = batch.column(2).fill_null("").cast(pa.binary())
        out, held = [], 0
        for i, (p, url, sha1, first, copies) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4, 5)))):
            refers = first if first is not None and first != p else None
            own = page_records(p, url or "", raw[i].as_buffer().to_pybytes(), sha1, refers, number if p is None or copies > 1 else None, segment)
            number += 1
            out += own
            held += sum(map(len, own))
            if held > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])


def originals(pages: DataFrame) -> DataFrame:
    """(digest, first, copies): of payloads that several rows have, the smallest page id and how many rows have both."""
    each = pages.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("copies"))
    by_digest = each.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "copies"))).alias("f"), F.sum("copies").alias("n"))
    return by_digest.where("n > 1 and f is not null").select("digest", F.col("f.page_id").alias("first"), "f.copies")


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) as WARC files under path."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", digest(F.col("html")))
    joined = known.join(stored(originals(known), "originals"), "digest", "left")
    refers = F.when(F.coalesce(F.octet_length("html"), F.lit(0)) >= least, F.col("first"))
    # rows of the smallest id come once unless counted otherwise; of other ids all but small ones are revisits, of one record each
    copies = F.when((F.col("page_id") == F.col("first")) | F.col("first").isNull(), F.coalesce("copies", F.lit(1))).otherwise(2)
    joined = joined.select("page_id", "url", "html", "digest", refers.alias("first"), copies.alias("copies"))
    records = joined.mapInArrow(partial(_written, segment=segment), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_START = re.compile(rb"(?:\A|\r\n)(WARC/\d)")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, flaw) of each record of an archive.

    After a record whose length is missing, no number or not that of its block,
    and after what is no record, reading goes on where the next one begins.
    """
    at = 0
    while m := _START.search(content, max(0, at - 2)):
        at = m.start(1)
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, b"", "header cut short"
            return
        fields = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in _FIELD.findall(content[content.find(CRLF, at) + 2 : end + 2])}
        size, begin = _count(fields.get("content-length")), end + 4
        stop = begin + (size or 0)
        if size is not None and stop <= len(content) and content[stop : stop + 4] in (b"\r\n\r\n", b"\r\n", b""):
            yield fields, content[begin:stop], None
            at = stop
            continue
        after = _START.search(content, begin)
        at = after.start() if after else len(content)
        yield fields, content[begin:at].removesuffix(b"\r\n"), "content length is no number" if size is None else "content length differs"


def _count(text: str | None, most: int = (1 << 63) - 1) -> int | None:
    """A header's number; None where it is none, is negative or too large."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 20 and int(text) <= most else None


_RECORD = "origin string, number int, total long, kind string, url string, digest string, length long, refers_to string, block binary, flaw string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for f, block, flaw in parse(content.as_buffer().to_pybytes()):
                kind = f.get("warc-type", "")
                if kind not in ("response", "revisit", "continuation") and not (flaw and not kind):
                    continue
                number, total, length = _count(f.get("warc-segment-number", "0"), (1 << 31) - 1), _count(f.get("warc-segment-total-length")), _count(f.get("x-payload-length"))
                for name, value in (("warc-segment-number", number), ("warc-segment-total-length", total), ("x-payload-length", length)):
                    if name in f and value is None:
                        flaw = flaw or f"{name} is no number"
                origin = f.get("warc-segment-origin-id", f.get("warc-record-id"))
                rows.append((origin, number or 0, total, kind, f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"), length, f.get("warc-refers-to"), block, flaw))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def payload(blocks: Column, digest_: Column, kind: Column) -> Column:
    """struct(payload binary, sha1, reason) of an HTTP block in parts; reason is null where all is well."""
    out = pa.struct([("payload", pa.binary()), ("sha1", pa.string()), ("reason", pa.string())])

    @F.arrow_udf("struct<payload:binary,sha1:string,reason:string>")
    def decoded(wholes: pa.Array, digests: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = []
        for b, d, k in zip(wholes, digests.to_pylist(), kinds.to_pylist()):
            raw = b"".join(x.as_buffer() for x in b.values if x.is_valid) if b.is_valid else b""
            head, _, body = raw.partition(b"\r\n\r\n")
            if k == "revisit":
                rows.append((None, d, None))
                continue
            try:
                if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
                    body = unchunked(body)
                sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
                rows.append((body, sha1, None if sha1 == d else "digest differs"))
            except ValueError as e:
                rows.append((None, None, str(e)))
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 3, out)], fields=list(out))

    return decoded(blocks, digest_, kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, url, digest, length, refers_to, segments, payload, sha1, valid, reason): one row for each response or revisit under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(_read, _RECORD)
    # segments meet under their origin; whole records have nothing to wait for
    whole = records.where("number = 0").select(
        F.col("origin").alias("record_id"), "kind", "url", "digest", "length", "refers_to", F.lit(1).alias("segments"), F.array("block").alias("blocks"),
        F.coalesce("flaw", F.when(F.col("kind") == "continuation", "segment number missing")).alias("gap"),
    )
    parts = (
        records.where("number > 0")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
            F.max("total").alias("total"),
            F.max("flaw").alias("flaw"),
            *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "url", "digest", "length", "refers_to")],
        )
        .select(
            F.col("origin").alias("record_id"),
            "kind",
            "url",
            "digest",
            "length",
            "refers_to",
            F.size("parts").alias("segments"),
            F.expr("transform(parts, x -> x.block)").alias("blocks"),
            F.when(F.col("flaw").isNotNull(), F.col("flaw"))
            .when(F.expr("transform(parts, x -> x.number) <> sequence(1, size(parts))"), "segment missing")
            .when(F.col("total").isNull(), "last segment missing")
            .when(F.expr("aggregate(parts, 0L, (n, x) -> n + octet_length(x.block))") != F.col("total"), "total length differs")
            .alias("gap"),
        )
    )
    both = whole.unionByName(parts).withColumn("p", payload(F.col("blocks"), F.col("digest"), F.col("kind")))
    reason = F.coalesce("gap", "p.reason")
    return both.select("record_id", "kind", "url", "digest", "length", "refers_to", "segments", "p.payload", "p.sha1", reason.isNull().alias("valid"), reason.alias("reason"))


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, segments, valid) of every page, written to the
    shared folder as archives and read back from them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{np.random.default_rng().integers(1 << 62):016x}"
    write(pages, path, least, segment)

    def page(name: str) -> Column:
        return F.expr(f"try_cast(split({name}, ':')[2] as bigint)")

    got = read(spark, path)
    return got.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("length")).alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page("refers_to").alias("refers_to"),
        "segments",
        "valid",
    )
