"""Operator 5: WARC archives with segment reassembly.

Writing: every page becomes a response record, or a revisit record if a page with a smaller id has the
same payload. Response blocks carry an HTTP head with chunked transfer framing and are cut into
segments: the first keeps the record's id, the others are continuation records that name it and their
number, the last one with the total length. Reading: continuation records are grouped by origin,
ordered by number, checked for gaps and for the total length, and freed of the chunked framing.

Archives are gzip files written by Spark's text writer with the record separator as line end, so they
go to any file system; a file holds at most FILE_RECORDS records. They are read whole, one file at a time.

A null html is an empty payload; a null url an empty target. Rows of one page_id are separate pages; of
those with equal payloads the one with the smallest url counts as smaller, and of wholly equal rows any
one is the response. A null page_id counts as larger than all others. Pages may have any length up to a
cell's; an empty table gives no archive and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import scratch, text_of

#: Bytes of a segment, of a transfer chunk, and records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 4096, 1500, 4096
SEPARATOR = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The body behind chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(key: str) -> str:
    """The id of the response with a payload of this SHA-256: there is one per payload."""
    return f"<urn:uuid:{uuid.UUID(hex=key[:32])}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def page_records(key: str, url: str, page: str, digest: str, copy: int, payload: bytes) -> Iterator[bytes]:
    """The records of a page, segments included; a copy above 0 is a revisit of the response of that payload."""
    one_line = " ".join(url.split())
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{page}/{copy}/{url}')}>" if copy else record_id(key)
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", one_line), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page)]
    if copy:
        extra = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(key))]
        yield record(extra + head, b"")
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    kind = [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        yield record(kind + head, block)
        return
    yield record([*kind, ("WARC-Segment-Number", "1"), *head], parts[0])
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(parts) else []
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{number}')}>"
        named = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", one_line)]
        yield record([*named, ("WARC-Segment-Origin-ID", record_id(key)), ("WARC-Segment-Number", str(number)), *last], part)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as WARC files below a path.

    Rows are told apart by what they hold, not by numbers: equal payloads fold inside each task to one
    response per payload, and only ids, urls and digests decide which rows revisit it.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), F.encode(text_of("html"), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("key", F.sha2("payload", 256)).withColumn("none", F.col("page_id").isNull())
    first = F.struct("none", "page_id", "url")
    responses = keyed.groupBy("key").agg(F.first("payload").alias("payload"), F.min(first).alias("first"))
    responses = responses.select("key", "first.page_id", "first.url", F.lit(0).cast("long").alias("copy"), "payload", F.lit(None).cast("string").alias("sha1"))
    rows = keyed.withColumn("sha1", F.sha1("payload")).groupBy("key", "sha1", "none", "page_id", "url").agg(F.count("*").alias("n"))
    firsts = rows.groupBy("key").agg(F.min(first).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    known = rows.join(firsts, "key").withColumn("left", F.col("n") - F.when(first.eqNullSafe(F.col("first")), 1).otherwise(0)).where("left > 0")
    again = known.select("key", "page_id", "url", F.explode(F.sequence(F.lit(1).cast("long"), "left")).alias("copy"), F.lit(b"").alias("payload"), "sha1")
    both = responses.unionByName(again).select("key", "url", F.col("page_id").cast("string").alias("page"), "copy", "payload", "sha1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, url, page, copy, payload, sha1 in batch[["key", "url", "page", "copy", "payload", "sha1"]].itertuples(index=False):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode() if copy else digest_of(bytes(payload))
                out += page_records(key, url, page if isinstance(page, str) else "", digest, copy, bytes(payload))
            yield pd.DataFrame({"value": out})

    records = both.mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("compression", "gzip").option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_RECORDS).text(path)


PARSED = "type string, id string, origin string, number int, total long, refers string, page string, digest string, block binary"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not at a record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-refers-to", "x-page-id", "warc-payload-digest")
    for batch in batches:
        for content in batch["content"]:
            rows = [(*(h.get(n) for n in names), block) for h, block in parse(gzip.decompress(content))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])
            out["number"], out["total"] = (pd.to_numeric(out[c]).astype("Int64") for c in ("number", "total"))
            yield out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below a path, segments as they are."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parse_files, PARSED)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole responses: id, page, payload_bytes, payload_digest and whether segments and lengths are in order."""
    segment = F.struct(F.coalesce("number", F.lit(1)).alias("number"), "total", "page", "block")
    whole = records.where(F.col("type").isin("response", "continuation")).groupBy(F.coalesce("origin", "id").alias("id")).agg(F.array_sort(F.collect_list(segment)).alias("parts"))
    decoded = whole.select(
        "id",
        F.col("parts")[0]["page"].alias("page"),
        F.transform("parts", lambda p: p["number"]).alias("numbers"),
        F.element_at("parts", -1)["total"].cast("string").alias("total"),
        F.col("parts")["block"].alias("blocks"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, page, numbers, total, blocks in batch[["id", "page", "numbers", "total", "blocks"]].itertuples(index=False):
                block = b"".join(bytes(b) for b in blocks)
                right = list(numbers) == list(range(1, len(blocks) + 1)) and (len(blocks) == 1 or isinstance(total, str) and int(total) == len(block))
                try:
                    payload = payload_of(block)
                except ValueError:
                    payload, right = b"", False
                rows.append((id_, page, len(payload), digest_of(payload), right, payload))
            yield pd.DataFrame(rows, columns=["id", "page", "payload_bytes", "payload_digest", "whole", "payload"])

    return decoded.mapInPandas(run, "id string, page string, payload_bytes long, payload_digest string, whole boolean, payload binary")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) and whole."""
    records = read_records(spark, path)
    responses = reassembled(records).drop("payload")
    revisits = records.where(F.col("type") == "revisit").select("page", F.col("refers").alias("id"))
    facts = responses.select("id", F.col("page").alias("to"), "payload_bytes", "payload_digest", "whole")
    again = revisits.join(facts, "id", "left")
    none = F.lit(None).cast("long")
    page = F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id")
    return responses.select(page, "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none.alias("refers_to"), "whole").unionByName(
        again.select(page, "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("to").cast("long").alias("refers_to"), "whole")
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes the archives of pages into the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_pages(pages.sparkSession, path)
