"""WARC: writing archives with revisit records, and a salvage reader.

The writer is a DataFrame job: each record is one string, or one gzip member of its own, and Spark's text sink writes it, so
archives land on any file system that Spark can write. The reader takes whole archive files (bounded by the writer) and
survives damage: after a failed check it looks for the next gzip member or version line, goes on there, and logs the
bytes between.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, shared_dir, stored, table

CRLF = "\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never revisits.
LEAST_SHARED = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
SCHEMA = "file string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


# ---------------------------------------------------------------- writer


#: Digests that repeat are broadcast if they are no more than this (some 20 MB); else payloads are shuffled by digest.
SMALL = 100_000


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST_SHARED) -> DataFrame:
    """Adds payload (null: empty), payload_digest, payload_bytes, first_id and revisit. Of rows with an equal payload of
    at least `least` bytes that has the smallest id (null after all others; ties by url, then by place) is no revisit,
    and first_id is its id; the others are revisits of it.

    Digests are counted before the shuffle, and only those that occur twice are joined back, to rows of `least` bytes."""
    p = pages.withColumn("payload", F.coalesce(F.col(payload_col), F.lit(""))).withColumn("uid", F.monotonically_increasing_id())
    p = p.withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(url_col), F.col("uid"))
    shared = stored(
        p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min(F.struct(order.alias("o"), F.col(id_col).alias("id"), F.col("uid").alias("uid"))).alias("m"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("payload_digest", F.col("m.id").alias("first_id"), F.col("m.uid").alias("first_uid")), "shared",
    )
    few = shared.count() <= SMALL
    long = p if few else p.filter(F.col("payload_bytes") >= least)
    out = long.join(F.broadcast(shared) if few else shared, (F.col("payload_bytes") >= least) & (long["payload_digest"] == shared["payload_digest"]), "left").drop(shared["payload_digest"])
    out = out.withColumn("revisit", F.coalesce(F.col("uid") != F.col("first_uid"), F.lit(False))).drop("first_uid")
    if not few:
        short = p.filter(F.col("payload_bytes") < least)
        out = out.unionByName(short.withColumns({"first_id": F.lit(None).cast(pages.schema[id_col].dataType), "revisit": F.lit(False)}))
    return out.drop("uid")


def record_text(id_col: str, url_col: str, date: str):
    """The record as one string, without the blank lines after it (the sink writes those)."""
    revisit = F.col("revisit")
    head = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    clean = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", named(F.col(id_col))), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.coalesce(line("WARC-Refers-To", named(F.col("first_id"))), F.lit("")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF), F.col("block"),
    )
    return block, header


#: Payloads of so many bytes and more go to files of one record; smaller ones by `records_per_file`.
LARGE = 1 << 20
#: The last byte of a gzip member is the highest of its size, 0 for all but huge ones: it is what parts lines here.
LAST = b"\0"


def as_member(record: bytes) -> bytes:
    """The record as one gzip member, without the 0 it ends with; one of 16 MB and more has an empty member after it,
    which ends so."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if not out.endswith(LAST):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.flush()
    return out[:-1]


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", records_per_file: int = 500, codec: str = "gzip") -> None:
    """One record per row; with gzip each is a member of its own, so damage to one costs no other. Files hold at most
    `records_per_file` records of less than a megabyte, or one larger one, so that a reader's task needs little memory.

    A null payload is empty; a null id gives no record id; rows given twice are records of their own, and of equal long
    payloads all but one are revisits. An empty table gives an empty archive. Other columns of pages are not looked at."""
    from pyspark.sql import types as T

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = with_revisits(rows, "page_id", "url", "html")
    block, text = record_text("page_id", "url", date)
    out = rows.withColumn("block", block).select(text.alias("value"), (F.col("payload_bytes") >= LARGE).alias("large"))
    end = CRLF * 2
    if codec == "gzip":

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, 100):
                    part = b.slice(k, 100)
                    yield pa.RecordBatch.from_arrays([pa.array([as_member(v.encode("utf-8") + b"\r\n\r\n") for v in part.column(0).to_pylist()], pa.binary()), part.column(1)], names=["value", "large"])

        out = lean(out).mapInArrow(run, T.StructType([T.StructField("value", T.BinaryType()), T.StructField("large", T.BooleanType())]))
        out = out.select(F.col("value").cast("string").alias("value"), "large")
        end = LAST.decode()
    write = lambda df, n: df.write.mode("append").option("lineSep", end).option("compression", "none").option("maxRecordsPerFile", n).text(path)
    write(out.filter(~F.col("large")).select("value"), records_per_file)
    large = rows.filter(F.col("payload_bytes") >= LARGE).select("payload_bytes")
    if not large.isEmpty():
        write(out.filter("large").select("value"), 1)


# ---------------------------------------------------------------- reader


CUT = "member is cut short"
#: Bytes of a damaged member that are taken at a time.
STEP = 64


def before_failure(raw: bytes) -> bytes:
    """What a member gives before it fails."""
    d, out = zlib.decompressobj(31), []
    with contextlib.suppress(zlib.error):
        for i in range(0, len(raw), STEP):
            out.append(d.decompress(raw[i : i + STEP]))
    return b"".join(out)


def members(raw: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """Gzip members: (offset, length, data, ""), or (offset, length, data before the failure, reason) for a gap. After a
    member that fails its checks, the search goes on at the next member's magic number."""
    at = 0
    while at < len(raw):
        begun = raw.startswith(MEMBER, at)
        if begun:
            d = zlib.decompressobj(31)
            try:
                data = d.decompress(memoryview(raw)[at:])
                if d.eof:
                    used = len(raw) - at - len(d.unused_data)
                    yield at, used, data, ""
                    at += used
                    continue
                why = CUT
            except zlib.error as e:
                why = f"member fails: {e}"
        else:
            why = "no member starts here"
        to = raw.find(MEMBER, at + 1)
        to = len(raw) if to < 0 else to
        yield at, to - at, before_failure(raw[at:to]) if begun else b"", why
        at = to


#: A record's header has no more bytes than this, so a search for its end is short wherever a version line stands.
HEADER_BYTES = 1 << 16
HEADER = re.compile(rb"([!-9;-~]+):[ \t]*(.*)")


def parse_one(raw: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at `at`: (fields, its end, "") or (None, at, reason)."""
    if not raw.startswith(VERSION, at):
        return None, at, "no version line"
    end = raw.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        return None, at, "header does not end"
    head: dict[str, str] = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        if not (m := HEADER.fullmatch(line)):
            return None, at, "bad header line"
        head[m[1].decode("latin-1").lower()] = m[2].decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,15}", head.get("content-length", "")):
        return None, at, "no content length"
    start, size = end + 4, int(head["content-length"])
    block = raw[start : start + size]
    if len(block) < size:
        return None, at, "block is cut short"
    if raw[start + size : start + size + 4] != b"\r\n\r\n":
        return None, at, "block does not end where it should"
    want = head.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        return None, at, "block digest differs"
    is_http = head.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if is_http else block
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if head.get("warc-payload-digest", "").startswith("sha256:") and own != digest:
            return None, at, "payload digest differs"
        digest = own
    full = int(head["x-payload-length"]) if kind == "revisit" and head.get("x-payload-length", "").isdigit() else len(payload)
    fields = {
        "record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": full, "payload": payload,
    }
    return fields, start + size + 4, ""


def records(raw: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, plain or gzipped. Offsets are in the file for plain archives; in gzipped ones
    they are those of the member for its gaps, and within the member's data for records. Of a member that is cut short,
    the records before the cut are read; of one that fails its checks those with a right block digest, unless it holds a
    single record, which the member's checks are for."""
    if raw.startswith(MEMBER) or (not raw.startswith(VERSION) and MEMBER in raw and VERSION not in raw):
        for at, size, data, why in members(raw):
            if why:
                found = [r for r in plain(data) if r["kind"] == "record"]
                if why != CUT:
                    checked = [r for r in found if b"warc-block-digest: sha256:" in data[r["offset"] :].partition(b"\r\n\r\n")[0].lower()]
                    found = checked if len(found) > 1 else []
                yield from found
                yield {"kind": "gap", "offset": at, "length": size, "reason": why}
            else:
                yield from plain(data)
    else:
        yield from plain(raw)


def plain(raw: bytes) -> Iterator[dict]:
    at = 0
    while at < len(raw):
        fields, end, why = parse_one(raw, at)
        if fields is not None:
            yield {"kind": "record", "offset": at, "length": end - at, "reason": None, **fields}
            at = end
            continue
        to = at
        while True:  # the next version line at which a whole record stands
            to = raw.find(VERSION, to + 1)
            if to < 0 or parse_one(raw, to)[0] is not None:
                break
        to = len(raw) if to < 0 else to
        yield {"kind": "gap", "offset": at, "length": to - at, "reason": why}
        at = to


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind 'record' and 'gap' (a quarantined run of bytes with the reason). An empty file gives no rows."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for r in records(content.as_py()):
                    r["file"] = name
                    if not payloads:
                        r.pop("payload", None)
                    held += len(r.get("payload") or b"")
                    rows.append(r)
                    if len(rows) >= 2000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written and read back; bytes that could not be read are an error. A null page_id has no record id and
    comes back null: it is a revisit if its payload is long and another page has it, and of pages with null ids alone
    one is the response, which its revisits cannot name. Of rows that share the smallest page_id one is the response.
    Null html is an empty payload."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    whole = F.when(F.col("kind") == "record", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("lost bytes in "), "file", F.lit(": "), "reason")).cast("boolean"))
    return read_warc(spark, path, payloads=False).filter(whole).select(
        as_long(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        as_long(F.col("refers_to")).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) > 1 AND payload_bytes >= 100 AS again,
        first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM f
"""
