"""WARC archives of pages, and a reader that salvages what damage has left.

Records are built as text columns and written by Spark's own text writer, whose
line end is the end of a WARC record, so commits, retries and any file system
work as for other tables. Equal payloads are stored once; later pages get a
``revisit`` record that refers to the first.

The reader checks every record: version line, header, length, end and digests.
After a failed check it searches for the next version line or gzip member that
passes, goes on there, and logs the bytes in between as a quarantined gap. It
reads plain files and files of one gzip member per record alike.

Defined results: a null html is empty; rows that repeat the smallest page_id of
a payload are responses too; a page without page_id revisits the response of
its payload if another page has one; an empty table writes no record; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telespan.llm.base import query, table, whole_text
from telespan.scratch import materialize, scratch_path

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORDS_PER_FILE = 4000
FEED = 1 << 16  # bytes of a member that are unpacked at a time
LEAST_BYTES = 0  # smaller payloads are never revisits
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = (
    "kind string, file string, offset bigint, length bigint, reason string, page_id bigint, url string, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def sha1_base32(value: Column) -> Column:
    """Upper-case base32 of the SHA-1, ten hex digits (forty bits) at a time."""
    hex_digest = F.sha1(value.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, its size and digest, record_type and refers_to.

    Only payloads found more than once are looked up. Their table is written
    first, so that its size is known and pages stay where they are while it is
    small; else a payload of a third of all pages meets its one row in a join
    whose skewed side Spark can split.
    """
    rows = pages.select(
        "page_id", "url", whole_text("html").alias("payload"), sha1_base32(whole_text("html")).alias("payload_digest")
    ).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    firsts = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    firsts = materialize(firsts, "warc-firsts")
    return rows.join(firsts, "payload_digest", "left").select(
        *rows.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(page_id.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def _header(name: str, value: Column) -> Column:
    """One header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_text(rows: DataFrame) -> DataFrame:
    """One string per record, without its end."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
        F.col("payload"),
    )
    stored = F.col("record_type") == "response"
    url = F.regexp_replace("url", "[\\x00-\\x20]", "")
    headers = [
        F.lit(VERSION + "\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("block")))),
        _header("WARC-Refers-To", _urn(F.col("refers_to"))),
        _header("WARC-Profile", F.when(~stored, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page-Id", F.col("refers_to")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    ]
    return rows.withColumn("block", F.when(stored, http).otherwise("")).select(F.concat(*headers).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """A folder of WARC files of at most RECORDS_PER_FILE records each."""
    (
        record_text(record_types(pages, least_bytes))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(data: bytes, at: int) -> tuple[int, dict] | str:
    """End and fields of the record at an offset, or what is wrong with it."""
    if not data.startswith(b"WARC/1.", at):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "header without end"
    lines = data[at:head_end].split(b"\r\n")[1:]
    if not all(b":" in x for x in lines):
        return "bad header line"
    head = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in (x.split(b":", 1) for x in lines)}
    if len(head) < len(lines):
        return "a header twice"  # as where a cut runs two records together
    if not head.get("content-length", "").isdigit():
        return "no length"
    begin = head_end + 4
    end = begin + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "record does not end where it should"
    block = data[begin:end]
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + _digest(block):
        return "block digest differs"
    kind = head.get("warc-type", "")
    _, split, body = block.partition(b"\r\n\r\n")
    payload = body if split and block.startswith(b"HTTP/") else block
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and digest and digest != _digest(payload):
        return "payload digest differs"
    number = lambda name: int(head[name]) if head.get(name, "").lstrip("-").isdigit() else None
    return end + 4, {
        "page_id": number("x-page-id"),
        "url": head.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": number("x-payload-length") if kind == "revisit" else len(payload),
        "payload_digest": digest or _digest(payload),
        "refers_to": number("x-refers-to-page-id"),
        "payload": None if kind == "revisit" else payload,
    }


def _member(data: bytes, at: int) -> tuple[int, list[dict]] | str:
    """End and records of the gzip member at an offset, or what is wrong with it."""
    unzip, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof and fed < len(data):
            parts.append(unzip.decompress(data[fed : fed + FEED]))
            fed += FEED
    except zlib.error as error:
        return f"bad member: {error}"
    if not unzip.eof:
        return "member without end"
    plain = b"".join(parts)
    records, inside = [], 0
    while inside < len(plain):
        found = _record(plain, inside)
        if isinstance(found, str):
            return found
        inside, fields = found
        records.append(fields)
    return min(fed, len(data)) - len(unzip.unused_data), records


def salvage(data: bytes) -> Iterator[dict]:
    """All records that pass their checks, and a gap for each stretch of bytes that held none."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        zipped = data.startswith(b"\x1f\x8b\x08", at)
        found = _member(data, at) if zipped else _record(data, at)
        if isinstance(found, str):
            gap, reason = (at, found) if gap is None else (gap, reason)
            nexts = [x for x in (data.find(b"WARC/1.", at + 1), data.find(b"\x1f\x8b\x08", at + 1)) if x >= 0]
            at = min(nexts, default=len(data))
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
            gap = None
        end, records = found
        for fields in records if zipped else [records]:
            yield {"kind": "record", "offset": at, "length": end - at} | fields
        at = end
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": reason}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files below a folder; a file is read as a whole by one task.

    Payloads are checked in any case, and returned unless ``payloads`` is false.
    """
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = [
                    {"file": file.as_py()} | x | ({} if payloads else {"payload": None}) for x in salvage(data.as_py())
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, SCHEMA)


_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes,
       list_reduce(flatten(list_transform([1, 11, 21, 31], lambda i: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s:
         '{_BASE32}'[CAST(((('0x' || x[i:i + 9])::BIGINT >> s) & 31) AS INT) + 1]))), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


@query("op10_warc", _SQL)
def op10_warc(spark, sf):
    """What the archives of all pages say about each page when read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf, "pages"), path)
    return (
        read_archives(spark, path, payloads=False)
        .where("kind = 'record'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
