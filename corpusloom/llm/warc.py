"""WARC archives: writing captures and assembling them again from their records.

write_captures() turns each page into a request, a response (or a revisit of an equal payload) and a metadata
record. Spark's text writer stores them, a WARC record being one row that ends with the two line ends that close
every record; pages of like size are written together, so that a number of records bounds the bytes of a file.
read_records() parses archives record by record by their Content-Length, without unpacking a file whole, and checks
every payload's digest. assemble() joins the records of a transaction through WARC-Concurrent-To, whichever
side names the other, and emits one nested row per capture; resolved() gives revisits the payload's facts of the
response that they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import gone_at_exit, shared_path, written

CRLF = "\r\n"
#: Fixed values of WARC 1.1 (ISO 28500:2017).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Most bytes of payload in one archive, and the classes of payload sizes whose pages are written together.
FILE_BYTES, SIZE_CLASSES = 64 << 20, (16 << 10, 256 << 10, 4 << 20, 1 << 31)
#: Rows of the table of repeated payloads that are still broadcast.
BROADCAST_ROWS = 500_000

RECORD_TYPE = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, digest_matches boolean, payload_bytes bigint, head string, payload binary"
)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 8 groups of 20 bits."""
    code = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, record_id: Column, uri: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    lines += [F.concat(F.lit("WARC-Target-URI: "), uri), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null values make null lines, which array_join leaves out
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.array_join(F.array(*lines), CRLF), F.lit(CRLF * 2), block)


def _keyed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) stored once with payload, payload_digest, row_id and size_class.

    A row's number exists only in the stored table, so that every later reading of it finds the same ids, whatever
    order the source gives its rows in when a stage is run again. Classes of sizes are partitions of the table.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), digest(payload).alias("payload_digest"), F.monotonically_increasing_id().alias("place"))
    row_id = F.concat_ws("-", F.coalesce(F.url_encode(F.col("page_id").cast("string")), F.lit("")), F.lower(F.col("payload_digest")), F.col("place").cast("string"))
    size = F.octet_length("payload")
    class_of = F.size(F.filter(F.array(*[F.lit(c) for c in SIZE_CLASSES]), lambda c: c < size))
    rows = rows.select("page_id", "url", "payload", "payload_digest", row_id.alias("row_id"), size.alias("size"), class_of.alias("size_class"))
    path = shared_path(spark, "keyed")
    rows.write.partitionBy("size_class").option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _repeated(rows: DataFrame, least_bytes: int) -> DataFrame:
    """d, first_id and size_class: the original of each payload of at least least_bytes that stands more than once.

    That is the row with the smallest (page_id, url); null ids come last. No payload is read.
    """
    rank = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.coalesce("url", F.lit("")), F.col("row_id"))
    first = rows.where(F.col("size") >= least_bytes).groupBy(F.col("payload_digest").alias("d"), "size_class").agg(F.min(rank).alias("m"), F.count("*").alias("n")).where("n > 1")
    return written(first.select("d", F.col("m.row_id").alias("first_id"), "size_class"), "repeated")


def write_captures(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes three records for each page (page_id, url, html) to gzipped archives under path.

    The source is read once and its keyed rows are read once more. Equal payloads are of one size, so each class of
    sizes is written by itself; its largest payload says how many captures a file may have. A payload that most
    pages share costs one row of originals, which are broadcast where they are few; else Spark may split the pages.
    """
    rows = _keyed(pages)
    first = _repeated(rows, least_bytes)
    n_first = {r["size_class"]: r["count"] for r in first.groupBy("size_class").count().collect()}  # as the next
    for (k,) in sorted(tuple(r) for r in rows.select("size_class").distinct().collect()):  # at most len(SIZE_CLASSES) + 1 rows
        own = first.where(F.col("size_class") == k).drop("size_class")
        own = F.broadcast(own) if n_first.get(k, 0) <= BROADCAST_ROWS else own
        part = rows.where(F.col("size_class") == k)
        joined = part.join(own, part["payload_digest"] == own["d"], "left")
        original = F.when(F.col("first_id") != F.col("row_id"), F.col("first_id"))
        _write_class(joined.withColumn("original", original), f"{path}/size-{k}", max(1, FILE_BYTES // SIZE_CLASSES[min(k, len(SIZE_CLASSES) - 1)]))


def _write_class(rows: DataFrame, path: str, captures: int) -> None:
    """rows of _keyed() with original: the row that a revisit refers to, or null."""
    # A URI or id must not break out of its header line.
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", "")
    rid = lambda part, row="row_id": F.concat(F.lit(f"urn:capture:{part}:"), F.col(row))
    main = F.when(F.col("original").isNull(), rid("response")).otherwise(rid("revisit"))
    sent = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), sent, F.lit(CRLF * 2))
    sha = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    back = F.concat(F.lit("<"), main, F.lit(">"))
    response = _record("response", main, uri, [("WARC-Payload-Digest", sha)], "application/http; msgtype=response", F.concat(http, F.col("payload")))
    revisit = _record(
        "revisit", main, uri, [("WARC-Payload-Digest", sha), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<"), rid("response", "original"), F.lit(">")))],
        "application/http; msgtype=response", http,
    )
    request = _record("request", rid("request"), uri, [("WARC-Concurrent-To", back)], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF * 2}")))
    fields = F.coalesce(F.concat(F.lit("pageId: "), F.url_encode(F.col("page_id").cast("string")), F.lit(CRLF)), F.lit(""))
    metadata = _record("metadata", rid("metadata"), uri, [("WARC-Concurrent-To", back)], "application/warc-fields", fields)
    records = rows.select(F.explode(F.array(request, F.when(F.col("original").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)


_HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)")


class _Reader:
    """The bytes of a file as they are unpacked: archives often have a gzip member for each record."""

    PIECE = 1 << 20

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.ready = content, 0, bytearray()
        self.zipped = content[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        """Unpacks a piece; False at the end."""
        if self.at >= len(self.content) and not self.unzip.unconsumed_tail:
            return False
        if not self.zipped:
            self.ready += self.content[self.at : self.at + self.PIECE]
            self.at += self.PIECE
            return True
        data = self.unzip.unconsumed_tail
        if not data:
            data = self.content[self.at : self.at + self.PIECE]
            self.at += len(data)
        self.ready += self.unzip.decompress(data, self.PIECE)
        if self.unzip.eof:
            self.at -= len(self.unzip.unused_data)
            if self.content[self.at : self.at + 2] != b"\x1f\x8b":
                self.at = len(self.content)
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which go with it; None if there is no other."""
        searched = 0
        while (found := self.ready.find(mark, searched)) < 0:
            searched = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.ready[:found])
        del self.ready[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self.more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped or plain; what stands between records is skipped."""
    reader = _Reader(content)
    while reader.until(b"WARC/1.") is not None:
        head_lines = reader.until(b"\r\n\r\n")
        if head_lines is None:
            return
        headers: dict[str, list[str]] = {}
        for name, value in _HEADER.findall(head_lines, max(head_lines.find(b"\r\n"), 0)):
            headers.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        one = lambda name: headers.get(name, [None])[0]  # noqa: B023, E731
        bare = lambda value: None if value is None else value.strip("<>")
        length = one("content-length") or ""
        block = reader.take(int(length) if length.isdigit() else 0)
        kind, head, payload, size = one("warc-type"), "", block, None
        if (one("content-type") or "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            head = top.decode("utf-8", "replace")
            stated = re.search(r"(?im)^content-length:\s*(\d+)", head)
            size = int(stated[1]) if stated else None
        told = one("warc-payload-digest")
        told = told.partition(":")[2] if told and ":" in told else told
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if told else None
        yield {
            "record_id": bare(one("warc-record-id")), "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"),
            "concurrent_to": [bare(x) for x in headers.get("warc-concurrent-to", [])], "refers_to": bare(one("warc-refers-to")),
            "payload_digest": told, "digest_matches": None if told is None or kind == "revisit" else told == own,
            "payload_bytes": size if kind == "revisit" else len(payload), "head": head, "payload": payload,
        }


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD_TYPE.split(", ")]
    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for record in parse(bytes(content)):
                rows.append(record)
                size += len(record["payload"])
                if size > 8 << 20 or len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path (gzipped or plain), payloads whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(_parse_files, RECORD_TYPE)


def assemble(records: DataFrame, payloads: bool = True, both_ways: bool = True) -> DataFrame:
    """One row per capture: its response or revisit record with the requests and metadata concurrent to it.

    Columns: capture_id, record_type, target_uri, date, refers_to, payload_digest, digest_matches, payload_bytes,
    payload, requests and metadata (arrays of structs, by record id). Records meet under the id of their capture
    in one exchange, in which payloads of captures take part only if asked for. A request or metadata record may
    name several captures; with both_ways captures may also name their partners, which takes a second join. A
    capture without partners has empty arrays; a partner whose capture is not in the archives has no row. No
    records give no rows; a record met twice (archives copied) counts once.
    """
    is_main = F.col("record_type").isin("response", "revisit")
    is_part = F.col("record_type").isin("request", "metadata")
    payload = F.col("payload") if payloads else F.when(is_part, F.col("payload"))
    fields = ["record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "digest_matches", "payload_bytes", "head"]
    told = records.where(is_main | is_part).withColumn("record", F.struct(*fields, payload.alias("payload")))
    keyed = told.select(F.explode(F.when(is_main, F.array("record_id")).otherwise(F.col("concurrent_to"))).alias("capture_id"), "record")
    if both_ways:
        naming = told.where(is_main).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("part_id"))
        parts = told.where(is_part).select(F.col("record_id").alias("part_id"), "record")
        keyed = keyed.unionByName(naming.join(parts, "part_id").select("capture_id", "record"))
    met = keyed.groupBy("capture_id").agg(F.array_sort(F.collect_set("record")).alias("all"))
    kind = lambda *names: F.filter("all", lambda r: r["record_type"].isin(*names))
    parts_of = lambda name: F.transform(kind(name), lambda r: F.struct(r["record_id"].alias("record_id"), r["head"].alias("head"), r["payload"].alias("payload")))
    out = met.select("capture_id", F.try_element_at(kind("response", "revisit"), F.lit(1)).alias("main"), parts_of("request").alias("requests"), parts_of("metadata").alias("metadata"))
    return out.where("main is not null").select("capture_id", *[F.col(f"main.{c}") for c in fields if c not in ("record_id", "head")], "main.payload", "requests", "metadata")


def resolved(captures: DataFrame) -> DataFrame:
    """captures with the size and digest of each payload, a revisit's those of the response that it refers to.

    digest_matches tells whether the digest stated by the record is that of the payload; it is false where a
    revisit's response is missing, was no match itself or has another digest. No payload takes part in the join.
    """
    responses = captures.where("record_type = 'response'").select(F.col("capture_id").alias("_of"), F.struct("payload_bytes", "payload_digest", "digest_matches").alias("_response"))
    wanted = captures.where("record_type = 'revisit'").select(F.col("refers_to").alias("_of")).distinct()
    told = captures.join(responses.join(wanted, "_of", "left_semi"), F.col("refers_to") == F.col("_of"), "left")
    revisit = F.col("record_type") == "revisit"
    same = F.coalesce(F.col("_response.digest_matches") & (F.col("_response.payload_digest") == F.col("payload_digest")), F.lit(False))
    return told.withColumns(
        {
            "payload_bytes": F.when(revisit, F.coalesce("_response.payload_bytes", "payload_bytes")).otherwise(F.col("payload_bytes")),
            "digest_matches": F.when(revisit, same).otherwise(F.col("digest_matches")),
        }
    ).drop("_of", "_response")


def op4_warc(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back and assembles the captures, payloads included.

    The page id comes from the metadata record; the one revisited stands in the id that WARC-Refers-To names. A null
    page id stays null. Ids of any type are written encoded, so that none breaks out of its line.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    write_captures(pages, path)
    gone_at_exit(spark, path)
    if not pages.limit(1).count():
        return pages.limit(0).selectExpr("page_id", "0L payload_bytes", "'' payload_digest", "'' record_type", "page_id refers_to", "true digest_matches", "0 n_requests")
    whole = assemble(read_records(spark, path), both_ways=False)  # write_captures names captures from the other records
    # the nested rows are stored without the payloads' bytes, whose lengths and digests the parser has taken
    facts = whole.withColumn("held_bytes", F.octet_length("payload")).drop("payload", "target_uri", "date")
    captures = resolved(written(facts, "captures"))
    told = F.regexp_extract(F.element_at("metadata", 1)["payload"].cast("string"), r"pageId: ([^\r\n]*)", 1)
    kind = pages.schema["page_id"].dataType
    return captures.select(
        F.when(told != "", F.url_decode(told)).cast(kind).alias("page_id"),
        F.when(F.col("record_type") == "response", F.col("held_bytes").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.url_decode(F.nullif(F.regexp_extract("refers_to", r"^urn:capture:response:(.*)-[a-z2-7]{32}-\d+$", 1), F.lit(""))).cast(kind).alias("refers_to"),
        "digest_matches",
        F.size("requests").alias("n_requests"),
    )


def _base32_sql(code: str) -> str:
    return " || ".join(f"substr('{BASE32}', ((('0x' || substr({code}, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, first_value(page_id) OVER w AS f, row_number() OVER w AS k FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, coalesce(url, '')))
SELECT page_id, strlen(h) AS payload_bytes, {_base32_sql('sha1(h)')} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to, true AS digest_matches, 1 AS n_requests FROM p
"""
