"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: request, response (or revisit, where an equal payload
is archived already) and metadata; request and metadata name the response in
WARC-Concurrent-To. ``write`` makes archives of pages, ``read`` gives their records,
and ``assemble`` joins the records of a capture through their concurrent-to
identifiers into one nested row.

Archives are written by Spark's own text sink, so that any file system will do: a
record is a row that ends in a line feed. The sink can't start a compressed
member for each record, so with ``compression="gzip"`` an archive is one gzip
stream. Reading follows Content-Length, whatever the payload holds, a chunk at a
time.

Equal payloads are found on a slim table of digests. Its first pages are written
before the others join them, so that Spark can split what one common payload joins;
the pages' texts are dealt by page and digest, so that they meet in no task.

Defined cases: a null html is an empty payload; a null url leaves out
WARC-Target-URI; of rows equal in page_id and payload one counts as first; a null
page_id is first only where no other page has the payload, and refers_to is then
null; control characters and blanks in urls are percent-encoded; an empty table
writes no record and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactspark.llm.common import cut, keep
from contactspark.llm.neardup import components
from contactspark.session import ship

DATE = "2020-01-01T00:00:00Z"
#: Records of an archive, and bytes of payload that a batch of read records holds about.
RECORDS, BATCH = 6000, 4_000_000
NL = "\r\n"

RECORD = "record_id string, warc_type string, concurrent_to array<string>, refers_to string, target_uri string, warc_date string, header_digest string, digest string, payload_bytes bigint, payload binary, fields map<string,string>"
_ARROW = pa.schema(
    [("record_id", pa.string()), ("warc_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string())]
    + [("header_digest", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hexadecimal digits: five of these are four of those."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NL)), F.lit(""))


def _record(kind: str | Column, urn: Column, uri: Column, media: str, block: Column, more: list[Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    length = F.octet_length(block).cast("string")
    head = [F.lit(f"WARC/1.1{NL}"), _line("WARC-Type", kind), _line("WARC-Record-ID", urn), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", uri), *more]
    return F.concat(*head, _line("Content-Type", F.lit(media)), _line("Content-Length", length), F.lit(NL), block, F.lit("\r\n\r"))


def records(pages: DataFrame) -> DataFrame:
    """The three records of each page, as strings without their last line feed, in order within a capture."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    key = ["_id", "_none", "digest", "bytes"]  # page_id without null, so that join and window deal alike
    p = p.withColumn("_id", F.coalesce("page_id", F.lit(0))).withColumn("_none", F.col("page_id").isNull())
    known = p.select("page_id", *key).distinct()
    first = cut(known.groupBy("digest", "bytes").agg(F.min("page_id").alias("first_id")))
    known = known.join(first, ["digest", "bytes"]).select(*key, "first_id")
    p = p.join(known, key)
    p = p.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("url")))
    new = (F.col("turn") == 1) & F.col("page_id").eqNullSafe(F.col("first_id"))

    def response_id(page: str, turn: Column) -> Column:
        return _urn("response", F.col(page), F.col("digest"), turn)

    own = response_id("page_id", F.col("turn"))
    to = response_id("first_id", F.lit(1))
    uri = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", "%0A"), " ", "%20")
    host = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    request = F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(f" HTTP/1.1{NL}Host: "), F.coalesce(host, F.lit("")), F.lit(NL + NL))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(NL + NL))
    fields = F.concat(_line("page-id", F.col("page_id").cast("string")), _line("payload-bytes", F.col("bytes").cast("string")), _line("refers-to-page-id", F.when(~new, F.col("first_id")).cast("string")))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    concurrent = _line("WARC-Concurrent-To", own)
    profile = _line("WARC-Profile", F.when(~new, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    three = F.array(
        _record("request", _urn("request", own), uri, "application/http; msgtype=request", request, [concurrent]),
        _record(F.when(new, "response").otherwise("revisit"), own, uri, "application/http; msgtype=response", F.when(new, F.concat(http, "html")).otherwise(http), [digest, _line("WARC-Refers-To", F.when(~new, to)), profile]),
        _record("metadata", _urn("metadata", own), uri, "application/warc-fields", fields, [concurrent]),
    )
    return p.select(F.explode(three).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of ``pages`` in the folder ``path``."""
    records(pages).write.option("maxRecordsPerFile", RECORDS).option("compression", compression).option("lineSep", "\n").text(path)


class _Bytes:
    """An archive's bytes, inflated as they are needed."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.inflate and self.inflate.eof and self.inflate.unused_data:  # the next member
            rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.held += self.inflate.decompress(rest)
            return True
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(part)
        self.held += self.inflate.decompress(part) if self.inflate else part
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("a WARC record is cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(lines: str) -> list[tuple[str, str]]:
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in re.split(r"\r?\n", lines) if ":" in x)]


def parse(raw: bytes) -> Iterator[dict]:
    """The records of an archive, plain or gzip."""
    source = _Bytes(raw)
    while (head := source.until(b"\r\n\r\n")) is not None:
        if not head.strip():
            continue
        text = head.decode("utf-8", "replace").lstrip()
        if not text.startswith("WARC/"):
            raise ValueError(f"no WARC record: {text[:60]!r}")
        pairs = _fields(text.split("\n", 1)[1])
        h = dict(reversed(pairs))
        block = source.take(int(h["content-length"]))
        source.until(b"\r\n\r\n")
        payload, kind = block, h.get("content-type", "")
        if kind.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": h.get("warc-record-id"), "warc_type": h.get("warc-type"), "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"], "refers_to": h.get("warc-refers-to"),
            "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "header_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "digest": digest,
            "payload_bytes": len(payload), "payload": payload, "fields": _fields(block.decode("utf-8", "replace")) if kind.startswith("application/warc-fields") else [],
        }


def _reader(payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                held, size = [], 0
                for r in parse(raw.as_py()):
                    held.append(r if payload else r | {"payload": None})
                    size += r["payload_bytes"] * payload + 500
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return _read


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``; ``digest`` is computed, ``header_digest`` stated. Without ``payload`` that column is null: for those who need its length and digest only, payloads are read but not passed on."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RECORD)
    ship(spark)
    return files.select("content").mapInArrow(_reader(payload), RECORD)


def assemble(archived: DataFrame) -> DataFrame:
    """A nested row for each capture: capture_id (the response's identifier, or, where there is none, one of its records') and structs response, request, metadata (null where there is none).

    Records that are tied by WARC-Concurrent-To, in either direction and over any number
    of steps, belong to one capture, even where a record that ties them isn't archived.
    Of several records of a kind in a capture the one with the smallest identifier counts.

    Records are written to the shared folder first, as read, and used twice from there.
    Most name one response, and are tied by its identifier. Those that name several, name
    others as a response, or name one while they are named themselves are joined through
    their identifiers to connected groups (``neardup.components``). Then all records meet
    in one grouping.
    """
    records = keep(archived.where(F.col("warc_type").isin("response", "revisit", "request", "metadata")))
    main = F.col("warc_type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce(F.try_element_at("concurrent_to", F.lit(1)), F.col("record_id")))
    naming = records.where(F.size("concurrent_to") > 0).select("record_id", "concurrent_to", (main | (F.size("concurrent_to") > 1)).alias("knot"))
    ends = F.concat(F.transform("concurrent_to", lambda x: F.struct(x.alias("record_id"), F.lit(0).alias("names"))), F.when(F.col("knot"), F.array()).otherwise(F.array(F.struct("record_id", F.lit(1).alias("names")))))
    marks = naming.select(F.explode(ends).alias("m")).select("m.*")
    chained = cut(marks.groupBy("record_id").agg(F.max("names").alias("most"), F.min("names").alias("least")).where("most = 1 and least = 0").select("record_id"))
    knots = naming.where("knot").unionByName(naming.where("not knot").join(chained, "record_id", "left_semi"))
    plain = chained.isEmpty() and naming.where("knot").isEmpty()

    part = {
        "response": (main, ["record_id", "warc_type", "refers_to", "target_uri", "warc_date", "header_digest", "digest", "payload_bytes", "payload"]),
        "request": (F.col("warc_type") == "request", ["record_id", "target_uri", "warc_date", "payload"]),
        "metadata": (F.col("warc_type") == "metadata", ["record_id", "warc_date", "fields"]),
    }
    kinds = [F.min_by(F.when(own, F.struct(*names)), F.when(own, F.col("record_id"))).alias(k) for k, (own, names) in part.items()]
    tied = records.withColumn("_key", key)
    if plain:
        tied = tied.withColumn("_capture", F.col("_key"))
    else:
        groups = components(knots.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))).select(F.col("tid").alias("_key"), "root")
        tied = tied.join(groups, "_key", "left").withColumn("_capture", F.coalesce("root", "_key"))
    whole = tied.groupBy("_capture").agg(*kinds)
    return whole.select(F.coalesce("response.record_id", "_capture").alias("capture_id"), "response", "request", "metadata")
