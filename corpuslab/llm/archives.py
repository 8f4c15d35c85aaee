"""Legacy archive converter: ARC files to equivalent WARC files, and reading both.

An ARC file starts with a version block that says which fields its records' header lines have (five
in version 1, ten in version 2); the last field is the declared length. A record's bytes are
taken by that length, never by looking for the next header. The converter makes from each record
a WARC record with an identifier (a hash of the page's id and payload), an ISO timestamp, a type
and digests. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the
smallest page id is a response and the others revisit it; the payload of a revisit is not written again.

Files are written by Spark's text writer with the formats' own record separators and gzip, so they go
to any store that Spark can write; a file holds at most ``PER_FILE`` records and is read by one task.
Only digests and ids meet in the search for equal payloads, pre-aggregated per task; AQE may split
the join, so a payload that a third of all pages share is not gathered anywhere.

Defined results: a null payload is empty; a null URL becomes urn:page:<id>; white space and control
characters in URLs are written as percent codes; a null id is kept as null and never named by
others unless no other is there (then both are responses); repeated rows with the smallest id are all
responses; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.plans.scale import cut_lineage, ensure_checkpoint_dir

PER_FILE = 1024
LEAST_REVISIT = 100
#: Fixed values of the formats: field names of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER, REFERS_HEADER = "X-Page-Id", "X-Refers-To-Page"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _row_in_task() -> Column:
    """Number of the row in its task: the files of a task hold PER_FILE rows each in this order."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _write(lines: DataFrame, folder: str, separator: str) -> None:
    lines.write.option("lineSep", separator).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", PER_FILE).text(folder)


def _version_block(version: int) -> str:
    block = f"{version} 0 corpuslab\n{ARC_FIELDS[version]}\n"
    return f"filedesc://pages-v{version}.arc 0.0.0.0 20240101000000 text/plain {len(block)}\n{block}\n"


def write_arc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", page: str = "html",
    ip: str = "192.0.2.1", date: str = "20240101000000",
) -> None:
    """Write pages as ARC files, version 1 and 2 in turn. A record's content is the HTTP message."""
    body = F.coalesce(F.col(page).cast("string"), F.lit(""))
    address = F.coalesce(F.col(url).cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    address = F.when(address.rlike(r"[\x00-\x20\x7F]"), F.url_encode(address)).otherwise(address)
    message = F.concat(
        F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: "),
        F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    rows = pages.select(address.alias("address"), message.alias("message")).withColumn("row", _row_in_task())
    second = (F.floor(F.col("row") / PER_FILE) % 2) == 1
    line = F.concat_ws(" ", "address", F.lit(ip), F.lit(date), F.lit("text/html"), F.when(
        second, F.lit("200 - - 0 pages.arc")), F.octet_length("message").cast("string"))
    opening = F.when(F.col("row") % PER_FILE != 0, F.lit("")).when(second, F.lit(_version_block(2))).otherwise(F.lit(_version_block(1)))
    _write(rows.select(F.concat(opening, line, F.lit("\n"), "message")), folder, "\n")


def _inflated(raw: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while raw:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return out[0] if len(out) == 1 else b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of the records of an ARC file."""
    at, names = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8")
        if names is None or line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            version, fields = data[end + 1: end + 1 + length].decode("utf-8").splitlines()[:2]
            names = ARC_FIELDS[int(version.split(" ", 1)[0])].split(" ")
            if fields.split(" ") != names:
                raise ValueError(f"unknown fields of an ARC version block: {fields!r}")
        else:
            values = line.rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ValueError(f"an ARC header line needs {len(names)} fields: {line[:200]!r}")
            length = int(values[-1])
            content = data[end + 1: end + 1 + length]
            if len(content) != length:
                raise ValueError("an ARC record is shorter than declared")
            yield dict(zip(names, values, strict=True)), content
        at = end + 1 + length


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:200]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(header["content-length"])
        block = data[end + 4: end + 4 + length]
        if len(block) != length:
            raise ValueError("a WARC record is shorter than declared")
        yield header, block
        at = end + 4 + length


def _message(content: bytes) -> tuple[dict[str, str], str, bytes]:
    """Header fields, header text and payload of an HTTP message."""
    end = content.index(b"\r\n\r\n") + 4
    head = content[:end].decode("utf-8")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}, head, content[end:]


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, digest, n_bytes) of every record, and with ``payloads`` uri, ip, date, head and body."""
    fields = [("page_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64())]
    if payloads:
        fields += [(c, pa.string()) for c in ("uri", "ip", "date", "head", "body")]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for header, content in parse_arc(_inflated(file.as_py())):
                    http, head, body = _message(content)
                    row = (_number(http.get(PAGE_HEADER.lower())), hashlib.sha256(body).hexdigest(), len(body))
                    rows.append(row + ((
                        header["URL"], header["IP-address"], header["Archive-date"], head, body.decode("utf-8"),
                    ) if payloads else ()))
                yield _emit(rows, schema)

    ddl = "page_id long, digest string, n_bytes long" + ", uri string, ip string, date string, head string, body string" * payloads
    return _files(spark, folder).mapInArrow(run, ddl)


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    parts = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Write the records of ARC files as WARC files."""
    seen = read_arc(spark, arc, payloads=False)
    equal = cut_lineage(seen.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    rows = read_arc(spark, arc).join(equal, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    d = F.col("date")
    iso = F.concat(*(part for a, n, sep in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z"))
                     for part in (F.substr(d, F.lit(a), F.lit(n)), F.lit(sep))))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", iso), line("WARC-Target-URI", F.col("uri")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"), line("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))),
            line(REFERS_HEADER, F.col("first").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    info = "software: corpuslab\r\nformat: WARC File Format 1.1\r\n"
    opening = F.when(_row_in_task() % PER_FILE == 0, F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: "), _record_id(F.lit("info"), F.col("digest")),
        F.lit("\r\nWARC-Date: "), iso, F.lit(
            f"\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"))).otherwise(F.lit(""))
    _write(rows.select(F.concat(opening, header, block)), warc, "\r\n\r\n")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, date) of every
    response and revisit. The payload of a response is held against its digest."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for header, block in parse_warc(_inflated(file.as_py())):
                    if header["warc-type"] == "warcinfo":
                        continue
                    http, _, body = _message(block)
                    digest = header["warc-payload-digest"].removeprefix("sha256:")
                    if header["warc-type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {header['warc-record-id']} has another digest")
                    rows.append((
                        _number(http.get(PAGE_HEADER.lower())), int(http["content-length"]), digest, header["warc-type"],
                        _number(header.get(REFERS_HEADER.lower())), header["warc-record-id"], header["warc-target-uri"],
                        header["warc-date"]))
                yield _emit(rows, schema)

    return _files(spark, folder).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, uri string, date string")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Write pages as ARC files, convert them to WARC files and read these back."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc, key, url, page)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
