r"""Legacy archive converter: ARC files to WARC files, both written and read through Spark.

An ARC file starts with a version block whose second line names the version; a URL record line has
the fields that version declares (version 1: five, version 2: ten), the last of which is the length
of the block after it. Fields count from the right, because a URL may hold spaces. The converter
parses these lines, takes blocks by their declared lengths and synthesises the WARC identifier,
timestamp, type and digests. Records with equal payloads become one response and revisits.

Files are text files of Spark's own writer, gzip-compressed, with the record separator as line
separator: any file system that Spark reaches will do. A reader never looks for separators inside a
record, it goes by declared lengths. It unpacks record by record, so a task holds a file as it is
stored and one record of it.

Records are written by classes of payload sizes, each with its own number of records a file, so that
a file holds some 128 MB, or one record. Equal payloads are of one class. A record's identifier is
made from the ARC file and the record's place in it, so repeated rows have different ones; revisits
name the response by this identifier, and readers resolve it.

Defined cases: null payloads are empty; empty and short payloads are always responses; repeated
rows are records of their own, all responses if they hold the largest id; rows without an id are
responses; a null URL is written as
``-``; line breaks in a URL are escaped; an empty table gives no records; extra columns do not
matter.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import new_path, stored

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: The fields of a URL record line by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Classes of payloads: more than so many bytes, so many records of one file at most.
SIZES = [(-1, 500), (2**18, 16), (2**23, 1)]
#: Parts into which the revisits of one response are dealt when it is looked up.
SALTS = 16
CRLF = "\r\n"


def _bytes(text: F.Column) -> F.Column:
    return F.octet_length(text)


def write_arc(pages: DataFrame, path: str, version: int, date: str = "20240101000000") -> None:
    """Write (page_id, url, html) rows as ARC files of ``version``, below ``path`` by classes of sizes.

    The id is a response header.
    """
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page-Id: "),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f"{CRLF}Content-Length: "),
        _bytes(payload).cast("string"),
        F.lit(CRLF * 2),
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("-")), r"[\r\n]", "%0A")
    block = F.concat(F.col("head"), payload)
    length = _bytes(block).cast("string")
    middle = {1: [F.lit("text/html")], 2: [F.lit("text/html"), F.lit("200"), F.md5(block), F.lit("-"), F.lit("0"), F.lit("-")]}[version]
    line = F.concat_ws(" ", F.col("url"), F.lit("0.0.0.0"), F.lit(date), *middle, length)
    origin = f"{version} {0 if version == 1 else 1} origin\n{' '.join(ARC_FIELDS[version])}\n"
    first = f"filedesc://{version}.arc 0.0.0.0 {date} text/plain {len(origin)}\n{origin}\n"
    # Every file needs a version block; the writer cannot add one, so each record line carries its own.
    value = F.concat(F.lit(first), line, F.lit("\n"), block).alias("value")
    for size, (above, most) in enumerate(SIZES):
        inside = _bytes(payload) > above
        if size + 1 < len(SIZES):
            inside &= _bytes(payload) <= SIZES[size + 1][0]
        records = pages.where(inside).select(url.alias("url"), "html", head.alias("head")).select(value)
        _write(records, f"{path}/size={size}", "\n\n", most)


def _write(records: DataFrame, path: str, separator: str, most: int) -> None:
    """Text files of ``most`` records; level 4 takes a third of the time of level 6 and 4 % more room."""
    writer = records.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "FOUR")
    writer.option("maxRecordsPerFile", most).text(path)


def _heads(data: bytes | BinaryIO) -> Iterator[tuple[bytes, BinaryIO]]:
    """The first line of every record, without its line break, and the stream that stands behind it."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if line.strip(b"\r\n"):
            yield line.rstrip(b"\r\n"), stream


def _block(stream: BinaryIO, length: int) -> bytes:
    block = stream.read(length)
    if len(block) < length:
        raise ValueError("a block is shorter than declared")
    return block


def arc_records(data: bytes | BinaryIO) -> Iterator[tuple[str, str, bytes]]:
    """(url, 14-digit date, block) of an ARC file, by the version in force and declared lengths."""
    fields = None
    for line, stream in _heads(data):
        parts = line.decode("utf-8", "replace").split(" ")
        block = _block(stream, int(parts[-1]))
        if line.startswith(b"filedesc://"):
            fields = len(ARC_FIELDS[int(block.split(b" ", 1)[0])])
            continue
        if fields is None or len(parts) < fields:
            raise ValueError("an ARC record line does not fit its version")
        rest = len(parts) - fields + 1
        yield " ".join(parts[:rest]), parts[rest + 1], block


def warc_records(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a WARC file, by declared lengths."""
    for top, stream in _heads(data):
        if not top.startswith(b"WARC/"):
            raise ValueError("a WARC record does not start with its version")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[name] = value
        yield headers, _block(stream, int(headers["Content-Length"]))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its path and bytes, gzip as stored."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, BinaryIO]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), gzip.open(pa.BufferReader(content.as_buffer()))


def _http(block: bytes) -> tuple[bytes, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(origin, page_id, url, date, head, payload) of the ARC files below ``path``; the origin is file and place."""
    kinds = [("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("head", pa.string()), ("payload", pa.string())]
    schema = pa.schema(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, stream in _opened(batches):
            rows, size = [], 0
            for place, (url, date, block) in enumerate(arc_records(stream)):
                head, body = _http(block)
                page = next((int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"X-Page-Id: ") and x[11:]), None)
                rows.append((f"{file}:{place}", page, url, date, head.decode("utf-8", "replace"), body))
                size += len(body)
                if size > 8_000_000:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    return _files(spark, path).mapInArrow(parse, "origin string, page_id long, url string, date string, head string, payload string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, pa.binary()).cast(t) if t == pa.string() and isinstance(c[0], bytes) else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def convert(spark: SparkSession, arc: str, warc: str, most: int = SIZES[0][1]) -> None:
    """Write the WARC equivalent of the ARC files below ``arc`` to ``warc``, ``most`` records a file.

    A first pass over the ARC files finds the record with the largest id of every digest that occurs more than once.
    The join with these digests shuffles a payload once; a hot digest is one that Spark splits.
    """
    records = read_arc(spark, arc).withColumns({"sha": F.sha1("payload"), "n": _bytes(F.col("payload"))})
    copies = (
        records.where(F.col("n") >= REVISIT_BYTES)
        .groupBy("sha")
        .agg(F.max(F.struct("page_id", "origin")).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("sha", F.col("first.page_id").alias("first_id"), F.col("first.origin").alias("first_origin"))
    )
    marked = records.join(copies, "sha", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id") != F.col("first_id")) & (F.col("n") >= REVISIT_BYTES)
    block = F.concat("head", F.lit(CRLF * 2), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    name = lambda origin: F.regexp_replace(F.sha1(origin), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "<urn:uuid:$1-$2-$3-$4-$5>")
    date = F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    pair = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    lines = [
        F.lit(f"WARC/1.1{CRLF}"),
        pair("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        pair("WARC-Record-ID", name(F.col("origin"))),
        pair("WARC-Date", date),
        pair("WARC-Target-URI", F.col("url")),
        pair("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha")),
        pair("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.when(
            F.col("revisit"),
            F.concat(
                pair("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                pair("WARC-Refers-To", name(F.col("first_origin"))),
            ),
        ).otherwise(F.lit("")),
        pair("Content-Type", F.lit("application/http; msgtype=response")),
        pair("Content-Length", _bytes(F.col("block")).cast("string")),
        F.lit(CRLF),
        F.col("block"),
    ]
    flagged = marked.withColumn("revisit", F.coalesce(revisit, F.lit(False))).withColumn("block", block)
    _write(flagged.select(F.concat(*lines).alias("value")), warc, CRLF * 2, most)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, record_id, payload_bytes, payload_digest, refers_to) of WARC files.

    ``refers_to`` is the identifier that a revisit names. Payload digests of responses are computed
    anew and checked against the header.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string())]
    schema = pa.schema([*kinds, ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for _, stream in _opened(batches):
            rows = []
            for headers, block in warc_records(stream):
                head, body = _http(block)
                http = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split(CRLF)[1:])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not fit its digest")
                page = http.get("X-Page-Id")
                record = (headers["WARC-Target-URI"], headers["WARC-Type"], headers["WARC-Record-ID"], int(http["Content-Length"]), digest)
                rows.append((int(page) if page else None, *record, headers.get("WARC-Refers-To")))
            if rows:
                yield _batch(rows, schema)

    ddl = "page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to string"
    return _files(spark, path).mapInArrow(parse, ddl)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of ``read_warc`` with ``refers_to`` as the id of the page that the named record holds.

    Each named record is looked up once; the revisits of one response meet it in SALTS parts, so one
    that a third of all records name does not come to one task. Payloads take no part.
    """
    revisits, named = records.where("refers_to is not null"), F.col("refers_to").alias("record_id")
    found = records.where("refers_to is null").select("record_id", F.col("page_id").alias("_page"))
    found = found.join(revisits.select(named).distinct(), "record_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = revisits.withColumn("_salt", F.pmod(F.xxhash64("page_id", "record_id"), F.lit(SALTS)).cast("int"))
    told = salted.join(found.withColumnRenamed("record_id", "refers_to"), ["refers_to", "_salt"], "left").withColumn("refers_to", F.col("_page"))
    rest = records.where("refers_to is null").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(told.select(records.columns))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as ARC files of version 1 (even ids) and 2 (odd ids), converted to WARC, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    odd = F.coalesce(F.col("page_id") % 2 == 1, F.lit(False))
    write_arc(pages.where(~odd), f"{arc}/v=1", 1)
    write_arc(pages.where(odd), f"{arc}/v=2", 2)
    for size, (_, most) in enumerate(SIZES):
        convert(spark, f"{arc}/v=*/size={size}", f"{warc}/size={size}", most)
    records = stored(read_warc(spark, f"{warc}/size=*").drop("url"), "warc-read")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS sha FROM p),
m AS (SELECT sha, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY sha)
SELECT page_id, n AS payload_bytes, d.sha AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN m USING (sha)
"""
