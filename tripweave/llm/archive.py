"""Legacy archives (ARC, versions 1 and 2) converted to WARC, with revisits for repeated payloads.

A table of pages is written as legacy archives, these are parsed by their version's header line and the
declared lengths, and the records are written as WARC and read back.  Archives are files of bounded size in
the folder the caller names; the text writer puts each record down as raw bytes, ended by its separator.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm.common import arrow_schema, map_arrow

#: Header lines of the two versions: fixed values of the format.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PIECE = 4 << 20


def _files(df: DataFrame, path: str, separator: str, records: int) -> None:
    df.select("value").write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def write_arc(pages: DataFrame, path: str, records: int = 1000) -> None:
    """Write ``pages`` (page_id, url, html) as ARC records; even ids go to version 1 archives, others to 2.

    The page's id travels in the HTTP header of its record.  A null html is empty, white space in a URL is
    percent-encoded, a null URL is ``unknown:``.  A row without page_id cannot be named and is left out.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n\r\n"))
    url = F.coalesce(F.nullif(F.regexp_replace(F.col("url").cast("string"), r"[\s\p{Cntrl}]", "%20"), F.lit("")), F.lit("unknown:"))
    size = (F.octet_length(http) + F.octet_length(body)).cast("string")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id"), F.lit(10_000_000))), "yyyyMMddHHmmss")
    one = F.concat_ws(" ", url, F.lit("0.0.0.0"), stamp, F.lit("text/html"), size)
    two = F.concat_ws(" ", url, F.lit("0.0.0.0"), stamp, F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc"), size)
    for version, line in (("1", one), ("2", two)):
        block = f"{version} 0 pages\n{FIELDS[version]}\n"
        own = F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 20231114000000 text/plain {'' if version == '1' else '200 - - 0 pages.arc '}{len(block)}\n{block}\n"), line)
        mine = pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.col("page_id"), F.lit(2)) == (0 if version == "1" else 1)))
        # every record is led by a version block, as in archives that were joined end to end
        _files(mine.select(F.concat(own.cast("binary"), F.lit(b"\n"), http.cast("binary"), body).cast("string").alias("value")), f"{path}/v{version}", "\n", records)


def _stream(data):
    return io.BytesIO(data) if isinstance(data, bytes) else data


def parse_arc(data):
    """Yield (url, ip, date, mime, status, block) of each record of bytes or a binary stream; ValueError where lengths
    do not fit.

    A ``filedesc:`` record declares the version of what follows, so files joined end to end are read too.
    Fields are taken by the names in its header line.
    """
    stream, names = _stream(data), FIELDS["1"].split(" ")
    while line := stream.readline():
        if line == b"\n":
            continue
        if not line.endswith(b"\n"):
            raise ValueError("a header line is cut off")
        head = line[:-1].decode("utf-8", "replace")
        if head.startswith("filedesc:"):
            block = stream.read(int(head.split(" ")[-1])).decode("utf-8", "replace").split("\n")
            if block[0].split(" ")[0] not in FIELDS:
                raise ValueError(f"unknown archive version: {block[0]!r}")
            names = block[1].split(" ")
            continue
        values = dict(zip(names, head.rsplit(" ", len(names) - 1), strict=True))
        size = int(values["Archive-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes is cut off")
        yield values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], values.get("Result-code", ""), block


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def _read(spark: SparkSession, path: str, rows, ddl: str) -> DataFrame:
    """Rows that ``rows(name, stream)`` yields from every archive under ``path``, in pieces of bounded size.

    Archives are unpacked as they are read, so a task holds one packed file and a piece of its records.
    """
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                held, size = [], 0
                for row in rows(name.as_py(), io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if size > _PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    return map_arrow(files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content"), run, ddl)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, target, stamp, mime, http, payload, digest) of every record, with the names WARC gives it.

    The id is a name-based UUID of URL, date, HTTP header, payload digest, and the archive's name and the record's number
    in it.  So a retried task gives the same, and records that are equal in all else have ids of their own.
    """

    def rows(file, stream):
        for n, (url, _, date, mime, _, block) in enumerate(parse_arc(stream)):
            http, payload = _split_http(block)
            digest = _sha1(payload)
            stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
            name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {http.decode('latin-1')} {file} {n}")
            yield f"<urn:uuid:{name}>", url, stamp, mime, http, payload, digest

    return _read(spark, path, rows, "record_id string, target string, stamp string, mime string, http binary, payload binary, digest string")


def page_of(http):
    """The page id that a record's HTTP header carries."""
    return F.regexp_extract(http.cast("string"), r"X-Page-Id: (-?\d+)\r\n", 1).cast("long")


def mark_revisits(records: DataFrame) -> DataFrame:
    """Add ``refers``: for all records of equal digest but one, that one's record id.

    It is the one of the largest page id, and of the largest record id where that page is there repeatedly.
    """
    named = records.withColumn("_page", page_of(F.col("http")))
    last = named.groupBy("digest").agg(F.max(F.struct("_page", "record_id")).alias("_last"))
    return named.join(last, "digest").withColumn("refers", F.when(F.col("record_id") != F.col("_last.record_id"), F.col("_last.record_id"))).drop("_page", "_last")


def write_warc(records: DataFrame, path: str, records_per_file: int = 1000) -> None:
    """Write records as WARC/1.0: ``response``, or ``revisit`` with the HTTP header alone where ``refers`` is set."""
    again = F.col("refers").isNotNull()
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "stamp"),
        F.concat(F.lit("WARC-Target-URI: "), "target"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("WARC-Refers-To: "), "refers"),  # null, so left out, for a response
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    _files(records.select(F.concat(head.cast("binary"), block).cast("string").alias("value")), path, "\r\n\r\n", records_per_file)


def parse_warc(data):
    """Yield (headers, block) of each record of bytes or a binary stream, by its Content-Length."""
    stream = _stream(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record here: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a header is cut off")
            name, _, value = line[:-2].decode("utf-8", "replace").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"a record of {size} bytes does not have its length")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target, stamp, digest, refers, payload_bytes, page_id) of every record.

    A response's payload is held against its digest and declared length.
    """

    def rows(_, stream):
        for h, block in parse_warc(stream):
            http, payload = _split_http(block)
            digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
            if h["WARC-Type"] == "response" and (_sha1(payload) != digest or len(payload) != size):
                raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
            page = [x for x in http.decode("latin-1").split("\r\n") if x.startswith("X-Page-Id: ")]
            yield h["WARC-Record-ID"], h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Date"], digest, h.get("WARC-Refers-To"), size, int(page[0][11:]) if page else None

    return _read(spark, path, rows, "record_id string, record_type string, target string, stamp string, digest string, refers string, payload_bytes long, page_id long")


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """Convert all ARC files under ``arcs`` to WARC files under ``warcs``, record by record, equal ones too.

    An empty payload is a payload like others.  No archives under ``arcs`` give no records.
    """
    write_warc(mark_revisits(read_arc(spark, arcs)), warcs)


def page_records(spark: SparkSession, warcs: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives of pages: a row for each record.

    Rows of pages that were equal are records of their own: one is the response, and the others refer to its page, which
    then is theirs too.  A null html is an empty payload.
    """
    got = read_warc(spark, warcs)
    whole = got.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return got.join(whole, "refers", "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
