"""Legacy archive converter: ARC files of versions 1 and 2 to WARC 1.1, and a reader for both.

An ARC file starts with a version block, whose second line holds the version and whose third line names the fields of
the header lines that follow. A record is a header line, then as many bytes as its last field declares, then a newline.
The converter reads the fields by those names, so either version's lines come out alike, and makes for each record a
WARC identifier, timestamp, type and digests; the version block becomes a warcinfo record. Archives are gzip files with a
member for each record, of ARCHIVE_BYTES before compression or one record. They are written and read by Spark, so any store
that Spark knows will do; after an archive's last member stands an empty one, which Spark's writer puts there.

Defined results: a null html is an empty payload; null urls and ids are left out of the headers and come back as null. A
damaged header line gives a row of kind "error" with its offset and text. What follows is read on: after the declared
length if the line has one that leads to another record, else from the next line that has the shape of a header. Converted,
an error is a metadata record that tells it. An empty table gives no archives. Equal rows give equal records, one each. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, new_path

#: Fixed values of the format: the field names of the header lines by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"
#: A gzip member without content: what separates the rows of a file that Spark writes.
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()

#: Bytes of an archive before compression; a larger record is an archive by itself.
ARCHIVE_BYTES = 32 << 20
#: Payloads below this many bytes are never deduplicated.
LEAST_REVISIT = 100
CAPTURED = "20240101000000"
IP = "0.0.0.0"

ARC_ROW = "kind string, archive string, offset long, url string, ip string, date string, http string, payload binary, digest string, error string"


def arc_version_block(name: str, version: int, date: str = CAPTURED) -> str:
    body = f"{version} 0 passagework\n{' '.join(ARC_FIELDS[version])}\n\n"
    fields = {"URL": f"filedesc://{name}", "IP-address": IP, "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body.encode()))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]) + "\n" + body


def arc_record(url: str | None, block: bytes, version: int, date: str = CAPTURED, offset: int = 0, name: str = "-") -> bytes:
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "-"
    fields = {"URL": target, "IP-address": IP, "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(archives: DataFrame, path: str) -> None:
    """A file for each row of archives (value: gzip members)."""
    rows = archives.select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """ARC archives of the rows' pages; the versions take turns by task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, number, offset, out = TaskContext.get().partitionId(), 0, 0, []
        version = versions[k % len(versions)]

        def archive() -> pa.RecordBatch:
            nonlocal number, offset
            made = pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
            number, offset = number + 1, 0
            out.clear()
            return made

        for b in batches:
            for i in range(0, b.num_rows, 256):
                for page_id, target, body in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    block = http_block((body or "").encode(), page_id)
                    if out and offset + len(block) > ARCHIVE_BYTES:
                        yield archive()
                    name = f"pages-{k:06d}-{number:06d}.arc"
                    if not out:
                        head = arc_version_block(name, version).encode()
                        out.append(member(head))
                        offset = len(head)
                    record = arc_record(target, block, version, CAPTURED, offset, name) + b"\n"
                    out.append(member(record))
                    offset += len(record)
        if out:
            yield archive()

    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url).alias("u"), F.col(html).alias("h"))
    write_archives(rows.mapInArrow(lean(encode), "value binary"), path)


def unzipped(data: bytes) -> bytes:
    """The bytes of a file, through all members of a gzip file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, view, at = [], memoryview(data), 0
    while at < len(data):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(data):  # in steps, so what is left over is never copied often
            out.append(d.decompress(view[at : at + (1 << 14)]))
            at = min(at + (1 << 14), len(data))
        at -= len(d.unused_data)
        if not d.eof:
            break
    return b"".join(out)


#: What a header line looks like where a damaged one has left no length to go by.
_HEADER = re.compile(rb"(?<=\n)\S+ \d{1,3}(?:\.\d{1,3}){3} \d{14} [^\n]* \d+(?=\n)")


def parse_arc(data: bytes, archive: str = "") -> Iterator[dict]:
    """Records (and version blocks, of kind "version") of an ARC file; header fields are found by the names in its version
    block."""
    at, fields = 0, None

    def shaped(line: bytes) -> bool:
        parts = line.split(b" ")
        return parts[-1].isdigit() and len(parts) == len(fields or ARC_FIELDS[1])

    while at < len(data):
        if data[at : at + 1] == b"\n":  # the newline after a record
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        text = line.decode("utf-8", "replace")
        parts = text.split(" ")
        declared = int(parts[-1]) if parts[-1].isdigit() and len(parts[-1]) < 19 else -1
        start, stop = end + 1, end + 1 + declared
        first = parts[0].startswith("filedesc:")
        if declared < 0 or stop > len(data) or not (first or shaped(line)):
            why = text[:500] if declared < 0 or stop <= len(data) else f"declared {declared} bytes: {text[:400]}"
            yield {"kind": "error", "archive": archive, "offset": at, "error": why}
            follows = data[stop : stop + (1 << 16)].lstrip(b"\n").split(b"\n", 1)[0] if 0 <= declared and stop <= len(data) else b""
            if follows and shaped(follows):
                at = stop
            else:
                found = next((m for m in _HEADER.finditer(data, end) if shaped(m[0])), None)
                at = found.start() if found else len(data)
            continue
        block = data[start:stop]
        if first:
            said = block.decode("utf-8", "replace").split("\n")
            version = int(said[0].split(" ")[0]) if said[0][:1].isdigit() and said[0].split(" ")[0].isdigit() else 1
            fields = said[1].split(" ") if len(said) > 1 and said[1].startswith("URL") else ARC_FIELDS.get(version, ARC_FIELDS[1])
            yield {"kind": "version", "archive": archive, "offset": at, "url": parts[0], "date": parts[2] if len(parts) > 2 else None, "http": "", "payload": block, "error": None}
        else:
            got = dict(zip(fields or ARC_FIELDS[1], parts, strict=False))
            http, payload = split_http(block)
            yield {"kind": "record", "archive": archive, "offset": at, "url": None if got["URL"] == "-" else got["URL"], "ip": got.get("IP-address"), "date": got.get("Archive-date"), "http": http, "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "error": None}
        at = stop


def split_http(block: bytes) -> tuple[str, bytes]:
    """HTTP header lines with the blank line after them, and the payload; a block without such lines is all payload."""
    if block[:5] == b"HTTP/" and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4].decode("utf-8", "replace"), block[end + 4 :]
    return "", block


def files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")


def read_arc(spark, path: str) -> DataFrame:
    """A row for each record, version block or error of the ARC archives under path; see ARC_ROW."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("http", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("error", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                yield from in_batches(parse_arc(unzipped(content.as_py()), name.as_py().rpartition("/")[2]), schema)

    return files(spark, path).mapInArrow(lean(parse), ARC_ROW)


def in_batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r.get("payload") or b"") + 200
        if size >= limit:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def http_header(http: Column, name: str) -> Column:
    got = F.regexp_extract(http, rf"(?i)\r\n{re.escape(name)}: *([^\r]*)\r\n", 1)
    return F.when(got != "", got)


def record_id(*parts: object) -> str:
    """The same identifier for the same record, whenever it is made."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def warc_date(arc: str | None) -> str:
    """ARC's 14 digits (or fewer: the rest is the earliest) as a WARC timestamp; the epoch if they are no date."""
    if not arc or not arc.isdigit() or not 4 <= len(arc) <= 14:
        return "1970-01-01T00:00:00Z"
    d = arc + "00000101000000"[len(arc) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, url: str | None, ip: str | None, date: str | None, http: str, payload: bytes, digest: str, own: str, first: str | None) -> bytes:
    """A WARC record without its closing blank lines. A revisit has the HTTP headers only and names the first record."""
    block = http.encode() + (b"" if kind == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {warc_date(date)}"]
    lines += [f"WARC-Target-URI: {url}"] if url else []
    lines += [f"WARC-IP-Address: {ip}"] if ip and ip != IP else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    lines += [f"WARC-Refers-To: {first}", f"WARC-Profile: {REVISIT_PROFILE}"] if kind == "revisit" else []
    content = {"warcinfo": "application/warc-fields", "metadata": "text/plain"}.get(kind, "application/http; msgtype=response" if http else "application/octet-stream")
    lines += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def other_record(r: dict) -> bytes:
    """The warcinfo record of a version block, or the metadata record that tells an error."""
    if r["kind"] == "version":
        kind, said = "warcinfo", b"software: passagework\r\nformat: WARC File Format 1.1\r\nconverted-from: " + b" ".join(r["payload"].split()) + b"\r\n"
    else:
        kind, said = "metadata", f"damaged at {r['offset']} of {r['archive']}: {r['error']}".encode()
    digest = hashlib.sha256(said).hexdigest()
    return warc_record(kind, None, None, r.get("date"), "", said, digest, record_id(kind, r["archive"], r["offset"]), None)


def convert(spark, arc: str, warc: str) -> None:
    """WARC archives, one of each of the ARC archives under `arc`. Of records with equal payloads of LEAST_REVISIT bytes or
    more, that with the smallest page id (none: last), then place, is the response; the others revisit it. What is damaged
    becomes metadata records, and version blocks warcinfo records.

    The first of each payload is found from rows without payloads, with partial sums before the shuffle. What the records
    of an archive revisit goes to that archive, still compressed, so payloads are never shuffled by themselves.
    """
    rows = read_arc(spark, arc).where(F.col("kind") == "record")
    page = http_header(F.col("http"), "X-Page-Id").cast("long")
    place = F.struct(page.isNull().alias("none"), page.alias("page"), "archive", "offset")
    keyed = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("digest", place.alias("place"))
    first = keyed.groupBy(F.col("digest").alias("fdigest")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = keyed.join(first, F.col("digest") == F.col("fdigest")).where(F.col("place") != F.col("first"))
    at = F.struct(F.col("place.offset").alias("offset"), F.concat_ws("/", "first.archive", "first.offset").alias("first_at"))
    revisits = later.groupBy(F.col("place.archive").alias("of")).agg(F.collect_list(at).alias("revisits"))  # as many as an archive has records
    archives = files(spark, arc).withColumn("archive", F.substring_index("path", "/", -1))
    wanted = archives.join(revisits, F.col("archive") == F.col("of"), "left").select("archive", "content", "revisits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content, later in zip(*b.columns, strict=True):
                of = {x["offset"]: x["first_at"] for x in later.as_py() or ()}
                out = []
                for r in parse_arc(unzipped(content.as_py()), name.as_py()):
                    if r["kind"] == "record":
                        # the digest is the content's, the place in the old archive tells equal captures apart
                        first_at = of.get(r["offset"])
                        first_id = record_id(r["digest"], first_at) if first_at else None
                        own = record_id(r["digest"], f"{r['archive']}/{r['offset']}")
                        made = warc_record("revisit" if first_at else "response", r["url"], r["ip"], r["date"], r["http"], r["payload"], r["digest"], own, first_id)
                    else:
                        made = other_record(r)
                    out.append(member(made + WARC_END.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    write_archives(wanted.mapInArrow(lean(encode), "value binary"), warc)


def parse_warc(data: bytes, archive: str = "") -> Iterator[dict]:
    """Records of a WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not length.isdigit() or end + 4 + int(length) > len(data):
            yield {"kind": "error", "archive": archive, "offset": at, "error": lines[0][:500]}
            return
        block = data[end + 4 : end + 4 + int(length)]
        http, payload = split_http(block)
        yield {
            "kind": head.get("warc-type"), "archive": archive, "offset": at, "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "payload_digest": head.get("warc-payload-digest"), "block_digest": head.get("warc-block-digest"), "http": http, "payload": payload, "intact": head.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}",
        }
        at = end + 4 + int(length)


WARC_ROW = "kind string, archive string, offset long, record_id string, refers_to string, url string, date string, payload_digest string, block_digest string, http string, payload binary, intact boolean, error string"


def read_warc(spark, path: str) -> DataFrame:
    """A row for each record (or error) of the WARC archives under path; see WARC_ROW."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}.get(t, text)) for n, t in (x.split() for x in WARC_ROW.split(", "))])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                yield from in_batches(parse_warc(unzipped(content.as_py()), name.as_py().rpartition("/")[2]), schema)

    return files(spark, path).mapInArrow(lean(parse), WARC_ROW)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC, read back: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, warc_date, record_id, intact, a row for each page.

    What a revisit leaves out comes from its headers: the length from the HTTP ones, the digest from the WARC ones.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    page = http_header(F.col("http"), "X-Page-Id").cast("long")
    length = F.coalesce(http_header(F.col("http"), "Content-Length").cast("long"), F.octet_length("payload").cast("long"))
    got = read_warc(spark, warc).where(F.col("kind").isin("response", "revisit")).select(
        page.alias("page_id"), length.alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").alias("first_id"),
        "url", F.col("date").alias("warc_date"), "record_id", "intact",
    )
    responses = got.where("record_type = 'response'").select(F.col("record_id").alias("rid"), F.col("page_id").alias("refers_to"))
    return got.join(responses, F.col("first_id") == F.col("rid"), "left").drop("rid", "first_id")
