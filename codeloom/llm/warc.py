"""Legacy archive converter: ARC files to WARC files.

ARC records have a header line whose fields depend on the version that the file's first record declares; the last
field is the length of the content. The converter reads records by these lengths and synthesises what WARC has and
ARC lacks: record ids, ISO timestamps, types and digests. Of responses with equal payloads one stays a response and
the others become revisits of it.

Archives are written by Spark's text sink (a record is a row, the separator after it is the line separator), so they
go to any store that Spark reaches, and are read whole, one file of at most about ARCHIVE_BYTES (or one record) a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, own_path, written

ARCHIVE_BYTES = 24 << 20
HEADER_END = re.compile(rb"\r?\n\r?\n")
#: Bytes that are handed to a decompressor at once.
PIECE = 64 << 10
#: Fixed values of the formats: the fields of an ARC header line by version, and the separators after records.
ARC_FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields of revisits: the page id of the response, so that readers need not look its record up, and the
#: length of the payload that isn't stored again.
REFERS_TO_PAGE = b"X-Refers-To-Page-Id"
PAYLOAD_LENGTH = b"X-Payload-Length"
#: Payloads shorter than this are stored again rather than revisited.
LEAST_REVISIT = 1000


def _http(page_id, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), own)


def arc_record(version: bytes, url: bytes, ip: bytes, date: bytes, mime: bytes, content: bytes, at: int, name: bytes) -> bytes:
    """One ARC record without the newline after it."""
    fields = [url, ip, date, mime, b"%d" % len(content)]
    if version == b"2":
        fields[4:4] = [b"200", hashlib.md5(content).hexdigest().encode(), b"-", b"%d" % at, name]
    return b" ".join(fields) + b"\n" + content


def _arc_rows(batches):
    """A partition's records, after the version block that opens its file. Odd partitions write version 2."""
    part = TaskContext.get().partitionId()
    version, name, at = (b"1", b"2")[part % 2], b"legacy-%06d.arc" % part, 0
    block = b"%s 0 InternetArchive\n%s\n" % (version, ARC_FIELDS[version])
    opening = arc_record(version, b"filedesc://" + name, b"0.0.0.0", b"20000101000000", b"text/plain", block, 0, name)
    for batch in batches:
        out = []
        for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].cast(pa.binary()).to_pylist(), batch["html"].cast(pa.binary()).to_pylist()):
            payload = html or b""
            url = b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url or b"") or b"-"
            if opening:
                out.append(opening)
                at, opening = len(opening) + 1, None
            out.append(arc_record(version, url, b"0.0.0.0", b"20000101000000", b"text/html", _http(page, payload) + payload, at, name))
            at += len(out[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _write(records: DataFrame, path: str, end: str) -> None:
    records.select(F.col("record").cast("string")).write.option("lineSep", end).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """pages (page_id long, url, html) as ARC files under path, dealt by hash of page and row number, so that rows that
    are alike, or have no page_id, are spread like others."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    total = pages.agg(F.sum(F.octet_length("html") + 300)).first()[0] or 0
    dealt = pages.withColumn("row", F.monotonically_increasing_id()).repartition(max(1, -(-total // archive_bytes)), "page_id", "url", "row")
    _write(dealt.mapInArrow(_arc_rows, "record binary"), path, ARC_END)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The archives under path: file (its name), content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def unpacked(content: bytes) -> bytes:
    """All members of a gzip file, however many; other content as it is. Of a member that is cut short or damaged, what
    can be read of it."""
    if content[:2] != b"\x1f\x8b":
        return content
    member = zlib.decompressobj(31)
    try:
        first = member.decompress(content)
    except zlib.error:
        first, member = b"", zlib.decompressobj(31)
    else:
        if member.unused_data[:2] != b"\x1f\x8b":
            return first
    # more than one: from here on a piece at a time, so that what is left isn't copied for each
    out, at, view = [first], len(content) - len(member.unused_data) if first else 0, memoryview(content)
    member = zlib.decompressobj(31)
    while at < len(content):
        try:
            out.append(member.decompress(view[at : at + PIECE]))
        except zlib.error:
            break
        at += min(PIECE, len(content) - at) - len(member.unused_data)
        if member.eof:
            if content[at : at + 2] != b"\x1f\x8b":
                break
            member = zlib.decompressobj(31)
    return b"".join(out)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """A response's header, with the empty line that ends it, and its payload. Lines may end in CRLF or in LF alone."""
    found = HEADER_END.search(block)
    cut = found.end() if found else len(block)
    return block[:cut], block[cut:]


def _arc_header(line: bytes, names: list[bytes], left: int) -> dict | None:
    """The fields of a header line of these names, if it is one and what it heads lies within `left` bytes."""
    values = line.rsplit(b" ", len(names) - 1)  # a URL with spaces in it stays whole
    fields = dict(zip(names, values))
    date = fields.get(b"archive-date", b"")
    sound = len(values) == len(names) and date.isdigit() and len(date) >= 8 and values[-1].isdigit() and int(values[-1]) <= left
    return fields if sound else None


def arc_records(data: bytes, damaged: list | None = None):
    """(offset, fields by name in lower case, content) of each record of an ARC file. Lines where a header should be and
    none is, and records longer than the file, are passed over, up to the next line that is a header; `damaged` gets
    their offsets."""
    at, names, lost = 0, [x.lower() for x in ARC_FIELDS[b"1"].split()], False
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if not line:  # separators
            at = max(at, end) + 1
            continue
        fields, left = None, len(data) - end - 1 if end >= 0 else -1
        if line.startswith(b"filedesc://") and left >= 0:
            length = line.rsplit(b" ", 1)[1] if b" " in line else b""
            if length.isdigit() and int(length) <= left:
                version, *described = data[end + 1 : end + 1 + int(length)].split(b"\n")[:2]
                known = ARC_FIELDS.get(version.split()[0] if version.split() else b"")
                if own := b"".join(described).strip() or known:
                    names = [x.lower() for x in own.split()]
                    values = line.split(b" ")
                    fields = dict(zip(names, values if len(values) == len(names) else [values[0], *[b"-"] * (len(names) - 2), values[-1]]))
        elif left >= 0:
            fields = _arc_header(line, names, left)
        if fields is None:
            if not lost and damaged is not None:
                damaged.append(at)
            lost, at = True, end + 1 if end >= 0 else len(data)
            continue
        lost, length = False, int(fields[names[-1]])
        yield at, fields, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def damage(spark: SparkSession, path: str) -> DataFrame:
    """Where the ARC files under path have something other than a whole record: file, at (offset in the unpacked file)."""

    def run(batches):
        for batch in batches:
            found = []
            for file, content in zip(batch["file"].to_pylist(), batch["content"]):
                at: list[int] = []
                for _ in arc_records(unpacked(content.as_py()), at):
                    pass
                found += [(file, x) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["file", "at"])

    return files(spark, path).mapInArrow(run, "file string, at long")


def _record_id(fields: dict, name: str, at: int) -> str:
    """The same id whenever the record is converted: from the archive's own name and the offset."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}"


def _archive_name(fields: dict) -> str:
    return fields[b"url"].decode("utf-8", "replace").removeprefix("filedesc://")


def _number(http: bytes, name: bytes) -> int | None:
    """The number that a header of this name has."""
    for line in http.split(b"\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name and value.strip().lstrip(b"-").isdigit():
            return int(value)
    return None


def _page_id(http: bytes):
    return _number(http, b"x-page-id")


def _digest_rows(batches):
    """What is needed to choose among equal payloads."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file", "at", "id", "page_id", "digest", "length")}
        for file, content in zip(batch["file"].to_pylist(), batch["content"]):
            name = file
            for at, fields, body in arc_records(unpacked(content.as_py())):
                if fields[b"url"].startswith(b"filedesc://"):
                    name = _archive_name(fields)
                    continue
                http, payload = split_http(body)
                for k, v in zip(out, (file, at, _record_id(fields, name, at), _page_id(http), hashlib.sha1(payload).digest(), len(payload))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in (("file", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("page_id", pa.int64()), ("digest", pa.binary()), ("length", pa.int64()))], list(out))


def warc_record(kind: bytes, record_id: str, uri: bytes, date: bytes, mime: bytes, block: bytes, more: list[tuple[bytes, bytes]]) -> bytes:
    """One WARC record without the two line ends after it."""
    stamp = b"%s-%s-%sT%s:%s:%sZ" % (date[:4], date[4:6], date[6:8], date[8:10], date[10:12], date[12:14])
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<%s>" % record_id.encode()), (b"WARC-Date", stamp), (b"WARC-Target-URI", uri), *more]
    head += [(b"WARC-Block-Digest", b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())), (b"Content-Type", mime), (b"Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % x for x in head if x[1]) + b"\r\n" + block


def _warc_rows(batches):
    """Each ARC record as a WARC record; `revisits` has (offset, id and page id of the response) of those that repeat a
    payload."""
    for batch in batches:
        for file, content, revisits in zip(batch["file"].to_pylist(), batch["content"], batch["revisits"].to_pylist()):
            name, out, size = file, [], 0
            of = {x["at"]: (x["of"], x["of_page"]) for x in revisits or []}
            for at, fields, body in arc_records(unpacked(content.as_py())):
                url, date = fields[b"url"], fields[b"archive-date"].ljust(14, b"0")
                if url.startswith(b"filedesc://"):
                    name = _archive_name(fields)
                    out.append(warc_record(b"warcinfo", _record_id(fields, name, at), b"", date, b"application/warc-fields", b"format: WARC File Format 1.1\r\nconverted-from: %s\r\n" % name.encode(), [(b"WARC-Filename", name.encode())]))
                elif not body.startswith(b"HTTP/"):  # dns: and other lookups
                    out.append(warc_record(b"resource", _record_id(fields, name, at), url, date, fields[b"content-type"], body, [(b"WARC-IP-Address", fields[b"ip-address"])]))
                else:
                    http, payload = split_http(body)
                    digest = b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
                    more = [(b"WARC-IP-Address", fields[b"ip-address"]), (b"WARC-Payload-Digest", digest)]
                    if at in of:
                        record, page = of[at]
                        more += [(b"WARC-Refers-To", b"<%s>" % record.encode()), (b"WARC-Profile", REVISIT_PROFILE), (REFERS_TO_PAGE, b"" if page is None else b"%d" % page), (PAYLOAD_LENGTH, b"%d" % len(payload))]
                    out.append(warc_record(b"revisit" if at in of else b"response", _record_id(fields, name, at), url, date, b"application/http; msgtype=response", http if at in of else body, more))
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT) -> None:
    """The ARC files under arc as WARC files under warc.

    Of responses with equal payloads of at least `least` bytes, that with the largest page id (then record id) stays,
    the others revisit it. Which do is settled on narrow rows; archives meet only their own lists.
    """
    found = files(spark, arc)
    digests = found.mapInArrow(_digest_rows, "file string, at long, id string, page_id long, digest binary, length long")
    rows = written(digests.where(F.col("length") >= least).select("digest", "file", "at", "id", "page_id"), "digests")
    top = rows.groupBy("digest").agg(F.max(F.struct("page_id", "id")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(top.select("digest", "n", F.col("best.id").alias("of"), F.col("best.page_id").alias("of_page")), "responses")
    repeats = hot_join(rows.select("digest", "file", "at", "id"), best, ["digest"]).where("id <> of")
    revisits = repeats.groupBy("file").agg(F.collect_list(F.struct("at", "of", "of_page")).alias("revisits"))
    _write(found.join(revisits, "file", "left").select("file", "content", "revisits").mapInArrow(_warc_rows, "record binary"), warc, WARC_END)


def warc_records(data: bytes):
    """(headers by name in lower case, block) of each whole record of a WARC file; one that is cut short is left out."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        if (end := data.find(b"\r\n\r\n", at)) < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in data[at:end].split(b"\r\n")[1:])}
        length = head.get(b"content-length", b"")
        if not length.isdigit():
            at += 5
            continue
        if end + 4 + int(length) > len(data):
            return
        yield head, data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)


READ = "id string, type string, uri string, page_id long, payload_bytes long, payload_digest string, of string, refers_to long"


def _read_rows(batches):
    for batch in batches:
        out: dict[str, list] = {x.split()[0]: [] for x in READ.split(", ")}
        for content in batch["content"]:
            for head, block in warc_records(unpacked(content.as_py())):
                kind = head[b"warc-type"]
                if kind not in (b"response", b"revisit"):
                    continue
                http, payload = split_http(block)
                digest = base64.b32decode(head[b"warc-payload-digest"].removeprefix(b"sha1:"))
                if kind == b"response" and hashlib.sha1(payload).digest() != digest:
                    raise ValueError(f"damaged record {head[b'warc-record-id']!r}")
                own = head.get(PAYLOAD_LENGTH.lower())
                length = len(payload) if kind == b"response" else int(own) if own else _number(http, b"content-length")
                row = (head[b"warc-record-id"].strip(b"<>").decode(), kind.decode(), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), _page_id(http), length, digest.hex(), head.get(b"warc-refers-to", b"").strip(b"<>").decode() or None, int(page) if (page := head.get(REFERS_TO_PAGE.lower())) else None)
                for k, v in zip(out, row):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("page_id", "payload_bytes", "refers_to") else pa.string()) for k, v in out.items()], list(out))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of the WARC files under path: id, type, uri, page_id, payload_bytes, payload_digest
    (hex SHA-1), of (the id that a revisit refers to), refers_to (the page id of that, if the archive tells)."""
    return files(spark, path).mapInArrow(_read_rows, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html; other columns are ignored) as ARC files, converted to WARC and read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to (page_id of the response), uri, record_id.

    A null html is an empty payload, a null url is "-", blanks in a url are percent-encoded, a null page_id stays null
    and repeated rows become records of their own. An empty table gives no records.
    """
    spark = pages.sparkSession
    at = own_path(spark, "warc")
    write_arc(pages, f"{at}/arc")
    convert(spark, f"{at}/arc", f"{at}/warc")
    read = read_warc(spark, f"{at}/warc")
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "uri", F.col("id").alias("record_id"))
