"""WARC: legacy ARC archives are converted to WARC, with records of repeated payloads as revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import small_batches
from textloom.session import fresh_path, materialise

#: Fixed values of the formats.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_BREAK = "\r\n\r\n"
#: The namespace of record identifiers, which are derived from what a record holds, so that reruns give the same.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "textloom:warc")
#: Bytes of an archive file, about; a larger record is a file of its own.
FILE_BYTES = 32 << 20
#: The level at which contents are compressed on their way between tasks.
PACKED = 3
#: A gzip member that holds nothing. It may stand between members, and the writer needs something to end a row with.
NOTHING = gzip.compress(b"", mtime=0)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 textloom\n{'URL IP-address Archive-date Content-type' + (' Result-code Checksum Location Offset Filename' if version == 2 else '')} Archive-length\n".encode()
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, content: bytes) -> bytes:
    """A URL record. Its header line is split at spaces, so those in the URL are escaped."""
    more = " 200 - - 0 -" if version == 2 else ""
    url = url.replace("%", "%25").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
    if url.startswith("filedesc:"):  # the mark of a version block
        url = f"%66{url[1:]}"
    return f"{url or '-'} 0.0.0.0 {date} {mime}{more} {len(content)}\n".encode() + content


@dataclass(slots=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


def _open(data: bytes) -> io.BufferedIOBase:
    """A file's bytes as a stream, unpacked member by member where they are compressed."""
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def _decoded(line: bytes) -> str:
    """UTF-8, or Latin-1 where it isn't that: old crawlers wrote addresses as they came."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def read_arc(data: bytes) -> Iterator[ArcRecord | str]:
    """The records of an ARC file, in a stream; what is wrong with a part of it comes as a message in its place.

    A version block says which header fields there are; others may follow and hold from there on. A record's content is
    as long as its header line declares, whatever it holds; blank lines between records are skipped. A line that is no
    header is reported and left out, and reading goes on with the next line. Content that ends early is reported, and
    ends the file, as does data that can't be unpacked.
    """
    stream, version, at = _open(data), 0, 0
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            at += 1
            fields = _decoded(line).rstrip("\r\n").split(" ")
            block = fields[0].startswith("filedesc:")
            # A version block's own line has the fields of the version that its content names; the length is the last.
            names = ARC_FIELDS.get(version)
            if not fields[-1].isdecimal() or not (block or (names and len(fields) == len(names))):
                yield f"line {at}: no header of an ARC record"
                continue
            content = stream.read(int(fields[-1]))
            if len(content) < int(fields[-1]):
                yield f"record at line {at}: ends before its declared length"
                return
            if block:
                said = content.split(b" ", 1)[0]
                version = int(said) if said.isdigit() else 0
                if version not in ARC_FIELDS:
                    yield f"line {at}: unknown ARC version"
                continue
            header = dict(zip(names, fields))
            url = header["url"].removeprefix("%66iledesc:")
            url = (header["url"] if url == header["url"] else f"filedesc:{url}").replace("%0D", "\r").replace("%0A", "\n").replace("%20", " ").replace("%25", "%")
            yield ArcRecord("" if url == "-" else url, header["ip"], header["date"], header["mime"], content)
    except (EOFError, OSError, zlib.error) as e:
        yield f"after line {at}: {type(e).__name__}"


def payload_of(content: bytes) -> bytes:
    """The body of an archived HTTP message, or all of what is none."""
    head, found, body = content.partition(b"\r\n\r\n")
    return body if found and head[:5] == b"HTTP/" else content


# --- WARC


def warc_date(arc_date: str) -> str:
    """An ARC date, YYYYMMDDhhmmss or a leading part of it, as WARC writes it."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the break that ends it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def _id(key: int | None, url: str, date: str, sum_: str) -> str:
    return record_id(str(key), url, date, sum_)


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def convert(arc: ArcRecord, key: int | None, first: tuple[int, str, str] | None) -> bytes:
    """The WARC record of an ARC record. first: key, URL and ARC date of the record whose payload it repeats, or None.

    ARC has no identifiers and digests: both are made from the content. A revisit keeps the HTTP head, not the payload.
    What is no HTTP message, such as a DNS answer, is a resource of its own type.
    """
    payload = payload_of(arc.content)
    sum_, http = digest(payload), arc.content[:5] == b"HTTP/"
    block = arc.content if first is None else arc.content[: len(arc.content) - len(payload)]
    fields = [
        ("WARC-Type", "revisit" if first else "response" if http else "resource"),
        ("WARC-Record-ID", _id(key, arc.url, arc.date, sum_)),
        ("WARC-Date", warc_date(arc.date)),
        ("WARC-Target-URI", _uri(arc.url)),
        ("WARC-IP-Address", arc.ip),
        ("WARC-Payload-Digest", f"sha1:{sum_}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else arc.mime),
        # Extension fields: the key of the source row, and the length of what a revisit leaves out.
        ("X-Source-Key", "" if key is None else str(key)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if first is None:
        return warc_record(fields, block)
    to, url, date = first
    refers = [("WARC-Refers-To", _id(to, url, date, sum_)), ("WARC-Refers-To-Target-URI", _uri(url)), ("WARC-Refers-To-Date", warc_date(date))]
    return warc_record([*fields, ("WARC-Profile", REVISIT_PROFILE), *refers, ("X-Refers-To-Key", str(to))], block)


def warcinfo() -> bytes:
    """The record that a WARC file begins with."""
    body = b"software: textloom\r\nformat: WARC File Format 1.1\r\n"
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", digest(body))), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], body)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, in a stream; blocks are as long as declared."""
    stream = _open(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if line[:5] != b"WARC/":
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = _decoded(line).partition(":")
            fields[k.lower()] = v.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record ends before its declared length")
        yield fields, block


# --- On Spark


def _packed(records: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], head: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to whole files of about FILE_BYTES: the head and each record are gzip members of their own."""
    squeeze = lambda x: gzip.compress(x, 6, mtime=0)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [squeeze(head)], 0
        for record in records(parts):
            member = squeeze(record)
            if size and size + len(member) > FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["record"])
                members, size = [squeeze(head)], 0
            members.append(member)
            size += len(member)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["record"])

    return run


def _write(rows: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], head: bytes, path: str) -> None:
    """The records of rows as compressed archive files: a row of the writer is a whole file, ended by an empty member."""
    files = rows.mapInArrow(_packed(records, head), "record binary").select(F.col("record").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)


def write_arc(pages: DataFrame, path: str, version: int = 1, key_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "20240101000000") -> None:
    """pages as ARC files: a URL record with an HTTP response for each row, its key in a header field (null body: empty).

    Null keys and addresses are empty fields; repeated rows are repeated records; an empty table gives no files. Files
    are cut by their bytes, so large pages make more files, not larger ones.
    """
    small_batches(pages)

    def records(parts: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for part in parts:
            for key, url, body in zip(*(c.to_pylist() for c in part.columns)):
                body = (body or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                yield arc_record(version, url or "", date, "text/html", head + body) + b"\n"

    slim = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    _write(slim, records, arc_header(version, "pages", date) + b"\n", path)


def _key(content: bytes) -> int | None:
    found = content.partition(b"\r\n\r\n")[0].partition(b"X-Key: ")[2].split(b"\r\n")[0]
    return int(found) if found else None


_ARC = ["key", "digest", "size", "url", "ip", "date", "mime", "content", "error"]


def arc_records(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """The records of ARC files: key, digest, size (of the payload) and the record's parts; or error, what is wrong in a file.

    Files are read whole, up to the 2 GB that a row may have, and unpacked record by record. Damaged parts are rows with
    an error and nothing else. A folder without files gives no rows. packed: contents are compressed by zlib, for rows
    that are going to be shuffled.
    """

    def batch(rows: list[ArcRecord | str]) -> pa.RecordBatch:
        found = []
        for r in rows:
            if isinstance(r, str):
                found.append((None,) * 8 + (r,))
            else:
                payload = payload_of(r.content)
                found.append((_key(r.content), digest(payload), len(payload), r.url, r.ip, r.date, r.mime, zlib.compress(r.content, PACKED) if packed else r.content, None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=_ARC)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column(0):
                some, size = [], 0
                for r in read_arc(data.as_py()):
                    some.append(r)
                    size += 100 if isinstance(r, str) else len(r.content)
                    if size > 4 << 20:
                        yield batch(some)
                        some, size = [], 0
                if some:
                    yield batch(some)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key long, digest string, size long, url string, ip string, date string, mime string, content binary, error string")


def convert_archives(spark: SparkSession, source: str, target: str, least: int = 0) -> DataFrame:
    """ARC files below source to WARC files at target; returns what was wrong in them: (error, n).

    Of records with equal payloads of at least `least` bytes, that with the smallest key stays a response and the
    others become revisits of it; smaller payloads are all responses. Only digests, keys and addresses are compared between
    files. Records without a key come last and follow each other by URL.
    """
    small_batches(spark.range(0))
    small = materialise(arc_records(spark, source).select("key", "digest", "size", "url", "date", "error"), "digests")
    groups = small.filter((F.col("size") >= least) & F.col("error").isNull()).groupBy("digest")
    first = groups.agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url", "date"))).alias("first"), F.count("*").alias("n"))
    shared = first.filter("n > 1 and first is not null").select("digest", "first")
    # A payload that thousands share is one row here; its records aren't brought together.
    role = small.join(shared, "digest").filter("key is null or key <> first.key").select(F.col("key").alias("k"), F.col("digest").alias("d"), "first").distinct()
    records = arc_records(spark, source, packed=True).filter("error is null")
    joined = records.join(role, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for part in parts:
            for key, url, ip, date, mime, content, *one in zip(*(c.to_pylist() for c in part.columns)):
                yield convert(ArcRecord(url, ip, date, mime, zlib.decompress(content)), key, tuple(one) if one[0] is not None else None) + WARC_BREAK.encode()

    columns = joined.select("key", "url", "ip", "date", "mime", "content", "first.key", "first.url", "first.date").toDF("key", "url", "ip", "date", "mime", "content", "to", "to_url", "to_date")
    _write(columns, made, warcinfo() + WARC_BREAK.encode(), target)
    return small.filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def _described(fields: dict[str, str], block: bytes) -> tuple:
    """A row of warc_records() of a record by any writer; what only convert_archives() writes may be missing."""
    kind, number = fields.get("warc-type", "resource"), lambda c: int(fields[c]) if fields.get(c, "").lstrip("-").isdigit() else None
    declared, key, size, first, error = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("x-source-key"), number("x-payload-length"), None, None
    if kind == "revisit":
        first = number("x-refers-to-key")
    elif kind in ("response", "resource"):
        payload = payload_of(block) if kind == "response" or block[:5] == b"HTTP/" else block
        found = digest(payload)
        # Digests by another function, or written otherwise, aren't compared.
        if size not in (None, len(payload)) or declared is not None and len(declared) == len(found) and ":" not in declared and declared.upper() != found:
            error = f"{fields.get('warc-record-id')}: its payload and header disagree"
        declared, size = found, len(payload)
    return key, size, declared, kind, first, fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), error


def _all_records(data: bytes) -> Iterator[tuple]:
    """Rows of a file's records, and one with an error where it can't be read on."""
    try:
        for fields, block in read_warc(data):
            if fields.get("warc-type") not in ("warcinfo", "metadata"):
                yield _described(fields, block)
    except (ValueError, KeyError, EOFError, OSError, zlib.error) as damage:
        yield (None,) * 8 + (f"{type(damage).__name__}: {damage}",)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, date, url and error.

    Files may be of any writer: keys are those that convert_archives() writes, else null. A response's digest and length are those
    of its payload; error says where its header has others, and a row with nothing else where a file is damaged and ends
    for the reader. Records that describe their file or others are left out. A folder without files gives no rows.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "url", "error"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column(0):
                rows = list(_all_records(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    small_batches(spark.range(0))
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, url string, error string")


def archive_round_trip(pages: DataFrame, least: int = 0, version: int = 1) -> DataFrame:
    """pages written as ARC files, converted to WARC and read back: a row for each page.

    A null html is an empty payload, a null url an empty one. Rows with the same page_id and payload are one record
    and its equals: all of them are responses if the page_id is the smallest. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, version)
    convert_archives(spark, arc, warc, least)
    return _sound(warc_records(spark, warc))


def _sound(records: DataFrame) -> DataFrame:
    """records, which have to be without errors: these archives have just been written."""
    told = F.raise_error(F.concat(F.lit("a record was written wrong: "), F.col("error")))
    return records.withColumn("record_type", F.when(F.col("error").isNotNull(), told).otherwise(F.col("record_type"))).drop("error")
