import base64
import gzip
import hashlib
import random
import zlib

import pytest

from textloom.llm import warc

SCHEMA = "page_id long, url string, html string, key string, digest string, first long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/x y?q=a%20b", "<p>one</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://c/\nd", "line\n\r\n\r\nWARC/1.1\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 3\nabc"),
    (6, "http://ü/", "größe \U0001f600 " * 2000),
    (7, "http://e/", "<p>one</p>"),
    (8, "http://f/", "\n\n"),
    (9, "http://g/", "filedesc://x\r\n\r\n\r\n\r\nHTTP/1.1 200"),
    (11, "http://h/", "größe \U0001f600 " * 2000),
    (13, "filedesc:me", "1 0 x"),
    (14, "%66iledesc:me", "1 0 x y"),
    (12, "http://i/", "\x00\x01﻿"),
]


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        one = first.get(body, page)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if one == page else "revisit", None if one == page else one))
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, rows_of, version, least):
    found = warc.archive_round_trip(table(spark, PAGES), least, version)
    assert rows_of(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(PAGES, least)
    assert all(r.record_id.startswith("<urn:uuid:") and r.date == "2024-01-01T00:00:00Z" for r in found.collect())
    assert len({r.record_id for r in found.collect()}) == len(PAGES)


def test_rows_that_repeat_and_null_ids(spark, rows_of):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (None, "v", "a"), (None, "v", "b")]
    found = rows_of(warc.archive_round_trip(table(spark, rows)), "page_id", "record_type", "refers_to")
    assert found == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=repr)
    assert rows_of(warc.archive_round_trip(table(spark, []))) == []


def test_reruns_give_the_same_identifiers(spark, rows_of):
    a, b = (rows_of(warc.archive_round_trip(table(spark, PAGES)), "page_id", "record_id") for _ in range(2))
    assert a == b


def test_arc_headers_by_version():
    for version in (1, 2):
        data = warc.arc_header(version, "f", "2020") + b"\n" + warc.arc_record(version, "http://a/b c", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\n") + b"\n\n"
        (r,) = warc.read_arc(data)
        assert (r.url, r.date, r.mime, warc.payload_of(r.content)) == ("http://a/b c", "20200102030405", "text/html", b"body\n")
        said = lambda d: [r if isinstance(r, str) else r.url for r in warc.read_arc(d)]
        assert said(data[:-6]) == ["record at line 2: ends before its declared length"]
        # A bad line is reported, and so are those after it up to the next header.
        bad = said(data.replace(b"http://a/b%20c", b"http://a/b c") + warc.arc_record(version, "http://z", "2020", "text/html", b"z"))
        assert len(bad) > 1 and bad[-1] == "http://z" and all("no header" in m for m in bad[:-1])
        assert said(gzip.compress(data)[:-20])[-1].startswith("after line") or said(gzip.compress(data)[:-20])[-1].startswith("record at")
        latin = warc.arc_record(version, "http://x", "2020", "text/html", b"q").replace(b"http://x", b"http://\xfc")
        assert said(data + latin)[-1] == "http://ü"
    assert list(warc.read_arc(b"http://a 0.0.0.0 2020 text/html 1\na"))[0] == "line 1: no header of an ARC record"
    assert list(warc.read_arc(b"filedesc://f 0.0.0.0 2020 text/plain 6\n7 0 x\n")) == ["line 1: unknown ARC version"]


def test_fields_of_records(spark):
    """The fields that the format asks for, and what isn't an HTTP message."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    made = [warc.convert(warc.ArcRecord("http://a", "1.2.3.4", "2020", "text/html", http + b"abc"), 1, None), warc.convert(warc.ArcRecord("http://b", "1.2.3.4", "2021", "text/html", http + b"abc"), 2, (1, "http://a", "2020")), warc.convert(warc.ArcRecord("dns:a", "1.2.3.4", "2020", "text/dns", b"20200101\na. 1 IN A 1.2.3.4"), 3, None)]
    (first, block), (again, head), (dns, _) = [next(warc.read_warc(m)) for m in made]
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert (first["warc-type"], first["warc-payload-digest"], first["warc-block-digest"], block) == ("response", sha(b"abc"), sha(http + b"abc"), http + b"abc")
    assert (again["warc-type"], again["warc-refers-to"], again["warc-refers-to-target-uri"], again["warc-refers-to-date"]) == ("revisit", first["warc-record-id"], "http://a", "2020-01-01T00:00:00Z")
    assert (head, again["warc-block-digest"], again["warc-payload-digest"]) == (http, sha(http), sha(b"abc"))
    assert (dns["warc-type"], dns["content-type"]) == ("resource", "text/dns")


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """Each record is a gzip member of its own; files begin with a record that describes them; damage is reported."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://{i}", "".join(map(chr, random.Random(i).choices(range(0x4E00, 0x9FFF), k=2000)))) for i in range(30)]
    warc.write_arc(table(spark, rows), f"{tmp_path}/arc")
    files = [p for p in (tmp_path / "arc").iterdir() if p.name.startswith("part")]
    assert len(files) >= 8 and all(p.stat().st_size < 40_000 for p in files)
    (tmp_path / "arc/part-bad.txt").write_bytes(b"nonsense\n\x1f\x8b")
    errors = warc.convert_archives(spark, f"{tmp_path}/arc", f"{tmp_path}/warc").collect()
    assert {r.error for r in errors} == {"line 1: no header of an ARC record", "line 2: no header of an ARC record"}
    for p in (tmp_path / "warc").iterdir():
        if p.name.startswith("part"):
            first, *rest = warc.read_warc(p.read_bytes())
            assert first[0]["warc-type"] == "warcinfo"
            data, starts = p.read_bytes(), 0
            while data:  # one member after another
                d = zlib.decompressobj(31)
                starts += d.decompress(data)[:5] == b"WARC/"
                data = d.unused_data
            assert starts == 1 + len(rest)
    assert sorted(r.page_id for r in warc.warc_records(spark, f"{tmp_path}/warc").collect()) == list(range(30))


def test_dates_of_any_length():
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z" and warc.warc_date("20200203040506") == "2020-02-03T04:05:06Z"


def test_damaged_warc_is_an_error():
    data = warc.convert(warc.ArcRecord("u", "0.0.0.0", "2020", "text/html", b"abc"), 1, None)
    ((fields, block),) = warc.read_warc(data + b"\r\n\r\n")
    assert block == b"abc" and fields["warc-type"] == "resource"
    for bad in (b"x" + data, data[:-1]):
        with pytest.raises(ValueError):
            list(warc.read_warc(bad))


def test_archives_of_other_writers(spark, tmp_path):
    """Without own fields, with a digest of another kind, of a resource, damaged in the middle, and with a wrong digest."""
    def record(fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in fields)
        return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody"
    plain = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "http://a/")], http)
    other = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:b>"), ("WARC-Payload-Digest", "sha256:00ff")], http)
    wrong = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:c>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], http)
    asset = record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:d>")], b"bytes")
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:e>")], b"GET /")
    (tmp_path / "good.warc").write_bytes(plain + other + wrong + asset + request)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(other)[:-20])
    rows = warc.warc_records(spark, str(tmp_path)).collect()
    by_id = {r.record_id: r for r in rows if r.record_id and not (r.record_id == "<urn:a>" and r.error)}
    digest = warc.digest(b"body")
    assert (by_id["<urn:a>"].payload_digest, by_id["<urn:a>"].payload_bytes, by_id["<urn:a>"].page_id) == (digest, 4, None)
    assert by_id["<urn:b>"].error is None and by_id["<urn:c>"].error and by_id["<urn:d>"].payload_bytes == 5 and by_id["<urn:e>"].record_type == "request"
    assert sum(r.record_id == "<urn:a>" for r in rows) == 2 and sum(r.record_type is None for r in rows) == 1


def test_contents_on_their_way_are_packed(spark, tmp_path):
    """What is shuffled for the records' roles is compressed, and the same bytes when unpacked."""
    rows = [(i, f"http://{i}", "word " * 50 * i) for i in range(1, 20)] + [(20, "http://20", None)]
    warc.write_arc(table(spark, rows), f"{tmp_path}/arc")
    plain, packed = ({r.key: bytes(r.content) for r in warc.arc_records(spark, f"{tmp_path}/arc", **how).collect()} for how in ({}, {"packed": True}))
    assert {k: zlib.decompress(c) for k, c in packed.items()} == plain
    assert 4 * sum(map(len, packed.values())) < sum(map(len, plain.values()))
