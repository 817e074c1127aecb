import base64
import gzip
import hashlib
import io
import json
import os
import struct
import zipfile

import pytest

from barograph.llm.common import shared_path
from barograph.llm.warc_zip import RECORDS, locate_records, members, op3_warc_zip, read_records, with_revisits, write_archives


def want(pages, least=0):
    first = {}
    for p in pages:
        body = (p.html or "").encode()
        if len(body) >= least and p.page_id is not None:
            first[body] = min(p.page_id, first.get(body, p.page_id))
    out = []
    for p in pages:
        body = (p.html or "").encode()
        refers = first.get(body) if len(body) >= least and p.page_id != first.get(body) else None
        out.append((p.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sorted((tuple(r) for r in op3_warc_zip(spark, sf).collect()), key=str) == want(pages)


def test_edge_cases(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c d\n", None), (4, "x", ""), (5, "é", "é\r\n\r\nx" * 3), (None, "n", "same"), (6, "u", "z" * 2_000_000), (6, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame([(*r, 7, "q") for r in rows], "page_id long, url string, html string, sha1 int, path string")
    for least in (0, 1):
        archives = write_archives(with_revisits(pages, least), shared_path(spark, "warc"), archive_bytes=100)
        got = read_records(locate_records(archives)).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(pages.collect(), least)
        assert next(bytes(r.payload) for r in got if r.page_id == 5) == rows[4][2].encode()
    none = write_archives(with_revisits(pages.limit(0)), shared_path(spark, "warc"))
    assert read_records(locate_records(none)).count() == 0
    assert [f.name for f in read_records(locate_records(archives)).schema] == [x.split()[0] for x in RECORDS.split(", ")]


def test_packages_of_other_writers(spark):
    body = b"<p>hi</p>"
    sha1 = hashlib.sha1(body).digest()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    rows = [
        ("warcinfo", "urn:uuid:1", "application/warc-fields", [], b"software: other\r\n"),
        ("request", "urn:uuid:2", "application/http; msgtype=request", [], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ("response", "urn:uuid:3", "application/http; msgtype=response", ["WARC-Payload-Digest: sha1:" + base64.b32encode(sha1).decode(), "WARC-Target-URI: http://a/"], http),
        ("response", "urn:uuid:4", "application/http", ["warc-payload-digest: sha256:abc"], http),
        ("resource", "urn:uuid:5", "text/plain", [], b"plain\r\n\r\ntext"),
        ("metadata", "urn:uuid:6", "application/warc-fields", ["X-Long: one", " two"], b""),
        ("revisit", "urn:uuid:7", "application/http", ["WARC-Refers-To: <urn:uuid:3>"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
    ]
    data, index = b"", ""
    for kind, name, content, more, block in rows:
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", f"Content-Length: {len(block)}", *more]
        raw = gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        index += "com,a)/ 20200101000000 " + json.dumps({"offset": str(len(data)), "length": str(len(raw)), "filename": "data.warc.gz"}) + "\n"
        data += raw
    folder = shared_path(spark, "foreign").removeprefix("file://")
    os.makedirs(folder)
    with zipfile.ZipFile(f"{folder}/other.wacz", "w") as z:
        z.writestr("archive/data.warc.gz", data)
        z.writestr("indexes/index.cdxj", index, zipfile.ZIP_DEFLATED)
        z.writestr("datapackage.json", "{}")
    ranges = locate_records(spark.createDataFrame([(f"file://{folder}/other.wacz",), (None,)], "path string"))
    got = {r.record_id: r for r in read_records(ranges).collect()}
    assert {k: r.record_type for k, r in got.items()} == {name: kind for kind, name, *_ in rows}
    assert all(r.page_id is None and r.refers_to is None for r in got.values())
    assert bytes(got["urn:uuid:3"].payload) == body == bytes(got["urn:uuid:4"].payload) and got["urn:uuid:3"].url == "http://a/"
    assert got["urn:uuid:3"].payload_digest == base64.b32encode(sha1).decode() and got["urn:uuid:4"].payload_digest == "abc"
    assert bytes(got["urn:uuid:5"].payload) == b"plain\r\n\r\ntext" and got["urn:uuid:6"].payload_bytes == 0
    last = got["urn:uuid:7"]
    assert (last.payload, last.payload_bytes, last.refers_to_id) == (None, None, "urn:uuid:3")


@pytest.mark.parametrize("wide", [False, True])
def test_members_of_any_zip(wide):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.comment = b"a PK\x05\x06 in the comment" + b"." * 30
        for k in range(70_000 if wide else 3):
            z.writestr(zipfile.ZipInfo(f"é{k}"), b"%d" % k)
    data = raw.getvalue()
    held = members(io.BytesIO(data), len(data))
    assert [m.name for m in held] == [f"é{k}" for k in range(len(held))] and len(held) == (70_000 if wide else 3)
    assert all(data[m.start : m.start + m.size] == b"%d" % k for k, m in enumerate(held))


def test_zip64_sizes_and_damage():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z, z.open("archive/data.warc.gz", "w", force_zip64=True) as f:
        f.write(b"abc")
    data = bytearray(raw.getvalue())
    at = data.rfind(b"PK\x01\x02")
    name = len("archive/data.warc.gz")
    local = struct.unpack_from("<I", data, at + 42)[0]
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, local)
    entry = data[at : at + 46 + name]
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, len(extra))
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry) + len(extra), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry) + len(extra), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = bytes(data[:at]) + bytes(entry) + extra + end64 + locator + end
    (m,) = members(io.BytesIO(wide), len(wide))
    assert (m.size, wide[m.start : m.start + 3]) == (3, b"abc")
    with pytest.raises(ValueError):
        members(io.BytesIO(b"no zip" * 9), 54)
