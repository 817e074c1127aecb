"""WARC records in ZIP packages: write them, find their members and indexes, and range-read records.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``, both stored without
further compression. The reader takes the end-of-archive records and the central directory (with their ZIP64
forms) from the file's end, and then reads only the index and the byte ranges of records; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import cut, shared_path, table

#: ZIP record marks (fixed values of the format).
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
#: The end record and the longest comment that can follow it.
TAIL = 22 + 65535
#: Ranges that lie this close together are read at once, up to READ bytes.
READ = 8 << 20
RECORD_ID = "urn:barograph:page:"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
RECORD_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string())])


def safe(url: str) -> str:
    """A URL without characters that end a header line or an index field."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or, if ``refers_to`` names a page, a revisit without the payload. ``digest``: base32 SHA-1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<{RECORD_ID}{'' if i is None else i}>"
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + safe(url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def header_fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on the one before."""
    fields, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def parse_record(raw: bytes) -> dict[str, Any]:
    """A record of RECORDS, of any type and from any writer.

    The payload is what follows the HTTP header, if the block is an HTTP message, or else the block; a revisit has none,
    and its size is that of its HTTP header or else null. A digest that the header doesn't name is computed. A
    payload that doesn't have the SHA-1 its header names raises an error. ``page_id`` and ``refers_to`` are numbers for
    records that write_archives named, and null for others; ``record_id`` and ``refers_to_id`` are the whole names.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header_fields(head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block, kind = rest[: int(fields["content-length"])], fields["warc-type"]
    payload, size = block, len(block)
    if block.startswith(b"HTTP/") or fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = header_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
        size = len(payload) if kind != "revisit" else int(said) if said.isdecimal() else None
    elif kind == "revisit":
        size = None
    named = fields.get("warc-payload-digest", "")
    digest = named.partition(":")[2] if ":" in named else named or None
    if kind != "revisit" and (not digest or named.lower().startswith("sha1:")):
        own = hashlib.sha1(payload).digest()
        if digest and digest.upper() != base64.b32encode(own).decode() and digest.lower() != own.hex():
            raise ValueError(f"{fields.get('warc-record-id')}: the payload is damaged")
        digest = base64.b32encode(own).decode()
    name = lambda key: fields[key].strip("<>") if key in fields else None
    number = lambda x: int(found[1]) if (found := re.fullmatch(RECORD_ID + r"(-?\d{1,19})", x or "")) else None
    own_id, other = name("warc-record-id"), name("warc-refers-to")
    return {"page_id": number(own_id), "url": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(other), "record_id": own_id, "refers_to_id": other}


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 5, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write rows (page_id, url, html, sha1 in hex, refers_to) as packages in ``folder``; returns path, bytes, records.

    Each task writes packages of about ``archive_bytes`` under names of its own. Only the packages of tasks that
    succeeded are listed, so that a repeated task adds files but no records. ``folder`` is a URI that pyarrow opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        done, file = [], None

        def close():
            file["member"].close()
            with file["zip"].open("indexes/index.cdxj", "w", force_zip64=True) as out:
                out.write("".join(sorted(file["index"])).encode("utf-8", "surrogatepass"))
            file["zip"].close()
            file["out"].close()
            done.append({"path": file["path"], "bytes": store.get_file_info(file["at"]).size, "records": len(file["index"])})

        for b in batches:
            for page, url, html, sha1, refers in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                if file is None:
                    name = f"part-{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{top}/{name}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    file = {"path": f"{folder}/{name}", "at": f"{top}/{name}", "out": out, "zip": package, "member": package.open("archive/data.warc.gz", "w", force_zip64=True), "offset": 0, "index": []}
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = gzip.compress(warc_record(page, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, date), level, mtime=0)
                file["member"].write(raw)
                file["index"].append(f"{safe(url or '-')} {re.sub(r'[^0-9]', '', date)} " + json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": file["offset"], "length": len(raw), "filename": "data.warc.gz", "page": page}) + "\n")
                file["offset"] += len(raw)
                if file["offset"] >= archive_bytes:
                    close()
                    file = None
        if file:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return cut(records.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "archives")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int
    packed: int
    size: int


def read_at(file: Any, start: int, length: int) -> bytes:
    file.seek(start)
    got = file.read(length)
    if len(got) < length:
        raise ValueError("the package ends too early")
    return got


def members(file: Any, size: int) -> list[Member]:
    """The central directory of a ZIP file of ``size`` bytes, ZIP64 or not, and where each member's bytes start."""
    low = max(0, size - TAIL)
    tail = read_at(file, low, size - low)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # bytes of the comment that look like the mark
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = read_at(file, low + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read_at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, out, p = read_at(file, start, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, whole, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, long = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # the 64-bit forms of those fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{long // 8}Q", directory, q + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + long
        head = read_at(file, local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        out.append(Member(name, method, local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, whole))
        p = stop + comment
    return out


def locate_records(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """Byte ranges of all records that the packages' indexes name: path, start, length.

    An index may be stored or deflated; archive members must be stored, or their records can't be read by range. A
    package without index or records gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows: list[dict] = []
                with store.open_input_file(at) as file:
                    held = members(file, store.get_file_info(at).size)
                    archives_ = {m.name.removeprefix("archive/"): m for m in held if m.name.startswith("archive/")}
                    for m in held:
                        if m.name.startswith("indexes/") and m.name.endswith(".cdxj"):
                            raw = read_at(file, m.start, m.packed)
                            for line in (zlib.decompress(raw, -15) if m.method == 8 else raw).decode("utf-8", "surrogatepass").split("\n")[:-1]:
                                entry = json.loads(line[line.index("{") :])
                                inside = archives_[entry["filename"]]
                                if inside.method:
                                    raise ValueError(f"{path}: {inside.name} is compressed")
                                rows.append({"path": path, "start": inside.start + int(entry["offset"]), "length": int(entry["length"])})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    return archives.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path")).mapInArrow(run, "path string, start long, length long")


def read_records(ranges: DataFrame) -> DataFrame:
    """The records at the given ranges (path, start, length): RECORDS.

    Blocks of READ bytes of a package are dealt to as many tasks as there are blocks, by the ranges' own lengths and not
    by the size of their rows; near ranges are read at once.
    """
    ranges = cut(ranges, "ranges")
    block = F.floor(F.col("start") / READ)
    tasks = max(1, ranges.select("path", block.alias("block")).distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run_, each = [], sorted(zip(*(b[c].to_pylist() for c in ("path", "start", "length")), strict=True))
            for k, (path, start, length) in enumerate(each):
                run_.append((start, length))
                last = k + 1 == len(each) or each[k + 1][0] != path or each[k + 1][1] + each[k + 1][2] - run_[0][0] > READ or each[k + 1][1] > start + length + 65536
                if last:
                    store, at = fs.FileSystem.from_uri(path)
                    with store.open_input_file(at) as file:
                        low = run_[0][0]
                        raw = read_at(file, low, max(s + n for s, n in run_) - low)
                    found = [parse_record(gzip.decompress(raw[s - low : s - low + n])) for s, n in run_]
                    yield pa.RecordBatch.from_pylist(found, RECORD_TYPES)
                    run_ = []

    return ranges.repartition(tasks, "path", block).sortWithinPartitions("path", "start").mapInArrow(run, RECORDS)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, refers_to of each page.

    Of pages with equal payloads of at least ``least_bytes`` the smallest id is the response and the others refer to
    it. A null html is an empty payload. Rows that repeat the smallest id are responses too; a null id refers to
    the smallest one, if there is one.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"))
    first = cut(hashed.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha1", "first"), "payloads")
    both = hashed.join(first, "sha1", "left")
    return both.select("page_id", "url", "html", "sha1", F.when((F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_archives(with_revisits(pages), shared_path(spark, "warc"))
    return read_records(locate_records(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
