"""Archives: legacy ARC files are parsed and rewritten as WARC records.

An ARC file opens with a version block that names the fields of its header lines
(five in version 1, ten in version 2).  Each record is a header line, as many bytes
as its last field declares, and a newline.  The converter splits the bytes into
HTTP header and payload and makes what WARC wants: an identifier from the record's
place and content, an ISO date from the 14 digits, the record type, and digests.
A record without an HTTP header (a DNS answer, a bare file) becomes a resource,
whose payload is all of it.

Records with equal payloads are stored once: the one with the largest key, then file
and place, is stored, the others are revisits that refer to it.  Each record is a gzip
member of its own, so readers can seek; members are written in chunks of CHUNK_BYTES,
CHUNKS of them a file, by Spark's text writer, so they lie wherever Spark's paths do.
A member ends with the high byte of its length, which is zero: chunks are written
without that byte, and the line separator, a zero byte, puts it back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import bloom
from gridlark.llm.stores import Scratch, shared_dir

#: The header fields of the two versions, as their version blocks name them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes of one ARC file that a task makes; bytes of compressed records written at once (or one larger record), and how many times that a WARC file holds; bytes of a member at most, before compression.
ARC_BYTES, CHUNK_BYTES, CHUNKS, MEMBER_BYTES = 2 << 20, 4 << 20, 8, 8 << 20
#: Rows that a reader hands on at once.
ROWS = 1000
ARC_SCHEMA = "name string, content binary"
RECORD_SCHEMA = "arc string, place long, key long, url string, ip string, date string, mime string, http binary, payload binary, digest string"  # http is null where there is no HTTP header, and ends with its blank line


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe_url(url: str | None) -> str:
    """Header lines are split at spaces: blanks and control characters are percent-encoded, a missing URL is a dash."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  \s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "-"


def arc_record(version: int, url: str | None, key: int | None, payload: bytes, name: str, offset: int, date: str = "20240101000000", ip: str = "0.0.0.0") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{'' if key is None else f'X-Key: {key}'}\r\n".replace("\r\n\r\n", "\r\n").encode() + b"\r\n"
    block = http + payload
    fields = [_safe_url(url), ip, date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 gridlark\n{FIELDS[version]}\n\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_files(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", text_col: str = "html", arc_bytes: int = ARC_BYTES) -> DataFrame:
    """Renders pages as legacy archives (name, content), of both versions in turn. A null text is an empty payload."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, bytearray()

        def done():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(held)], pa.binary())], ["name", "content"])

        for batch in batches:
            for key, url, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not held:
                    version, name = 1 + number % 2, f"pages-{part:06d}-{number:06d}.arc"
                    held += arc_head(version, name)
                held += arc_record(version, url, key, (text or "").encode(), name, len(held))
                if len(held) >= arc_bytes:
                    yield done()
                    number, held = number + 1, bytearray()
        if held:
            yield done()

    return pages.select(F.col(key_col).cast("long"), F.col(url_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, ARC_SCHEMA)


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record after the version block. Raises ValueError at a broken header or length."""
    at, names = 0, None
    while at < len(content):
        if content[at : at + 1] == b"\n":  # files differ in how many newlines stand between records
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if not parts[-1].isdigit() or end < 0 or end + 1 + int(parts[-1]) > len(content):
            raise ValueError(f"broken ARC header at byte {at}: {line[:80]!r}")
        block = content[end + 1 : end + 1 + int(parts[-1])]
        if names is None:
            lines = block.decode("utf-8", "replace").split("\n")
            names = lines[1].split(" ")
        else:
            if len(parts) > len(names):  # a type with blanks: the fields around it have none
                spare = len(parts) - len(names)
                parts = [*parts[:3], " ".join(parts[3 : 4 + spare]), *parts[4 + spare :]]
            yield at, dict(zip(names, parts)), block
        at = end + 1 + int(line.rsplit(" ", 1)[1])


def http_part(block: bytes) -> bytes | None:
    """The HTTP header that opens a block, with the blank line that ends it (all of it if none does); None if there is none."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, n) for at, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if at >= 0]
    at, n = min(ends, default=(len(block), 0))
    return block[: at + n]


def records(files: DataFrame) -> DataFrame:
    """Parses ARC files (name, content): one row per record, with HTTP header and payload parted and the payload's digest. Names tell files apart."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = []
                for at, f, block in parse_arc(content):
                    http = http_part(block)
                    payload = block[len(http or b"") :]
                    key = re.search(rb"(?im)^X-Key: (-?\d+)", http or b"")
                    rows.append((name, at, int(key[1]) if key else None, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], http, payload, digest(payload)))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in RECORD_SCHEMA.split(", ")])

    return files.mapInArrow(run, RECORD_SCHEMA)


def _iso(date: str) -> str:
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _ident(arc: str, place: int, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{place}#{sha}')}>"


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(arc: str, place: int, key, url: str, ip: str, date: str, mime: str, http: bytes | None, payload: bytes, sha: str, of: tuple | None = None) -> bytes:
    """A response, or without an HTTP header a resource; where `of` (file, place, key, URL, date) names the record with the same payload, a revisit of it, without the payload."""
    head = [
        ("WARC-Type", "revisit" if of else "resource" if http is None else "response"),
        ("WARC-Record-ID", _ident(arc, place, sha)),
        ("WARC-Date", _iso(date)),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", ip),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Content-Type", (mime or "application/octet-stream") if http is None else "application/http;msgtype=response"),
        ("X-Payload-Length", len(payload)),
    ]
    if key is not None:
        head.append(("X-Key", key))
    if of:
        to_arc, to_place, to_key, to_url, to_date = of
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _ident(to_arc, to_place, sha)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", _iso(to_date))]
        head += [("X-Refers-To-Key", to_key)] if to_key is not None else []
    return _record(head, (http or b"") + (b"" if of else payload))


def _members(record: bytes) -> bytes:
    """A record as a gzip member, or several where it is long: each ends with a zero byte."""
    return b"".join(gzip.compress(record[i : i + MEMBER_BYTES], 6, mtime=0) for i in range(0, len(record), MEMBER_BYTES))


def convert(files: DataFrame, path: str) -> None:
    """Writes the records of ARC files (name, content) to WARC files under path.

    Which record of a payload is stored is decided over keys, places and digests alone.
    Only records that may be revisits are then joined, by file and place, so that no
    common payload meets in one task; the others are written as they were parsed.
    """
    work = Scratch(files.sparkSession, "archives")
    parsed = work.stored(records(files), "parsed")
    known = parsed.select("digest", "arc", "place", "key", "url", "date")
    best = F.max(F.struct(F.col("key").isNotNull().alias("keyed"), "key", "arc", "place", "url", "date")).alias("b")
    last = work.stored(known.groupBy("digest").agg(F.count("*").alias("n"), best).filter("n > 1").select("digest", "b"), "last")
    again = known.select("digest", "arc", "place").join(last, "digest").filter("arc <> b.arc or place <> b.place")
    again = work.stored(again.select("arc", "place", F.struct("b.arc", "b.place", "b.key", "b.url", "b.date").alias("of")), "revisits")
    hashed = F.xxhash64("arc", "place")
    may = bloom.passes(bloom.built(again.select(hashed)), hashed)
    rows = parsed.filter(~may).withColumn("of", F.lit(None).cast(again.schema["of"].dataType))
    rows = rows.union(parsed.filter(may).join(again, ["arc", "place"], "left").select(rows.columns))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                *r, of = (c[i].as_py() for c in batch.columns)
                if not held:
                    said = b"software: gridlark\r\nformat: WARC File Format 1.1\r\n"
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _ident(r[0], r[1], "info")), ("WARC-Date", _iso(r[5])), ("Content-Type", "application/warc-fields")]
                    held.append(_members(_record(head, said)))
                held.append(_members(warc_record(*r, tuple(of.values()) if of else None)))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", CHUNKS).option("lineSep", "\0").text(path)
    work.drop()


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if not line.strip(b"\r\n\0"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8").partition(": ")
            head[name] = value
        n = int(head["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"{head.get('WARC-Record-ID')} is cut off")
        yield head, block


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under path, but for warcinfo; digests and lengths of stored payloads are checked."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id"]

    def run(batches):
        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for head, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(batch.column(0)[i].as_py()))):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    sha, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind != "revisit":
                        payload = block[len(http_part(block) or b"") :] if kind == "response" else block
                        if digest(payload) != sha or len(payload) != n:
                            raise ValueError(f"digest of {head['WARC-Record-ID']} does not match")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
                    rows.append((number("X-Key"), head["WARC-Target-URI"], n, sha, kind, number("X-Refers-To-Key"), head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                    if len(rows) == ROWS:
                        yield done(rows)
                        rows = []
                if rows:
                    yield done(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string")


def archived(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Pages as ARC files, converted to WARC files in the shared folder and read back: a row per page.

    A null text is an empty payload; equal payloads of any length are stored once, by
    the page with the largest key, the others revisit it; of rows equal in key and
    payload one is stored.  A null key comes before all others.  Other columns
    are ignored.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    convert(arc_files(pages, key_col, url_col, text_col), path)
    return read_back(spark, path)
