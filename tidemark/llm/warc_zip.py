"""ZIP-packaged web archives: directories, stored members, indexes, and records by ranges.

A package is a ZIP file whose members are stored, not compressed: WARC files under
``archive/`` (.warc, or .warc.gz with a gzip member for each record) and CDXJ indexes under ``indexes/``. The reader goes from the end of
the file to the (ZIP64) central directory, from there to the members, and reads
single records by their offsets; nothing is extracted. What an index leaves out is found by going through the WARC file.
Files are read by seeking in them, in ranges that are dealt to tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, checkpointed, join_by_frequency, python_on_executors, table, utf8, written

#: Payloads below this many bytes are always stored in full.
REVISIT_FROM = 1000
#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 4 << 20
#: Bytes of a file that one task reads, and of a step through it.
RANGE_BYTES, STEP_BYTES = 64 << 20, 1 << 16
#: A function (offset, length) -> bytes over one file: a slice, a range request, a seek and read.
Ranges = Callable[[int, int], bytes]

# Fixed values of the ZIP format: signatures, and the id of the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
EXTRA64 = 1
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP -----------------------------------------------------------------


def pack(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members; with ``zip64`` sizes and offsets go to ZIP64 fields whatever they are."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        # version 45 knows ZIP64; flag 0x800 says that names are UTF-8; the date is 1 January 1980
        local64 = struct.pack("<HHQQ", EXTRA64, 16, n, n) if zip64 else b""
        size = FULL32 if zip64 else n
        head = struct.pack("<4s5H3L2H", LOCAL, 45 if zip64 else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local64)) + raw + local64
        extra = struct.pack("<HHQQQ", EXTRA64, 24, n, n, at) if zip64 else b""
        central.append(struct.pack("<4s6H3L5H2L", CENTRAL, 45, 45 if zip64 else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if zip64 else at) + raw + extra)
        out += [head, data]
        at += len(head) + n
    directory = b"".join(central)
    n = len(members)
    if zip64:
        tail = struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<4sLQL", LOCATOR64, 0, at + len(directory), 1)
        tail += struct.pack("<4s4H2LH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        tail = struct.pack("<4s4H2LH", END, 0, 0, n, n, len(directory), at, 0)
    return b"".join([*out, directory, tail])


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int  # offset of the local header

    def begins(self, read: Ranges) -> int:
        """Offset of the data. The local header's name and extra field may be longer than the directory's."""
        head = read(self.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header at {self.header}")
        n, extra = struct.unpack("<HH", head[26:30])
        return self.header + 30 + n + extra


def directory(read: Ranges, size: int) -> list[Member]:
    """The members that the central directory lists; an empty file has none, a file without an end record is an error."""
    if not size:
        return []
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(END, 0, end)  # the signature was part of the comment
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, at = struct.unpack("<HLL", tail[end + 10 : end + 20])
    locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
    if locator[:4] == LOCATOR64 and (n == FULL16 or length == FULL32 or at == FULL32):
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points at no record")
        n, length, at = struct.unpack("<QQQ", record[32:56])
    raw, p, out = read(at, length), 0, []
    for _ in range(n):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("the central directory is cut short")
        method, crc, packed, full = struct.unpack("<H4xLLL", raw[p + 10 : p + 28])
        names, extras, comment = struct.unpack("<HHH", raw[p + 28 : p + 34])
        header = struct.unpack("<L", raw[p + 42 : p + 46])[0]
        name, extra = raw[p + 46 : p + 46 + names], raw[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == EXTRA64:  # holds only the fields that are full, in this order
                wide = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                full = wide.pop(0) if full == FULL32 and wide else full
                packed = wide.pop(0) if packed == FULL32 and wide else packed
                header = wide.pop(0) if header == FULL32 and wide else header
            extra = extra[4 + k :]
        out.append(Member(name.decode("utf-8", "replace"), method, full, crc, header))
        p += 46 + names + extras + comment
    return out


# --- WARC ----------------------------------------------------------------


def clean(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if ord(c) > 31 else f"%{ord(c):02X}" for c in value)


def record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit (headers only) if it refers to another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{key}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {clean(url or 'urn:none')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def package(records: list[tuple[str, str | None, bytes]]) -> bytes:
    """Records (key, url, bytes) as a package with one WARC file and its index."""
    at, lines = 0, []
    for key, url, raw in records:
        lines.append(f"{clean(url or 'urn:none').replace(' ', '%20')} 20240101000000 " + json.dumps({"key": key, "filename": "data.warc", "offset": at, "length": len(raw)}))
        at += len(raw)
    lines.sort()
    return pack([("archive/data.warc", b"".join(r for _, _, r in records)), ("indexes/index.cdxj", "\n".join(lines).encode())])


def parse_record(raw: bytes) -> dict:
    """Headers (names in lower case), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in lines[1:]))
    block = rest[: int(fields.get("content-length", 0))]
    http: dict = {}
    if fields.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:]))
    return {"fields": fields, "http": http, "payload": block}


def intact(read: Ranges, m: Member) -> bool:
    """Whether the bytes of a stored member have the checksum that the directory gives."""
    at, end, crc = m.begins(read), 0, 0
    end = at + m.size
    while at < end:
        n = min(1 << 20, end - at)
        crc, at = zlib.crc32(read(at, n), crc), at + n
    return crc == m.crc


def step(read: Ranges, at: int, end: int, gzipped: bool) -> int:
    """Length of the record, or of the gzip member, that begins at ``at``."""
    if gzipped:
        inflate, n = zlib.decompressobj(31), 0
        while not inflate.eof:
            raw = read(at + n, min(STEP_BYTES, end - at - n))
            if not raw:
                raise ValueError(f"a gzip member at {at} is cut short")
            while raw and not inflate.eof:
                inflate.decompress(raw, STEP_BYTES)  # only its end is wanted
                n += len(raw) - len(inflate.unconsumed_tail) - len(inflate.unused_data)
                raw = b"" if inflate.eof else inflate.unconsumed_tail
        return n
    head = b""
    while b"\r\n\r\n" not in head:
        more = read(at + len(head), min(2048, end - at - len(head)))
        if not more:
            raise ValueError(f"a record at {at} is cut short")
        head += more
    head = head[: head.index(b"\r\n\r\n") + 4]
    size = [int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not head.startswith(b"WARC/") or not size:
        raise ValueError(f"no WARC record at {at}")
    return len(head) + size[0] + 4


@dataclass(frozen=True)
class Span:
    at: int
    length: int
    member: str
    gzipped: bool


def indexed(read: Ranges, members: list[Member], archives: dict[str, Member]) -> dict[str, dict[int, int]]:
    """Offsets and lengths of records by archive, from the indexes. An entry whose file name fits no archive is an error; one that fits several says nothing."""
    found: dict[str, dict[int, int]] = {k: {} for k in archives}
    by_name: dict[str, list[str]] = {}
    for k in archives:
        for name in {k, k.removeprefix("archive/"), k.rpartition("/")[2]}:
            by_name.setdefault(name, []).append(k)
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdxj.gz", ".cdx.gz")):
            raw = read(m.begins(read), m.size)
            for line in (gzip.decompress(raw) if m.name.endswith(".gz") else raw).splitlines():
                if b"{" not in line:
                    continue
                where = json.loads(line[line.index(b"{") :])
                if "filename" not in where or "offset" not in where or "length" not in where:
                    continue
                name = where["filename"]
                of = [name] if name in archives else by_name.get(name, [])
                if not of:
                    raise ValueError(f"{m.name} names {name}, which is not in the package")
                if len(of) == 1:
                    found[of[0]][int(where["offset"])] = int(where["length"])
    return found


def located(read: Ranges, size: int) -> Iterator[Span]:
    """Where the records of all archives lie: from the indexes, and by going through what they leave out. Archives and indexes that are compressed as ZIP members are an error."""
    members = directory(read, size)
    archives = {m.name: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    for m in members:
        if m.method and m.name.startswith(("archive/", "indexes/")) and m.size:
            raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    for k, known in indexed(read, members, archives).items():
        m, gzipped = archives[k], k.endswith(".gz")
        start = m.begins(read)
        at, end = start, start + m.size
        while at < end:
            n = known.get(at - start) or step(read, at, end, gzipped)
            if at + n > end:
                raise ValueError(f"a record of {k} at {at - start} is cut short")
            yield Span(at, n, k, gzipped)
            at += n


def spans(read: Ranges, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record, or of the gzip member that holds it."""
    for s in located(read, size):
        yield s.at, s.length


def records(read: Ranges, size: int) -> Iterator[dict]:
    """The records of a package in the order of their archives; see ``parse_record``."""
    for s in located(read, size):
        yield from read_span(read, s)


def read_span(read: Ranges, s: Span) -> Iterator[dict]:
    """The records in a span: one, or all that a gzip member holds."""
    raw = read(s.at, s.length)
    raw = gzip.decompress(raw) if s.gzipped else raw
    at, whole = 0, lambda at, n: raw[at : at + n]
    while at < len(raw):
        n = step(whole, at, len(raw), False) if s.gzipped else len(raw)
        yield parse_record(raw[at : at + n])
        at += n


def ranges(data: bytes) -> Ranges:
    view = memoryview(data)
    return lambda at, n: bytes(view[at : at + n])


@contextmanager
def opened(uri: str) -> Iterator[tuple[Ranges, int]]:
    """(ranges, size) of a file in a store that Arrow opens (local, S3, GCS, ABFS, HDFS): every range is a seek and a read."""
    if uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    elif "://" in uri:
        store, path = fs.FileSystem.from_uri(uri)
    else:
        store, path = fs.LocalFileSystem(), uri
    with store.open_input_file(path) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield read, f.size()


# --- operators -----------------------------------------------------------


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, url, payload, digest, refers_to): among equal payloads of at least REVISIT_FROM bytes the largest key is stored, the others refer to it.

    A null body is an empty payload; rows that repeat a key are records of their own, and those of the largest key are responses.
    A null key never is referred to. Digests that repeat are broadcast while they are few; beyond that pages are shuffled by digest, but for payloads that hold a large part of all pages.
    """
    payload = utf8(F.col(f"`{body}`"))
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= REVISIT_FROM)
    stats = checkpointed(large.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("stored")).filter("n > 1"))
    if stats.count() <= BROADCAST_ROWS:
        linked = rows.join(F.broadcast(stats.select(F.col("digest").alias("of"), "stored")), F.col("digest") == F.col("of"), "left")
    else:
        linked = join_by_frequency(rows, stats, "digest", "n", pages.count())
    return linked.select("key", "url", "payload", "digest", F.when(F.coalesce(F.col("key") != F.col("stored"), F.col("stored").isNotNull()), F.col("stored")).alias("refers_to"))


def write_packages(planned: DataFrame, label: str = "warc") -> DataFrame:
    """Write packages of about PACKAGE_BYTES to the shared folder, one a row, and return that table."""
    python_on_executors(planned.sparkSession)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for key, url, payload, digest, refers in zip(*[c.to_pylist() for c in b.columns]):
                raw = record(str(key), url, payload, digest, None if refers is None else str(refers))
                held.append((str(key), url, raw))
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], ["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], ["content"])

    return written(planned.mapInArrow(run, "content binary"), label)


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """Packages (.wacz, .zip) of up to 2 GB as values, in any store that Spark reads; see ``read_files`` for larger ones."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


READ = "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, digest_ok boolean, crc_ok boolean"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
_NAMES = [x.split()[0] for x in READ.split(", ")]


def _row(r: dict, crc_ok: bool | None) -> tuple:
    f = r["fields"]
    bare = lambda name: f[name].removeprefix("<urn:record:").removesuffix(">") if name in f else None
    algorithm, _, given = f.get("warc-payload-digest", "").partition(":")
    stored = None
    if algorithm == "sha1":
        stored = given.lower() if len(given) == 40 else base64.b32decode(given + "=" * (-len(given) % 8)).hex()
    head = (bare("warc-record-id"), f.get("warc-target-uri"), f.get("warc-type"))
    if f.get("warc-type") == "revisit":
        return *head, int(r["http"]["content-length"]) if "content-length" in r["http"] else None, stored, bare("warc-refers-to"), None, crc_ok
    got = hashlib.sha1(r["payload"]).hexdigest()
    return *head, len(r["payload"]), got, None, None if stored is None else got == stored, crc_ok


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], _NAMES)


def read_packages(packages: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of the packages, each read by its range.

    The digest of a record is computed from the payload that was read, digest_ok
    says that the header agrees (null: it gives no SHA-1); a revisit has digest and size of its headers (digest_ok null). crc_ok says that
    the archive has the checksum of the ZIP directory. Null and empty packages have no records; damaged ones are an error.
    """
    python_on_executors(packages.sparkSession)

    def rows(data: bytes) -> Iterator[tuple]:
        read, good = ranges(data), {}
        for s in located(read, len(data)):
            if s.member not in good:
                good[s.member] = next(intact(read, m) for m in directory(read, len(data)) if m.name == s.member)
            for r in read_span(read, s):
                yield _row(r, good[s.member])

    def run(batches):
        for b in batches:
            for data in b.column(0):
                yield from _batches(rows(data.as_py() or b""))

    return packages.select(F.col(f"`{content}`")).mapInArrow(run, READ)


def read_files(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """The records of packages that lie as files of any size (a path or pattern), with the columns of ``read_packages`` after the file's path.

    Spark lists the files. One task a file reads its directory and indexes; the records then are dealt in ranges of RANGE_BYTES,
    and read by seeking. Only with ``check`` are whole archives read for their checksums; else crc_ok is null.
    """
    python_on_executors(spark)
    files = spark.read.format("binaryFile").load(path).select("path")

    def find(batches):
        names = ["path", "at", "length", "member", "gzipped", "crc_ok"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        for b in batches:
            for uri in b.column(0).to_pylist():
                with opened(uri) as (read, size):
                    good = {m.name: intact(read, m) for m in directory(read, size) if m.name.startswith("archive/")} if check else {}
                    found = [(uri, s.at, s.length, s.member, s.gzipped, good.get(s.member)) for s in located(read, size)]
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[k : k + 10_000]), kinds)], names)

    def fetch(batches):
        for b in batches:
            rows = b.to_pylist()
            for uri in dict.fromkeys(r["path"] for r in rows):
                with opened(uri) as (read, _):
                    out = [(uri, *_row(r, x["crc_ok"])) for x in rows if x["path"] == uri for r in read_span(read, Span(x["at"], x["length"], x["member"], x["gzipped"]))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), *_KINDS])], ["path", *_NAMES])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = files.repartition(parts).mapInArrow(find, "path string, at long, length long, member string, gzipped boolean, crc_ok boolean")
    found = checkpointed(each)
    bytes_ = found.agg(F.sum("length")).first()[0] or 0
    block = F.floor(F.col("at") / RANGE_BYTES)
    dealt = found.repartition(max(parts, -(-bytes_ // RANGE_BYTES)), "path", block).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(fetch, f"path string, {READ}")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, packaged, written, and read back."""
    packages = write_packages(plan_records(table(spark, sf_dir, "pages")))
    back = read_packages(packages)
    return back.select(F.col("key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


OP3_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND top <> page_id THEN top END AS refers_to
FROM m
"""
QUERIES = {"op3_warc_zip": op3_warc_zip}
ORACLES = {"op3_warc_zip": OP3_SQL}
