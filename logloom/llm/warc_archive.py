"""WARC archives of pages and a two-level capture index over them.

Writing. Each task writes WARC 1.1 files (a warcinfo record, then one gzip member per record, files of
about ``FILE_BYTES``) into the archive's folder below the shared checkpoint folder. A page is a
``response`` record with its payload (UTF-8), or a ``revisit`` record without it if a page with the same
payload, of at least ``LEAST_SHARED`` bytes, has a larger page_id: the page of the largest page_id is the
response, the others refer to it (identical-payload-digest profile). Every attempt of a task writes files
of new names; only those named in the rows that Spark commits count, so lost executors and repeated
attempts leave nothing wrong, at most unnamed files.

Index. Captures are sorted by (URL key, page_id): the key has the host's labels reversed
(``com,example,blog)/path?query``), so that a host's or domain's pages are neighbours. The sorted lines are
range-partitioned into index files. A file holds compressed blocks of ``BLOCK_LINES`` lines, then the
directory with the first key and the place of each block, then the place of the directory. Above the files
stands one row per file with its first and last key.

Lookup. The asked keys are dealt to index files by binary search among the files' keys, then each task
reads the directories of its files, binary-searches the block of each key, reads and unpacks only these
blocks, and binary-searches the lines. The captures found are sorted by archive file and offset; each task
range-reads their records (``JOINED_BYTES`` of neighbours at once), unpacks and parses them and checks
payload digests. A key whose captures fill many blocks or files is read from all of them, by many tasks.

Who is a response is decided by counts per payload digest (partial sums, digests only). Payloads with more
than ``HOT_ROWS`` rows, or a 10,000th of all, are at most 10,000 and are broadcast; all others are joined by
digest, so no payload brings more rows than that into one task.

Defined results: null html is the empty payload; null page_id stands before all others (its response is
another page if there is one); rows that repeat the largest page_id of a payload are all responses; null and
empty URLs share the empty key, a null URL is written without a target; control characters of URLs are
percent-encoded in the records; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import partitions, stored
from logloom.session import shared_dir

LEAST_SHARED = 1000
HOT_ROWS = 10_000
FILE_BYTES = 1 << 28
BLOCK_LINES = 3000
JOINED_BYTES = 1 << 22
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

CAPTURE = "url_key string, page_id long, file string, offset long, length long"


@dataclass(frozen=True)
class Archive:
    """The folder, and the index files in key order: name, first and last key (one per range partition)."""

    path: str
    index: tuple[tuple[str, bytes, bytes], ...]


def url_key(url: Column) -> Column:
    """Reversed host labels, port unless it is the scheme's own, path and query; without the fragment.
    What has no ``scheme://host`` is its own key, lower-cased; null is the empty key."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)"
    whole = F.coalesce(url, F.lit(""))
    scheme, host, port, rest = (F.regexp_extract(whole, pattern, i) for i in range(1, 5))
    usual = F.when(F.lower(scheme) == "http", "80").when(F.lower(scheme) == "https", "443").otherwise("")
    shown = F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))
    tail = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    known = F.concat(F.concat_ws(",", F.reverse(F.split(F.lower(host), r"\."))), shown, F.lit(")"), tail)
    return F.when(host == "", F.lower(F.regexp_replace(whole, r"(?s)#.*", ""))).otherwise(known)


def with_responses(spark: SparkSession, pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html (never null) and ``refers_to``, the response's page_id for revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.select("page_id", key.alias("key")).where(F.col("key").isNotNull()).groupBy("key")
    groups = groups.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1")
    groups = stored(spark, groups, "warc_groups")
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, n_rows // 10_000)
    few = F.broadcast(groups.where(hot).select(F.col("key"), F.col("top").alias("hot_top")))
    rows = rows.withColumn("key", key).join(few, "key", "left")
    # Rows that are settled, or share nothing, get a key of their own: they spread evenly.
    own = F.concat(F.lit("-"), F.sha2(F.concat_ws(" ", "page_id", "url").cast("binary"), 256))
    rows = rows.withColumn("key", F.when(F.col("hot_top").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(own))
    rows = rows.join(groups.where(~hot).select("key", "top"), "key", "left")
    top = F.coalesce("hot_top", "top")
    return rows.select("page_id", "url", "html", F.when(~top.eqNullSafe(F.col("page_id")), top).alias("refers_to"))


# Records


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def _clean(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest.hex()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response or revisit record, unpacked."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        pairs.append(("WARC-Target-URI", _clean(url)))
    pairs.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers_to is not None:
        pairs += [("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _header(pairs) + body + b"\r\n\r\n"


def _page_of(record_id: str) -> int | None:
    number = record_id.split(":")[2]
    return int(number) if number else None


def parse_record(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes, payload_digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload.decode(),
        "payload_bytes": length,
        "payload_digest": digest.hex(),
    }


def pack(raw: bytes) -> bytes:
    """One gzip member."""
    gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return gzip.compress(raw) + gzip.flush()


def unpack(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


# Files of a folder that the cluster shares


class _Folder:
    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def create(self, kind: str):
        """A new file's name and stream."""
        self.fs.create_dir(f"{self.path}/{kind}", recursive=True)
        name = f"{kind}/{uuid.uuid4().hex}"
        return name, self.fs.open_output_stream(f"{self.path}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")


def _range(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def write_records(rows: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of ``rows`` (page_id, url, html, refers_to, url_key); their captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(path)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                found = []
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "url_key")), strict=True):
                    if out is None:
                        name, out = folder.create("warc")
                        info = b"software: logloom\r\nformat: WARC File Format 1.1\r\n"
                        first = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
                        raw = pack(_header(first) + info + b"\r\n\r\n")
                        out.write(raw)
                        size = len(raw)
                    raw = pack(record(r[0], r[1], r[2].encode(), r[3]))
                    out.write(raw)
                    found.append((r[4], r[0], name, size, len(raw)))
                    size += len(raw)
                    if size >= file_bytes:
                        out.close()
                        out = None
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE)
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, CAPTURE)


_CAPTURE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_TRAILER = "<QQ"  # place and length of the directory


def _escape(key: str) -> bytes:
    """Keys in lines have no control characters; the byte order of the rest stays."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in key).encode()


def write_index(captures: DataFrame, path: str, parts: int, *, block_lines: int = BLOCK_LINES) -> list[tuple[str, bytes, bytes]]:
    """Writes the index files; (name, first key, last key) of each in key order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(path)
        out, name, size = None, "", 0
        directory: list[bytes] = []
        lines: list[bytes] = []
        first = last = b""

        def block() -> int:
            raw = zlib.compress(b"\n".join(lines), LEVEL)
            out.write(raw)
            directory.append(lines[0].split(b" ", 1)[0] + b" %d %d" % (size, len(raw)))
            return len(raw)

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names), strict=True):
                if out is None:
                    name, out = folder.create("index")
                    first = _escape(key)
                last = _escape(key)
                lines.append(b"%s %s %s %d %d" % (last, b"-" if page_id is None else b"%d" % page_id, file.encode(), offset, length))
                if len(lines) == block_lines:
                    size += block()
                    lines = []
        if out is not None:
            if lines:
                size += block()
            raw = zlib.compress(b"\n".join(directory), LEVEL)
            out.write(raw + struct.pack(_TRAILER, size, len(raw)))
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([first]), "last": pa.array([last])})

    # In the order of the lines' keys: control characters stand as %XX there.
    ordered = captures.withColumn("line_key", escaped(F.col("url_key"))).repartitionByRange(parts, "line_key", "page_id", "file", "offset")
    ordered = ordered.sortWithinPartitions("line_key", "page_id", "file", "offset").select(*[F.col("line_key" if c == "url_key" else c).alias(c) for c in _CAPTURE.names])
    files = ordered.mapInArrow(write, "name string, first binary, last binary").collect()  # one row per range partition
    return sorted(((r["name"], bytes(r["first"]), bytes(r["last"])) for r in files), key=lambda f: f[1:])


def escaped(key: Column) -> Column:
    """``_escape`` as a column, so that Spark sorts what the lines hold."""
    for code in [*range(33), 127]:
        key = F.replace(key, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return key


def write_archive(spark: SparkSession, pages: DataFrame, *, least_shared: int = LEAST_SHARED, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Archives ``pages`` (page_id, url, html) in a new folder below the shared checkpoint folder."""
    path = shared_dir(spark, "llm", "warc")
    rows = with_responses(spark, pages, least_shared).withColumn("url_key", url_key(F.col("url")))
    captures = stored(spark, write_records(rows, path, file_bytes=file_bytes), "warc_captures")
    return Archive(path, tuple(write_index(captures, path, partitions(spark), block_lines=block_lines)))


class _IndexFile:
    """One index file: its directory, and the last block read."""

    def __init__(self, folder: _Folder, name: str):
        self.file = folder.open(name)
        end = self.file.size() - struct.calcsize(_TRAILER)
        at, length = struct.unpack(_TRAILER, _range(self.file, end, self.file.size() - end))
        rows = [line.split(b" ") for line in zlib.decompress(_range(self.file, at, length)).split(b"\n")]
        self.keys = [r[0] for r in rows]
        self.places = [(int(r[1]), int(r[2])) for r in rows]
        self.held: tuple[int, list[bytes], list[bytes]] = (-1, [], [])

    def block(self, i: int) -> tuple[list[bytes], list[bytes]]:
        if self.held[0] != i:
            lines = zlib.decompress(_range(self.file, *self.places[i])).split(b"\n")
            self.held = i, [x.split(b" ", 1)[0] for x in lines], lines
        return self.held[1:]

    def find(self, key: bytes) -> Iterator[list[bytes]]:
        """The lines of ``key``: from the last block that starts before it, as far as it goes."""
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            keys, lines = self.block(i)
            a, b = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
            for line in lines[a:b]:
                yield line.split(b" ")
            i += 1


@dataclass(frozen=True)
class Found:
    """Captures found in an archive: a DataFrame of (url_key, page_id, file, offset, length)."""

    path: str
    captures: DataFrame


def lookup(spark: SparkSession, archive: Archive, urls: DataFrame) -> Found:
    """The captures of the URLs in ``urls`` (column ``url``); every asked key counts once."""
    path, index = archive.path, archive.index
    firsts, lasts = [f[1] for f in index], [f[2] for f in index]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = [], []
            for key in batch.column("url_key").to_pylist():
                k = key.encode()
                a, b = bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)
                files += range(a, b)
                keys += [k] * (b - a)
            yield pa.RecordBatch.from_pydict({"place": pa.array(files, pa.int32()), "key": pa.array(keys, pa.binary())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, at, opened = _Folder(path), -1, None
        for batch in batches:
            found = []
            for place, key in zip(batch.column("place").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if place != at:
                    at, opened = place, _IndexFile(folder, index[place][0])
                for k, page_id, file, offset, length in opened.find(key):
                    found.append((k.decode(), None if page_id == b"-" else int(page_id), file.decode(), int(offset), int(length)))
                    if len(found) == 10_000:
                        yield _captures(found)
                        found = []
            if found:
                yield _captures(found)

    asked = urls.select(escaped(url_key(F.col("url"))).alias("url_key")).distinct()
    dealt = asked.mapInArrow(deal, "place int, key binary")
    # Neighbouring keys of one file stay together; a file asked for much is dealt to several tasks.
    dealt = dealt.repartitionByRange(partitions(spark), "place", "key").sortWithinPartitions("place", "key")
    return Found(path, dealt.mapInArrow(search, CAPTURE))


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE)


def read_captures(found: Found) -> DataFrame:
    """The records of the captures: url_key, page_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest."""
    path = found.path
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.large_string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, name, file = _Folder(path), None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names), strict=True))
            i = 0
            while i < len(rows):
                if rows[i][2] != name:
                    name, file = rows[i][2], folder.open(rows[i][2])
                # Neighbours are read at once, up to JOINED_BYTES.
                start, j = rows[i][3], i + 1
                while j < len(rows) and rows[j][2] == name and rows[j][3] <= rows[j - 1][3] + rows[j - 1][4] and rows[j][3] + rows[j][4] - start <= JOINED_BYTES:
                    j += 1
                raw = _range(file, start, rows[j - 1][3] + rows[j - 1][4] - start)
                parsed = []
                for key, _, _, offset, length in rows[i:j]:
                    one = parse_record(unpack(raw[offset - start : offset - start + length]))
                    parsed.append({"url_key": key} | {c: one[c] for c in names})
                yield pa.RecordBatch.from_pylist(parsed, schema)
                i = j

    fields = "url_key string, page_id long, url string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string"
    spark = found.captures.sparkSession
    by_place = found.captures.repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return by_place.mapInArrow(read, fields)
