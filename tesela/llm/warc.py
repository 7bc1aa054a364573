"""WARC archives with a two-level capture index.

Every capture becomes a gzip member in a WARC file of bounded size; a payload that was captured before is a revisit that
refers to the capture with the smallest id. The index sorts lines by reversed-host URL key, in ranges, one pair of files
each: blocks of lines, compressed one by one, and a sparse directory with a line for each block. A look-up searches the
ranges' first keys, then one range's directory, reads the blocks by byte range, and the records by byte range again.
`Lookup` does so for single URLs, `look_up` for a table of them: it searches the directories for the blocks of each key,
and deals out blocks, so a key with a third of all captures, which has many blocks, is read by many tasks.

Files are written through Arrow's file systems to the shared folder, under names that a repeated task does not reuse; only
files that a finished task has reported are ever read.

Defined results: null html is an empty payload; a null URL has the key "-"; captures equal in id and payload are all
responses if theirs is the smallest id; a null id is never referred to unless all are null, then all are responses; an
empty table makes an empty archive; other columns are not archived. A very long page is one record, written and read whole."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm.common import col, materialize, release, shared_path, small, small_batches, table

FILE_BYTES, BLOCK_LINES, DATE = 64 << 20, 300, "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, port and path in lower-case host form: http://www.a.com/b?c -> com,a)/b?c."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="%/:=&?~#+!$,;@()*.-_")
    host = host.removeprefix("www.")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest, safe="%/:=&?~#+!$,;@()*.-_")


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[].-_"),
        "WARC-Payload-Digest": "sha1:" + digest(payload),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; raises ValueError if a length or digest is wrong."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    warc = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(warc["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length it gives")
    http_head, _, payload = rest[:size].partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and warc["WARC-Payload-Digest"] != "sha1:" + digest(payload):
        raise ValueError("the payload's digest is another")
    return warc, http, payload


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Ranges:
    """Byte ranges of files under a folder, the files last used kept open."""

    def __init__(self, root: str):
        self.fs, self.root = _open(root)
        self.files: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)


@dataclass
class Archive:
    """`root` holds the files; `directory` has a row for each index block (part, first and last key, offset, length, lines)
    and for each range, with offset -1 and the length of its directory file."""

    root: str
    directory: DataFrame

    def ranges(self) -> list[tuple[str, str, str, int]]:
        """First and last key, name and length of the directory of every range: one row for each task that wrote the index.

        Sorted, so that of ranges that begin with one key the one that goes on beyond it is the last."""
        return sorted((r["first"], r["last"], r["part"], r["length"]) for r in self.directory.filter("offset < 0").select("part", "first", "last", "length").collect())


def _write_records(root: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        out, name, size = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record(page, url, payload, refers)
                out.write(member)
                rows.append((url_key(url), page, name, size, len(member)))
                size += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)
        if out:
            out.close()
        release()

    return run


def _write_index(root: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        part, out, offset, lines, rows = uuid.uuid4().hex, None, 0, [], []

        def block() -> None:
            nonlocal out, offset, lines
            out = out or fs.open_output_stream(f"{base}/{part}.cdx.gz", compression=None)
            packed = gzip.compress(("\n".join(lines) + "\n").encode(), 6, mtime=0)
            out.write(packed)
            rows.append((part, lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], offset, len(packed), len(lines)))
            offset += len(packed)
            lines = []

        for batch in batches:
            for key, page, name, at, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append(f"{key} {json.dumps({'page': page, 'file': name, 'offset': at, 'length': size})}")
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out:
            out.close()
            text = "".join(f"{first}\t{at}\t{size}\t{n}\n" for _, first, _, at, size, n in rows).encode()
            with fs.open_output_stream(f"{base}/{part}.idx") as idx:
                idx.write(text)
            rows.insert(0, (part, rows[0][1], rows[-1][2], -1, len(text), 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return run


def write_archive(df: DataFrame, root: str | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Writes the records and the index under `root`, a folder that all executors share."""
    spark = df.sparkSession
    small_batches(spark)
    root = root or shared_path(spark, "warc")
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    sha = F.sha2(F.encode(F.coalesce(col(html), F.lit("")), "utf-8"), 256)
    marked = df.select(col(page).cast("long").alias("page"), sha.alias("sha"))
    repeated = marked.groupBy("sha").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select(F.col("sha").alias("again"), "first")
    repeated = materialize(repeated, "warc-repeated")
    revisits = materialize(marked.join(small(repeated), F.col("sha") == F.col("again")).filter("page is null or page <> first").select(F.col("page").alias("p"), F.col("sha").alias("s"), "first").distinct(), "warc-revisits")
    rows = df.select(col(page).cast("long").alias("page"), col(url).alias("url"), col(html).alias("html"), sha.alias("sha")).join(small(revisits), F.col("page").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    names = ["key", "page", "file", "offset", "length"]
    written = materialize(rows.select("page", "url", "html", F.col("first").alias("refers_to")).mapInArrow(_write_records(root, names), "key string, page long, file string, offset long, length long"), "warc-written")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written.repartitionByRange(ranges, "key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")
    directory = ordered.mapInArrow(_write_index(root, ["part", "first", "last", "offset", "length", "lines"]), "part string, first string, last string, offset long, length long, lines long")
    return Archive(root, materialize(directory, "warc-directory"))


def _at(firsts: list[str], key: str) -> int:
    """Where the lines of a key can begin: the last place whose first key is less, as a run of keys may span places."""
    return max(0, bisect_left(firsts, key) - 1)


class Directory:
    """Search of the ranges' first keys and of their sparse directories, which are read when asked for and kept."""

    def __init__(self, root: str, parts: list[tuple[str, str, str, int]]):
        self.files, self.parts, self.firsts = _Ranges(root), parts, [p[0] for p in parts]
        self.known: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Part, offset and length of the blocks that can hold lines of the key."""
        for first, _, part, length in self.parts[_at(self.firsts, key) :]:
            if first > key:
                break
            if part not in self.known:
                if len(self.known) > 16:
                    self.known.pop(next(iter(self.known)))
                lines = [x.split("\t") for x in self.files.read(f"{part}.idx", 0, length).decode().splitlines()]
                self.known[part] = [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]
            firsts, places = self.known[part]
            for at in range(_at(firsts, key), len(firsts)):
                if firsts[at] > key:
                    break
                yield part, *places[at]

    def lines(self, part: str, offset: int, length: int) -> list[str]:
        """The lines of a block."""
        return zlib.decompress(self.files.read(f"{part}.cdx.gz", offset, length), 31).decode().splitlines()


def entries(lines: list[str], key: str) -> Iterator[dict]:
    """The entries of a key among a block's lines, by binary search."""
    for line in lines[bisect_left(lines, key + " ") :]:
        if not line.startswith(key + " "):
            break
        yield json.loads(line.partition(" ")[2])


def look_up(archive: Archive, urls: DataFrame, url: str = "url") -> DataFrame:
    """Every record of the URLs of a table, by way of the index: page, key, type, digest, payload_bytes, refers_to, payload."""
    root, names = archive.root, ["page", "key", "type", "digest", "payload_bytes", "refers_to", "payload"]
    spark = urls.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = archive.ranges()

    def number(urn: str | None) -> int | None:
        value = (urn or "")[len("<urn:page:") : -1]
        return int(value) if value and value != "None" else None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], names=["key"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(root, parts)
        for batch in batches:
            rows = [(*block, key) for key in batch.column(0).to_pylist() for block in directory.blocks(key)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["part", "offset", "length", "key"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, at, lines = Directory(root, parts), None, []
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for part, offset, length, key in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, offset) != at:
                    at, lines = (part, offset), directory.lines(part, offset, length)
                for e in entries(lines, key):
                    warc, http, payload = parse(directory.files.read(e["file"], e["offset"], e["length"]))
                    response = warc["WARC-Type"] == "response"
                    rows.append((number(warc["WARC-Record-ID"]), key, warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), number(warc.get("WARC-Refers-To")), payload if response else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    keys = urls.select(col(url)).mapInArrow(keyed, "key string").distinct()
    # sorted keys ask for one directory after the other
    places = keys.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(searched, "part string, offset long, length long, key string")
    dealt = places.repartition(tasks, "part", "offset").sortWithinPartitions("part", "offset", "key")
    return dealt.mapInArrow(fetched, "page long, key string, type string, digest string, payload_bytes long, refers_to long, payload binary")


class Lookup:
    """Look-ups by URL. Holds the ranges' first keys alone; directories and blocks are read when asked for."""

    def __init__(self, archive: Archive):
        self.directory = Directory(archive.root, archive.ranges())
        self.reads = 0

    def find(self, url: str) -> list[dict]:
        """Index entries of the URL."""
        key, found = url_key(url), []
        for block in self.directory.blocks(key):
            self.reads += 1
            found += entries(self.directory.lines(*block), key)
        return found

    def fetch(self, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of the URL."""
        return [parse(self.directory.files.read(e["file"], e["offset"], e["length"])) for e in self.find(url)]


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = look_up(write_archive(pages), pages)
    return back.select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES: dict[str, str] = {}
