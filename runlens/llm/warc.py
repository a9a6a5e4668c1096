"""WARC archives with a two-level capture index.

Pages are written as WARC 1.1 records, each its own gzip member, into archives
that tasks place in the shared folder.  A page whose payload another page with a
larger id has too becomes a revisit record without a payload.

The index has a line per record, keyed by the URL with its host reversed and the
page's id.  Lines are range-partitioned and sorted; a task writes its range as one
shard: compressed blocks of lines, one after the other, and a sparse directory with
every block's first key and place.  A lookup finds the shard in the list of shards
(one row per task that wrote the index), binary-searches the shard's directory for
the block, reads that block by range, binary-searches its lines, and then reads the
one range of the archive.  Reading back deals the keys by range too, so that tasks
walk through shards in order; the id in the key lets a URL with very many captures
be split.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, saved

#: Lines of one block of the index; bytes after which a task begins another archive.
BLOCK_LINES, ARCHIVE_BYTES = 1000, 256 << 20
#: Smallest payload that a revisit can stand for.
LEAST_PAYLOAD = 0
#: Stands for a missing id in the index.
NO_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"


def reversed_host_key(url: str | None) -> str:
    """``https://m.example.com:8080/a?b`` gives ``com,example,m:8080)/a?b``; scheme, user and fragment are dropped, the host is in lower case."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"){url}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){tail}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(place: str, page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, keeper: tuple[int, str | None] | None) -> bytes:
    """One WARC record, not compressed; ``keeper``: id and URL of the response that it revisits.

    A revisit has no block; its headers keep digest and length of the payload.  The
    record's id is made of its ``place`` (archive and offset), which no other has.
    """
    flat = lambda x: (x or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {flat(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Length: {length}",
    ]
    if keeper is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {flat(keeper[1])}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-ID: {keeper[0]}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload) if keeper is None else 0}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (payload if keeper is None else b"") + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


_INDEX = "key string, id long, archive string, place long, length long"
_INDEX_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all ``pages`` and return the index lines: ``key``, ``id``, ``archive``, ``place``, ``length``.

    Null html is an empty payload, null urls have the key ``)/``.  Rows that repeat
    the id and payload of a response are responses too.  A row without an id is a
    response unless a page with an id has its payload.  Extra columns are ignored.
    Only archives that the returned lines name count: a task that runs again
    writes another one.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    kept = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("sha").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("keeper"))
    decided = rows.join(kept, "sha", "left").select("page_id", "url", "payload", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("keeper_url"))
    names = ["key", "id", "archive", "place", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out, name, place, lines = None, "", 0, []
        for batch in batches:
            for pid, page_url, payload, keeper, keeper_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or place >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, place = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                revisits = (keeper, keeper_url) if keeper is not None and keeper != pid else None
                pack = zlib.compressobj(1, wbits=31)
                data = pack.compress(record(f"{name} {place}", pid, page_url, payload, payload_digest(payload), len(payload), revisits)) + pack.flush()
                out.write(data)
                lines.append((index_key(page_url), NO_ID if pid is None else pid, name, place, len(data)))
                place += len(data)
                if len(lines) >= 4096:
                    yield _batch(lines, _INDEX_TYPES, names)
                    lines = []
        if out is not None:
            out.close()
        if lines:
            yield _batch(lines, _INDEX_TYPES, names)

    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    return decided.mapInArrow(run, _INDEX)


def index_key(url: str | None) -> str:
    """The reversed-host key as it stands in a line of the index."""
    return reversed_host_key(url).replace("\n", "%0A").replace("\t", "%09")


#: Name of a shard's file, number of its lines, first and last key and id, place and length of its directory.
_SHARD = "name string, n long, first_key string, first_id long, last_key string, last_id long, place long, length long"
_SHARD_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())


def _packed(rows: Iterable[tuple]) -> bytes:
    return zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode(), 6)


def _unpacked(data: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]


def build_index(lines: DataFrame, folder: str) -> DataFrame:
    """Write the sorted lines as shards into ``folder``; a row per shard, which is what a lookup starts from.

    Text is compared by its UTF-8 bytes, here as in Spark.  Only shards that the
    returned rows name count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name = f"index-{uuid.uuid4().hex}"
        out, place, n, rows, directory, last = None, 0, 0, [], [], ()

        def close_block() -> None:
            nonlocal place, rows
            data = _packed(rows)
            out.write(data)
            directory.append((*rows[0][:2], place, len(data)))
            place, rows = place + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                rows.append(row)
                n, last = n + 1, row[:2]
                if len(rows) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        if rows:
            close_block()
        data = _packed(directory)
        out.write(data)
        out.close()
        yield _batch([(name, n, *directory[0][:2], *last, place, len(data))], _SHARD_TYPES, ["name", "n", "first_key", "first_id", "last_key", "last_id", "place", "length"])

    ordered = lines.repartitionByRange("key", "id", "archive", "place").sortWithinPartitions("key", "id", "archive", "place")
    return ordered.mapInArrow(run, _SHARD)


@dataclass(frozen=True)
class Shard:
    """A row of the index, with keys as they are compared: UTF-8 and id."""

    name: str
    first: tuple[bytes, int]
    last: tuple[bytes, int]
    place: int
    length: int


def shards(index: DataFrame) -> list[Shard]:
    """The list of shards, in order of their keys: a row for each task that wrote the index, however many lines there are."""
    rows = index.collect()
    return sorted((Shard(r.name, (r.first_key.encode(), r.first_id), (r.last_key.encode(), r.last_id), r.place, r.length) for r in rows), key=lambda x: (x.first, x.last))


class Reader:
    """Searches shards and reads records by range; keeps the last shard's directory, its last block and the last archive."""

    def __init__(self, folder: str, listed: list[Shard]):
        (self.system, self.root), self.listed = _open(folder), listed
        self.firsts, self.lasts = [x.first for x in listed], [x.last for x in listed]
        self.files: dict[str, object] = {}
        self.shard, self.directory, self.at, self.block = "", [], -1, []

    def _range(self, kind: str, name: str, place: int, length: int) -> bytes:
        known, file = self.files.get(kind, ("", None))
        if known != name:
            if file is not None:
                file.close()
            file = self.system.open_input_file(f"{self.root}/{name}")
            self.files[kind] = (name, file)
        return file.read_at(length, place)

    def _load(self, shard: Shard, k: int) -> bool:
        """Whether block ``k`` of a shard exists; its lines are then in ``block``."""
        if self.shard != shard.name:
            rows = _unpacked(self._range("index", shard.name, shard.place, shard.length))
            self.shard, self.directory, self.at = shard.name, [((key.encode(), int(i)), int(p), int(n)) for key, i, p, n in rows], -1
        if not 0 <= k < len(self.directory):
            return False
        if self.at != k:
            _, place, length = self.directory[k]
            self.block = [((key.encode(), int(i)), archive, int(p), int(n)) for key, i, archive, p, n in _unpacked(self._range("index", shard.name, place, length))]
            self.at = k
        return True

    def entries(self, low: tuple[bytes, int], high: tuple[bytes, int]) -> Iterator[tuple[str, int, int]]:
        """Archive, place and length of all lines from ``low`` to ``high``."""
        for s in range(bisect.bisect_left(self.lasts, low), bisect.bisect_right(self.firsts, high)):
            shard = self.listed[s]
            self._load(shard, -1)
            # Equal keys may begin in the block before the first that starts with them.
            k = max(0, bisect.bisect_left(self.directory, low, key=lambda x: x[0]) - 1)
            while self._load(shard, k) and self.directory[k][0] <= high:
                for line in self.block[bisect.bisect_left(self.block, low, key=lambda x: x[0]) :]:
                    if line[0] > high:
                        return
                    yield line[1:]
                k += 1

    def record(self, archive: str, place: int, length: int) -> tuple[dict[str, str], bytes]:
        return parsed(zlib.decompress(self._range("archive", archive, place, length), wbits=31))


def _described(headers: dict[str, str], payload: bytes) -> tuple:
    revisit = headers["WARC-Type"] == "revisit"
    number = int(headers["WARC-Payload-Length"]) if revisit else len(payload)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload)
    return int(headers["WARC-Page-ID"]) if headers["WARC-Page-ID"] else None, number, digest, headers["WARC-Type"], int(headers["WARC-Refers-To-Page-ID"]) if revisit else None


def read_pages(pages: DataFrame, index: DataFrame, folder: str, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """The records of all (id, URL) in ``pages``, each found through the index: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Length and digest of a response are taken from the payload as read; a revisit
    has them in its headers.  Keys that repeat are looked up once and give all their
    records; keys without a record give none.
    """
    listed = shards(index)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(index_key, b.column(1).to_pylist()), pa.string()), b.column(0)], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, listed)
        for batch in batches:
            found = []
            for key, i in zip(*(c.to_pylist() for c in batch.columns)):
                found += reader.entries((key.encode(), i), (key.encode(), i))
            # In order of their archives, so that each is opened once.
            out = [_described(*reader.record(*entry)) for entry in sorted(found)]
            for at in range(0, len(out), 4096):
                yield _batch(out[at : at + 4096], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = pages.select(F.coalesce(F.col(page_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url).cast("string").alias("url"))
    keys = wanted.mapInArrow(keyed, "key string, id long").distinct()
    ordered = keys.repartitionByRange(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "id").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(index: DataFrame, folder: str, urls: list[str]) -> dict[str, list[tuple[int | None, str, bytes]]]:
    """Captures of a few URLs: (page id, record type, payload) by URL."""
    reader, found = Reader(folder, shards(index)), {}
    for u in urls:
        key = index_key(u).encode()
        records = (reader.record(*x) for x in reader.entries((key, NO_ID), (key, (1 << 63) - 1)))
        found[u] = [(int(h["WARC-Page-ID"]) if h["WARC-Page-ID"] else None, h["WARC-Type"], payload) for h, payload in records]
    return found


def archive_and_index(spark: SparkSession, pages: DataFrame) -> tuple[str, DataFrame]:
    """Write ``pages`` and their index below the shared folder; the folder and a row per shard of the index."""
    folder = new_folder(spark, "warc")
    lines = saved(write_archives(pages, folder), "capture-lines")
    return folder, saved(build_index(lines, folder), "capture-index")
