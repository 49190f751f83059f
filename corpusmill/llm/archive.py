"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, to one file for each partition. Of records
with equal payloads one is a response and the others refer to it. The captures are sorted by their
reversed-host URL key into compressed index blocks; every index file ends in a sparse directory of
the first key of each block. A lookup sorts its keys, finds the files by their first keys and the
blocks by a binary search of the files' directories, then reads each block by range, once for all of
its keys, and the records by range. Without keys, a walk over the blocks reads everything.

Only files that the staged manifests name count, so a lost or repeated attempt leaves at most a file
that nobody reads.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import stage, staging_path

LEVEL = 1  # of gzip
CAPTURES = 512  # in an index block
PLACES = 4096  # blocks found that a task holds
OPEN_FILES = 64  # that a reading task keeps open
DATE = "1970-01-01T00:00:00Z"  # of every record, so that reruns write the same bytes
#: Fixed values of the formats.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIRECTORY = b"CDIR0001"
TAIL = "<QQ8s"

MANIFEST = "url string, path string, offset long, length long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: ``org,example,www)/path``. Null is the empty URL; what has no
    host sorts by the whole URL."""
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", F.concat(F.lit(")"), text)).otherwise(F.concat(turned, F.lit(")"), rest))


def _name(page_id: str | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, LEVEL, mtime=0)


def page_record(page_id, url, payload: bytes, size: int, digest: str, owner, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that keeps only the headers of the response."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if not revisit:
        return _record("response", fields, http.encode() + payload)
    more = [("WARC-Refers-To", _name(owner)), ("WARC-Profile", IDENTICAL)]
    return _record("revisit", fields + more, http.encode())


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one gzip member."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _write_records(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{path}", compression=None) as out:
            out.write(_record("warcinfo", [("WARC-Record-ID", _name(None))], b"format: WARC/1.1\r\n"))
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, owner, revisit in zip(*(batch[c] for c in batch)):
                    payload = (html or "").encode("utf-8")
                    raw = page_record(page_id, url, payload, size, _digest(digest), owner, revisit)
                    rows.append((url, path, out.tell(), len(raw)))
                    out.write(raw)
                found = pd.DataFrame(rows, columns=["url", "path", "offset", "length"])
                yield found.astype({"offset": "int64", "length": "int64"})

    return write


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files; the staged manifest of their records.

    The row with the largest page_id of those with equal payloads is the response; a null page_id is
    smaller than any other. A null html is an empty payload. Repeated rows of a response's id are
    responses too. Only the keys of equal payloads meet; the pages themselves are dealt out by id.
    """
    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    given = given.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = given.select("page_id", "digest")
    owners = narrow.groupBy("digest").agg(F.max("page_id").alias("owner"))
    known = narrow.distinct().join(owners, "digest")
    known = stage(known.withColumnsRenamed({"page_id": "own_id", "digest": "own_digest"}), "payloads")
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows = given.join(known, same).select(
        F.col("page_id").cast("string"),  # pandas would make a column with nulls a float
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        F.octet_length("html").cast("long").alias("size"),
        "digest",
        F.col("owner").cast("string"),
        revisit.alias("revisit"),
    )
    return stage(rows.mapInPandas(_write_records(folder), MANIFEST), "captures")


def _pack_block(rows: list[tuple]) -> bytes:
    return zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), LEVEL)


def _write_index(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"index-{part:06d}-{uuid.uuid4().hex}.cdx"
        waiting, directory = [], []
        with store.open_output_stream(f"{root}/{path}", compression=None) as out:

            def flush() -> None:
                nonlocal waiting
                raw = _pack_block(waiting)
                directory.append((waiting[0][0], out.tell(), len(raw)))
                out.write(raw)
                waiting = []

            for batch in batches:
                columns = [batch[c].tolist() for c in ("key", "path", "offset", "length")]
                for row in zip(*columns):
                    waiting.append(row)
                    if len(waiting) == CAPTURES:
                        flush()
            if waiting:
                flush()
            at, raw = out.tell(), zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(raw + struct.pack(TAIL, at, len(raw), DIRECTORY))
        if directory:
            found = pd.DataFrame(directory, columns=["first_key", "offset", "length"])
            yield found.assign(part=part, path=path)[["part", "path", "first_key", "offset", "length"]]

    return write


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures of a manifest by URL key into index files; one staged row for each block."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        captures.select(url_key(F.col("url")).alias("key"), "path", "offset", "length")
        .repartitionByRange(parts, "key", "path", "offset")
        .sortWithinPartitions("key", "path", "offset")
    )
    blocks = placed.mapInPandas(
        _write_index(folder), "part int, path string, first_key string, offset long, length long"
    )
    return stage(blocks, "blocks")


class Archive:
    """Range reads from the files of a folder, a bounded number of them open at a time."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.files: dict = {}
        self.directories: dict = {}

    def file(self, path: str):
        if path not in self.files:
            if len(self.files) == OPEN_FILES:
                self.files.pop(next(iter(self.files))).close()
            self.files[path] = self.store.open_input_file(f"{self.root}/{path}")
        return self.files[path]

    def read(self, path: str, offset: int, length: int) -> bytes:
        file = self.file(path)
        file.seek(offset)
        return file.read(length)

    def block(self, path: str, offset: int, length: int) -> list[list]:
        raw = zlib.decompress(self.read(path, offset, length)).decode()
        return [json.loads(line) for line in raw.split("\n")]

    def directory(self, path: str) -> list[list]:
        size, tail = self.file(path).size(), struct.calcsize(TAIL)
        at, length, mark = struct.unpack(TAIL, self.read(path, size - tail, tail))
        if mark != DIRECTORY:
            raise ValueError(f"{path} isn't an index file")
        return json.loads(zlib.decompress(self.read(path, at, length)))

    def places(self, path: str, key: str) -> Iterator[tuple[str, int, int]]:
        """The blocks of an index file that may hold a key, by a binary search of its directory."""
        if path not in self.directories:
            self.directories = {path: self.directory(path)}  # keys come in order, so one is enough
        directory = self.directories[path]
        at = max(0, bisect.bisect_left(directory, key, key=lambda d: d[0]) - 1)
        while at < len(directory) and directory[at][0] <= key:
            yield path, *directory[at][1:]
            at += 1


def _described(archive: Archive, capture: list) -> tuple:
    fields, http, payload = parse_record(archive.read(*capture[1:]))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and _digest(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"{capture} has another payload than its digest says")
    size = len(payload) if kind == "response" else int(http["Content-Length"])
    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(fields["WARC-Record-ID"]), size, digest, kind, refers


def _framed(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = pd.DataFrame(rows, columns=names)
    return found.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def _read_blocks(folder: str, index: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, blocks = Archive(folder), Archive(index)
        for batch in batches:
            for path, offset, length in zip(batch["path"], batch["offset"], batch["length"]):
                captures = blocks.block(path, int(offset), int(length))
                yield _framed([_described(records, c) for c in captures])

    return read


def read_archive(blocks: DataFrame, folder: str, index: str) -> DataFrame:
    """Every record of an archive, from its index blocks: page_id, payload_bytes, payload_digest
    (bare base32 SHA-1), record_type, refers_to."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.select("path", "offset", "length").repartition(parts)
    return spread.mapInPandas(_read_blocks(folder, index), SCHEMA)


def _find_blocks(index: str, files: list[tuple[str, str]]):
    """Keys in order to the blocks that may hold them; ``files`` has (first key, path), in order."""
    lows = [low for low, _ in files]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            [(*place, json.dumps(keys)) for *place, keys in rows], columns=["path", "offset", "length", "keys"]
        )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, rows = Archive(index), []
        for batch in batches:
            for key in batch["key"]:
                first, last = bisect.bisect_left(lows, key) - 1, bisect.bisect_right(lows, key)
                for _, path in files[max(0, first) : last]:
                    for place in archive.places(path, key):
                        if rows and rows[-1][:3] == place and len(rows[-1][3]) < CAPTURES:
                            rows[-1][3].append(key)
                            continue
                        if len(rows) == PLACES:
                            yield framed(rows)
                            rows = []
                        rows.append((*place, [key]))
        if rows:
            yield framed(rows)

    return find


def _read_keys(folder: str, index: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, blocks = Archive(folder), Archive(index)
        for batch in batches:
            for path, offset, length, keys in zip(*(batch[c] for c in batch)):
                block = blocks.block(path, int(offset), int(length))
                rows = []
                for key in json.loads(keys):
                    low = bisect.bisect_left(block, key, key=lambda c: c[0])
                    high = bisect.bisect_right(block, key, key=lambda c: c[0])
                    rows += [(key, *_described(records, capture)) for capture in block[low:high]]
                if rows:
                    found = _framed([r[1:] for r in rows])
                    found.insert(0, "key", [r[0] for r in rows])
                    yield found

    return read


def lookup(urls: DataFrame, blocks: DataFrame, folder: str, index: str) -> DataFrame:
    """The records of each distinct URL of ``urls`` (url): key, then the columns of ``read_archive``.
    A URL without a capture gives no row; URLs with the same key count once.

    The first keys of the index files, a row for each file, travel with the job. Tasks with a range
    of keys find blocks in the directories; the blocks are then dealt out, so the captures of a key
    that fills many blocks are read by many tasks.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = blocks.groupBy("path").agg(F.min("first_key").alias("low"), F.min("part").alias("part"))
    ordered = files.orderBy("part").collect()  # one row for each partition of the index
    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    sorted_keys = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = sorted_keys.mapInPandas(
        _find_blocks(index, [(r["low"], r["path"]) for r in ordered]),
        "path string, offset long, length long, keys string",
    )
    spread = found.repartition(parts, "path", "offset")
    return spread.mapInPandas(_read_keys(folder, index), f"key string, {SCHEMA}")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, index it, and look up every URL again:
    the records of all of them, without the key."""
    folder = staging_path(pages.sparkSession, "archive")
    captures = write_archive(pages, folder)
    blocks = write_index(captures, folder)
    return lookup(captures, blocks, folder, folder).drop("key")


def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
