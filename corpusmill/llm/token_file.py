"""Token ids of a corpus as binary files of Simple-8b blocks, in order of the documents' ids.

The documents are range-partitioned by doc_id; each partition is tokenised and written to a file of
its own, block by block. A file ends in a directory: where each block starts, and which documents
it holds with how many ids. Only files named in the staged manifest count, so an attempt that was
lost or repeated leaves at most a file that nobody reads. Files are read in parallel, block by block.

Layout, little-endian: MAGIC; the blocks (ids, words, exceptions as u32, then the words and the
exceptions as u64); the directory (block offsets u64, doc_ids i64, null flags u8, lengths u64); the
trailer (directory offset, blocks, documents, ids as u64; MAGIC).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import once, table
from corpusmill.llm.simple8b import BLOCK, decode, encode
from corpusmill.llm.wordhash import groups, mixed, powers
from corpusmill.session import stage, staging_path

END = 0  # the id that ends every document
MAGIC = b"S8BIDS01"
TRAILER = "<QQQQ8s"
HEAD = "<III"
BUFFER = 256 * BLOCK  # ids that are packed at a time
AHEAD = 256  # blocks that are read at a time
TEXT = 2 << 20  # characters that are cut into pieces at a time; a longer text is taken whole
CACHE = 1_500_000  # pieces of text whose ids a worker remembers

#: White space besides spaces and line breaks, and the bytes that such characters start with.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RARE = np.zeros(256, bool)
_RARE[[9, *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.held):
            self.held = np.append(self.held, np.zeros(max(end, len(self.held)), self.held.dtype))
        self.held[self.used : end] = values
        self.used = end

    def values(self) -> np.ndarray:
        return self.held[: self.used]


class _Table:
    """Numbers of 64-bit keys, found and added many at a time; 0 isn't a key."""

    def __init__(self, bits: int = 16):
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        todo, mask = np.arange(len(keys)), np.uint64(len(self.keys) - 1)
        at = keys & mask
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            going = ~hit & (held != 0)
            todo, at = todo[going], (at[going] + np.uint64(1)) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.used += len(keys)
        if self.used > len(self.keys) // 2:
            old, numbers = self.keys, self.values
            self.__init__((2 * self.used).bit_length() + 1)
            self.add(np.append(old[old != 0], keys), np.append(numbers[old != 0], values))
            return
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + np.uint64(1)) & mask


class Encoder:
    """Ids of texts, as a tokenizer of the tokenizers library gives them.

    The byte-level tokenizers always split where a space or line break follows another character.
    The pieces between such places are found and hashed in numpy, each distinct piece goes through
    the library once, and its ids are kept. A piece is known by two 64-bit hashes. Texts with other
    white space or a special token's string go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = _Table()
        self.second = _Grown(np.uint64)
        self.ids = _Grown(np.uint32)
        self.ends = _Grown(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], first: np.ndarray, second: np.ndarray) -> None:
        found = self._library(pieces)
        counts = np.array([len(x) for x in found], np.int64)
        self.known.add(first, self.second.used + np.arange(len(first), dtype=np.int32))
        self.second.add(second)
        self.ids.add(np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum())))
        self.ends.add(self.ends.values()[-1] + np.cumsum(counts))

    def _whole(self, text: str, rare: bool) -> bool:
        """Is there a special token in the text, or white space that the pieces don't know of?"""
        return any(t in text for t in self.special) or (rare and _OTHER_SPACE.search(text) is not None)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        raw = [t.encode("utf-8") for t in texts]
        seen = np.cumsum(np.append(0, _RARE[np.frombuffer(b"".join(raw), np.uint8)]))
        rare = np.diff(seen[np.cumsum([0] + [len(r) for r in raw])]) > 0
        odd = [i for i, t in enumerate(texts) if self._whole(t, rare[i])]
        out: list = [None] * len(texts)
        for i, ids in zip(odd, self._library([texts[i] for i in odd])):
            out[i] = np.array(ids, np.uint32)
        plain = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(plain, self._by_pieces([raw[i] for i in plain])):
            out[i] = ids
        return out

    def _by_pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        data = b"".join(raw)
        bounds = np.cumsum([0] + [len(r) for r in raw])
        if not data:
            return [np.zeros(0, np.uint32)] * len(raw)
        if self.known.used > CACHE:
            self._forget()
        place, first, second = piece_hashes(np.frombuffer(data, np.uint8), bounds)
        entry = self.known.find(first)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, where, back = np.unique(first[new], return_index=True, return_inverse=True)
            where, count = new[where], self.second.used
            ends = np.append(place, len(data))[where + 1]
            pieces = [data[a:b].decode() for a, b in zip(place[where].tolist(), ends.tolist())]
            self._learn(pieces, distinct, second[where])
            entry[new] = count + back
        if (self.second.values()[entry] != second).any():  # two pieces share the first hash
            return [np.array(x, np.uint32) for x in self._library([r.decode() for r in raw])]
        own = self.ends.values()
        start, count = own[entry], own[entry + 1] - own[entry]
        after = np.cumsum(count)
        ids = self.ids.values()[np.repeat(start - after + count, count) + np.arange(after[-1])]
        cuts = np.concatenate(([0], after))[np.searchsorted(place, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def piece_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two hashes of every piece of the texts that ``bounds`` cuts ``data`` into."""
    blank = (data == 32) | (data == 10)
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    place = np.flatnonzero(start)
    length = np.diff(np.append(place, len(data)))
    offset = np.arange(len(data)) - np.repeat(place, length)
    value = data.astype(np.uint64) + np.uint64(1)
    found = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        power = powers(np.uint64(base), int(length.max()))[offset]
        found.append(mixed(np.add.reduceat(value * power, place) + length.astype(np.uint64)) | np.uint64(1))
    return place, *found


def _writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"part-{part:06d}-{uuid.uuid4().hex}.s8b"
        encoder = once(("encoder", tokenizer), lambda: Encoder(tokenizer))
        ids, nulls, lengths, offsets = [], [], [], []
        waiting, held, total = [], 0, 0
        end = np.array([END], np.uint32)
        with store.open_output_stream(f"{root}/{path}", compression=None) as out:
            out.write(MAGIC)

            def flush(last: bool) -> None:
                nonlocal waiting, held
                values = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
                n = len(values) if last else len(values) // BLOCK * BLOCK
                for b, (words, extra) in enumerate(encode(values[:n])):
                    offsets.append(out.tell())
                    out.write(struct.pack(HEAD, min(BLOCK, n - b * BLOCK), len(words), len(extra)))
                    out.write(words.astype("<u8").tobytes() + extra.astype("<u8").tobytes())
                waiting, held = [values[n:]], len(values) - n

            for batch in batches:
                texts = ["" if t is None else t for t in batch["text"]]
                for start, stop in groups(texts, TEXT):
                    for found in encoder(texts[start:stop]):
                        waiting += [found, end]
                        lengths.append(len(found) + 1)
                        held += lengths[-1]
                    if held >= BUFFER:
                        flush(False)
                ids.append(batch["doc_id"].to_numpy("int64"))
                nulls.append(batch["unknown"].to_numpy().astype("u1"))
            flush(True)
            at, total = out.tell(), sum(lengths)
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(b"".join(x.astype("<i8").tobytes() for x in ids))
            out.write(b"".join(x.tobytes() for x in nulls))
            out.write(np.array(lengths, "<u8").tobytes())
            out.write(struct.pack(TRAILER, at, len(offsets), len(lengths), total, MAGIC))
        yield pd.DataFrame({"part": [part], "path": [path], "docs": [len(lengths)], "ids": [total]})

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the ids of every text of ``docs`` (doc_id, text); returns the staged manifest: one row
    (part, path, docs, ids) for each file. Null texts are empty, null ids come last, equal ids are
    ordered by text."""
    spark = docs.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unknown"), "text")
    )
    written = placed.mapInPandas(_writer(folder, tokenizer), "part int, path string, docs long, ids long")
    return stage(written, "manifest")


class Reader:
    """One file: its directory, and its blocks by their place."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = struct.calcsize(TRAILER)
        at, blocks, docs, self.ids, magic = struct.unpack(TRAILER, self._read(size - tail, tail))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        raw = self._read(at, blocks * 8 + docs * 17)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(at)).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, blocks * 8)
        self.nulls = np.frombuffer(raw, "u1", docs, blocks * 8 + docs * 8).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", docs, blocks * 8 + docs * 9).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of some blocks, without those before them."""
        start, end = int(self.offsets[first]), int(self.offsets[last])
        raw = self._read(start, end - start)
        found, head = [], struct.calcsize(HEAD)
        for at in (self.offsets[first:last] - start).tolist():
            n, words, extra = struct.unpack_from(HEAD, raw, at)
            body = np.frombuffer(raw, "<u8", words + extra, at + head)
            found.append((n, body[:words], body[words:]))
        return decode(found)

    def documents(self) -> Iterator[tuple[int | None, int, list[bytes]]]:
        """(doc_id, length, its ids in pieces of bounded size, as unsigned 32-bit integers)."""
        block, held, used = 0, b"", 0
        for doc, null, length in zip(self.doc_ids.tolist(), self.nulls, self.lengths.tolist()):
            left, pieces = 4 * length, []
            while left:
                if used == len(held):
                    upto = min(block + AHEAD, len(self.offsets) - 1)
                    held, used = self.blocks(block, upto).astype("<u4").tobytes(), 0
                    block = upto
                pieces.append(held[used : used + left])
                used += len(pieces[-1])
                left -= len(pieces[-1])
            yield None if null else doc, length, pieces


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["before"]):
                rows, at = [], int(start)
                for doc, length, pieces in Reader(store, f"{root}/{path}").documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece, crc)
                    rows.append((doc, at, length, crc))
                    at += length
                found = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield found.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    return read


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest.

    The manifest has one row for each file, so the running total of ids over it is small.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "before").repartition(parts, "path").mapInPandas(
        _reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe what they hold.

    An empty table gives files without documents and no rows.
    """
    folder = staging_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, tokenizer or tokenizer_path(), folder)
    return read_tokens(manifest, folder)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
