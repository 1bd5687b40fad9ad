"""Token ids in binary shards with one zstandard dictionary (operator 12).

``write_shards`` encodes texts, orders documents by id over range partitions and
writes files of about ``max_bytes``; ``read_shards`` reads them as a Python data
source, and ``fetch`` reads single documents.  The folder holds

* ``dictionary-<sha256>.zdict``: a zstandard dictionary trained on the serialized
  ids of a bounded sample of documents (SAMPLE_DOCS documents, SAMPLE_CHARS characters of
  each; it decides how small the files are, nothing else);
* shards: a header (MAGIC, the dictionary's SHA-256), one zstandard frame a document (ids as little-endian
  unsigned 32-bit integers), an index (id, tokens, end of the frame; 8 bytes each) and a footer (place of the index, documents, tokens, MAGIC);
* ``manifest.json``: the shards in order, each with its first and last id, documents and tokens.

Files are named by task attempt and count only once the manifest lists them, so a
task that is run again leaves no double documents.  Only a row a shard goes to the driver.
A frame can be read alone: manifest, footer and index lead to it by binary search, and
the header's hash is checked against the dictionary first.

Encoding: a text is cut at ASCII white space, which no token and no step of the vocabulary
crosses; the words and marks of distinct pieces are encoded by the tokenizers library, and remembered (twice REMEMBERED
of them at most in each Python worker).

Defined results: a null or empty text has only the end id; null ids come first; equal ids
stand in order of their text's hash; repeated rows are a document each; a long text is one frame;
an empty table gives a manifest of no shards and no rows; other columns aren't read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import blocks, shared_dir

MAGIC, MANIFEST = b"TOKSHRD1", "manifest.json"
FOOTER = struct.Struct("<QQQ8s")
NO_ID = -(1 << 63)
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 2_000, 8_192, 64 << 10, 3
SHARD_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Bytes of texts that are encoded at once: the more, the fewer distinct pieces a text.
BLOCK, WHITE = 8 << 20, re.compile("[\x20\x09-\x0D]")
SHARD_ROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "documents", "tokens"))])
#: What the vocabulary writes for the bytes of a text (a fixed rule: printable ones stand for themselves, the others follow 255).
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
#: Words that are remembered, twice at most.
REMEMBERED = 250_000
#: A run of Latin letters and the marks behind it; cut there, the vocabulary's pattern finds the same matches.
WORD_AND_MARKS = "^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[.,;:!?]*)$"


class _Memo:
    """What was found lately: once ``most`` entries are new, they become the older half."""

    def __init__(self, most: int, find: Callable[[list[str]], Iterable[bytes]]):
        self.most, self.find, self.new, self.old = most, find, {"": b""}, {}

    def of(self, keys: list[str]) -> list[bytes]:
        """What belongs to ``keys`` (distinct); those that aren't remembered are found together."""
        out = list(map(self.new.get, keys))
        places = [k for k, v in enumerate(out) if v is None]
        if len(self.new) + len(places) > self.most:
            self.new, self.old = {"": b""}, self.new
        again = list(map(self.old.get, [keys[k] for k in places]))
        fresh = self.find([keys[k] for k, v in zip(places, again, strict=True) if v is None])
        for k, v in zip(places, again, strict=True):
            out[k] = self.new[keys[k]] = next(fresh) if v is None else v
        return out


class Encoder:
    """Ids of texts as bytes, by the tokenizers library, for the distinct pieces of many texts at once."""

    def __init__(self, vocabulary: str, memo: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.words, self.rest = _Memo(memo, self._words), _Memo(memo // 4, self._rest)

    def _words(self, new: list[str]) -> Iterator[bytes]:
        """Runs of Latin letters are a word each, so they go straight to the library's model, byte by byte as it wants them."""
        tokenize = self.tokenizer.model.tokenize
        for word in new:
            ids = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN))]
            yield PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _rest(self, new: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False):
            yield struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Ids of each of ``texts`` (strings of about BLOCK bytes in all), and ``end``."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = cut.flatten().dictionary_encode()
        if not len(pieces):
            return [end] * len(texts)
        # a piece is a word and the marks behind it, or else all rest
        parts = pc.extract_regex(pieces.dictionary, pattern=WORD_AND_MARKS)
        word = pc.utf8_lower(pc.fill_null(pc.struct_field(parts, "word"), "")).dictionary_encode()
        rest = pc.if_else(pc.is_valid(parts), pc.struct_field(parts, "marks"), pieces.dictionary).dictionary_encode()
        words = self.words.of(word.dictionary.to_pylist())
        found = words + self.rest.of(rest.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = np.stack([word.indices.to_numpy(), rest.indices.to_numpy() + len(words)], axis=1)[pieces.indices.to_numpy()].ravel()
        starts, counts = (np.cumsum(sizes) - sizes)[index], sizes[index]
        stops = np.cumsum(counts)
        ids = flat[np.repeat(starts - (stops - counts), counts) + np.arange(counts.sum())].tobytes()
        after = 4 * np.concatenate(([0], stops))[2 * np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))]
        return [ids[a:b] + end for a, b in zip(after[:-1].tolist(), after[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    return Encoder(vocabulary)


def _segments(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Blocks of about BLOCK bytes of text, each as its batch and its texts; a longer text comes alone, cut at white space into texts of its own."""
    for batch in blocks(batches, column, BLOCK):
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for part in np.split(np.arange(batch.num_rows), sorted({x for k in np.flatnonzero(sizes > BLOCK).tolist() for x in (k, k + 1)})):
            if len(part):
                some = batch.slice(int(part[0]), len(part))
                yield some, pa.array(_cut(some.column(column)[0].as_py())) if sizes[part[0]] > BLOCK else some.column(column)


def _cut(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        space = WHITE.search(text, at + BLOCK // 4)
        stop = space.end() if space else len(text)
        out.append(text[at:stop])
        at = stop
    return out


def _encoded_rows(batches: Iterator[pa.RecordBatch], column: int, own: Encoder, end: bytes) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch, texts in _segments(batches, column):
        if batch.num_rows == len(texts):
            yield batch, own.encode(texts, end)
        else:
            yield batch, [b"".join(x for k in range(len(texts)) for x in own.encode(texts.slice(k, 1))) + end]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ---- one shard


class ShardWriter:
    def __init__(self, stream: BinaryIO, dictionary: bytes):
        self.stream, self.size, self.tokens = stream, 0, 0
        self.index: list[tuple[int, int, int]] = []
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared is not None:
            shared.precompute_compress(level=LEVEL)  # once, not for each frame
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._put(self.frames.compress(ids))
        n = len(ids) // 4
        self.index.append((NO_ID if doc_id is None else doc_id, n, self.size))
        self.tokens += n

    def close(self) -> None:
        at = self.size
        self._put(np.array(self.index, "<i8").T.tobytes())
        self._put(FOOTER.pack(at, len(self.index), self.tokens, MAGIC))


class Shard:
    """Reads a shard: the footer and index first, then any frames."""

    def __init__(self, file: pa.NativeFile, dictionary: bytes):
        self.file = file
        size = file.size()
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("this is no token shard")
        if file.read_at(32, 8) != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at, n, self.tokens, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or at + 24 * n + FOOTER.size != size:
            raise ValueError("the shard ends early")
        self.ids, self.counts, self.ends = np.frombuffer(file.read_at(24 * n, at), "<i8").reshape(3, n)
        self.starts = np.concatenate(([40], self.ends[:-1])) if n else self.ends
        self.before = np.cumsum(self.counts) - self.counts
        self.frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, first: int, last: int) -> list[bytes]:
        """Ids of the documents from ``first`` up to ``last``, in one read."""
        if first >= last:
            return []
        begin = int(self.starts[first])
        data = memoryview(self.file.read_at(int(self.ends[last - 1]) - begin, begin))
        out = [self.frames.decompress(data[a - begin : b - begin]) for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)]
        if any(len(x) != 4 * n for x, n in zip(out, self.counts[first:last].tolist(), strict=True)):
            raise ValueError("a document hasn't as many ids as its index says")
        return out


# ---- writing


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, *, text_col: str = "text") -> bytes:
    """A dictionary from SAMPLE_DOCS documents at most, chosen by a hash of their text; b'' where there is too little to learn from."""
    n = docs.count()
    share = max(1, n // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(share)) == 0).select(F.substring(text_col, 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_DOCS)
    encoded = _encoded(sample, vocabulary, end_id)
    found = sorted(bytes(r.ids) for r in encoded.collect())
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, found)) // 16)), found, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def _encoded(texts: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(ids) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), struct.pack("<I", end_id)
        for _, ids in _encoded_rows(batches, 0, own, end):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return texts.mapInArrow(run, "ids binary")


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = SHARD_BYTES) -> None:
    """Encodes and writes ``docs`` in ascending order of id; ``end_id`` ends each document."""
    dictionary = train_dictionary(docs, vocabulary, end_id, text_col=text_col)
    system, root = _place(path)
    system.create_dir(root, recursive=True)
    name = f"dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict"
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(dictionary)
    job = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), struct.pack("<I", end_id)
        target, top = _place(path)
        task = TaskContext.get()
        part = task.partitionId()
        stem = f"{job}-{part:06d}-{task.taskAttemptId()}"
        number, shard, stream, file = 0, None, None, ""

        def closed() -> pa.RecordBatch:
            shard.close()
            stream.close()
            ids = shard.index
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "name": file, "first_id": ids[0][0], "last_id": ids[-1][0], "documents": len(ids), "tokens": shard.tokens}], SHARD_ROW)

        try:
            for batch, encoded in _encoded_rows(batches, 1, own, end):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    if shard is not None and shard.size > max_bytes:
                        yield closed()
                        number, shard = number + 1, None
                    if shard is None:
                        file = f"{stem}-{number:05d}.tok"
                        stream = target.open_output_stream(f"{top}/{file}", compression=None)
                        shard = ShardWriter(stream, dictionary)
                    shard.add(doc_id, ids)
            if shard is not None:
                yield closed()
        finally:
            if stream is not None and not stream.closed:
                stream.close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    ranged = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    shards = ranged.mapInArrow(run, "part int, number int, name string, first_id long, last_id long, documents long, tokens long").collect()  # a row a shard
    listed = [{k: r[k] for k in ("name", "first_id", "last_id", "documents", "tokens")} for r in sorted(shards, key=lambda r: (r.part, r.number))]
    with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
        out.write(json.dumps({"dictionary": name, "end_id": end_id, "shards": listed}).encode())


# ---- reading


def _manifest(path: str) -> tuple[fs.FileSystem, str, dict[str, Any]]:
    system, root = _place(path)
    with system.open_input_stream(f"{root}/{MANIFEST}", compression=None) as stream:
        return system, root, json.loads(stream.read())


def _dictionary(system: fs.FileSystem, root: str, manifest: dict[str, Any]) -> bytes:
    with system.open_input_stream(f"{root}/{manifest['dictionary']}", compression=None) as stream:
        return stream.read()


@dataclass
class ShardFile(InputPartition):
    name: str
    before: int

    def __init__(self, name: str, before: int):
        super().__init__(name)
        self.name, self.before = name, before


class TokenShardReader(DataSourceReader):
    """A partition a shard; the tokens of all shards before it come from the manifest."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        shards = _manifest(self.path)[2]["shards"]
        before = np.cumsum([0, *(s["tokens"] for s in shards)]).tolist()
        return [ShardFile(s["name"], b) for s, b in zip(shards, before, strict=False)]

    def read(self, partition: ShardFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, root, manifest = _manifest(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as file:
            shard = Shard(file, _dictionary(system, root, manifest))
            first = 0
            while first < len(shard):
                # about BATCH_BYTES of ids, one document at least
                last = max(first + 1, int(np.searchsorted(shard.before, shard.before[first] + BATCH_BYTES // 4)))
                ids = pa.array([None if i == NO_ID else i for i in shard.ids[first:last].tolist()], pa.int64())
                starts, counts = pa.array(shard.before[first:last] + partition.before), pa.array(shard.counts[first:last])
                yield pa.RecordBatch.from_arrays([ids, starts, counts, pa.array(shard.read(first, last), pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                first = last


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> TokenShardReader:
        return TokenShardReader(dict(self.options))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").load(path)


def fetch(path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document (the first of that id) by the manifest, an index and a frame; None if there is none."""
    system, root, manifest = _manifest(path)
    shards = manifest["shards"]
    at = bisect.bisect_left([s["last_id"] for s in shards], doc_id)
    if at == len(shards) or shards[at]["first_id"] > doc_id:
        return None
    with system.open_input_file(f"{root}/{shards[at]['name']}") as file:
        shard = Shard(file, _dictionary(system, root, manifest))
        k = int(np.searchsorted(shard.ids, doc_id))
        return np.frombuffer(shard.read(k, k + 1)[0], "<u4") if shard.ids[k] == doc_id else None


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The query's columns, from shards written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary, end_id)
    return read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
