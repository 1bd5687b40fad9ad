"""Ranked lexical search with bit-sliced Bloom signatures (operator 11).

``build_index`` reads each text once and writes blocks of documents of one size class:

* a signature of ``width`` rows (slices) of a bit a document.  A term of a document sets
  HASHES rows of its column, and again, under another hash, for each of the levels 2, 4, 8 that its
  count reaches.  A class has at least BITS rows for each of its terms and levels, and
  as few documents in a block as keep its slices at about BLOCK_BITS bits;
* the ids, lengths and highest counts of its documents, and their texts for exact scores,

and beside them how many documents of each task hold each term.

``search`` reads the signatures block by block.  The slices of a term, joined by AND, are a bitmap of the
documents that may hold it: all that do, and a few more.  Sums of these bitmaps weighted by the terms' weights,
level by level, times what a count of that level can give in a document of that length, are upper bounds of the scores.
A document whose bound for an item lies below the 20th exact score that the task has
found for it is provably not among the best; every other one is scored exactly from its text.  The
best of each task are ranked at last, a few rows a task and item.

Terms are runs of ASCII letters and digits and of all characters outside ASCII, A-Z lower-cased.  Weights take
the exact document counts.  Items are taken in blocks of about ITEMS items, one pass over the blocks of documents for each; their terms go to every task.

Defined results: null texts, and texts without terms, have no terms, aren't counted and are never found; items
without terms find nothing; documents with equal ids are ranked each by itself, as are items with equal ids and other
texts (equal rows of items are one); null ids come last among equal scores; a long text is one document, in a block of few; an empty
table on either side gives no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MEMO, blocks, shared_dir

TOP, ITEMS = 20, 1_000
HASHES, BITS, LEVELS = 4, 16, (1, 2, 4, 8)
BLOCK_BITS, LEAST_DOCS, MOST_DOCS = 1 << 22, 8, 2_048
BLOCK_TEXT = 8 << 20
#: Terms counted in a task before their counts are handed on.
COUNTED = 200_000
#: Terms of items whose counts go to every task; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000
# fixed values: separators of terms, and lower case
_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_TABLE = bytes(0x20 if b in _BREAKS else _LOWER[b] for b in range(256))
INDEX = "term binary, df long, words long, width long, doc_ids array<long>, lengths array<long>, highest array<long>, slices binary, texts array<binary>"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_TABLE).split()


class _Hashes(dict):
    """64-bit hashes of terms, bounded."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[term] = xxhash.xxh3_64_intdigest(term)
        return value


def slice_rows(hashes: np.ndarray, width: int) -> np.ndarray:
    """HASHES rows of the signature for each hash."""
    first, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the same terms at a level of their count."""
    return hashes if level == 0 else (hashes ^ np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)


class _Class:
    """Documents of one size class that wait for their block."""

    def __init__(self, width: int):
        self.width = width
        self.room = min(MOST_DOCS, max(LEAST_DOCS, BLOCK_BITS // width))
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.highest, self.texts, self.rows, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes, counts: np.ndarray, hashes: np.ndarray) -> None:
        keys = [at_level(hashes[counts >= least], k) for k, least in enumerate(LEVELS)]
        self.rows.append(np.unique(slice_rows(np.concatenate(keys), self.width)))
        self.ids.append(doc_id)
        self.lengths.append(int(counts.sum()))
        self.highest.append(int(counts.max()))
        self.texts.append(text)
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.room or self.bytes > BLOCK_TEXT

    def block(self) -> dict:
        bits = np.zeros((self.width, -(-len(self.ids) // 8) * 8), bool)
        bits[np.concatenate(self.rows), np.repeat(np.arange(len(self.rows)), [len(r) for r in self.rows])] = True
        out = {"width": self.width, "doc_ids": self.ids, "lengths": self.lengths, "highest": self.highest, "slices": np.packbits(bits, axis=1).tobytes(), "texts": self.texts}
        self.clear()
        return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("words", pa.int64()), ("width", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "lengths", "highest")), ("slices", pa.binary()), ("texts", pa.list_(pa.binary()))])
    memo, classes, holders = _Hashes(), {}, Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{"term": t, "df": n} for t, n in holders.items()], schema)
        holders.clear()
        return out

    for batch in blocks(batches, 1):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(terms(text))
            if not found:
                continue
            holders.update(found.keys())
            counts = np.fromiter(found.values(), np.int64, len(found))
            keys = sum(int((counts >= least).sum()) for least in LEVELS)
            width = max(256, 1 << (BITS * keys - 1).bit_length())
            group = classes.setdefault(width, _Class(width))
            group.add(doc_id, text, counts, np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))
            if group.full:
                yield pa.RecordBatch.from_pylist([{"words": sum(group.lengths)} | group.block()], schema)
            if len(holders) >= COUNTED:
                yield counted()
    for group in classes.values():
        if group.ids:
            yield pa.RecordBatch.from_pylist([{"words": sum(group.lengths)} | group.block()], schema)
    if holders:
        yield counted()


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of ``docs`` to ``path`` as Parquet: rows of blocks, and rows (term, df) of each task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows.mapInArrow(_indexed, INDEX).write.parquet(path)


class _Query:
    """A block of items: their distinct terms and, item by item, places of terms with weights and repeats."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]], df: dict[bytes, int], n: int, words: int):
        self.n, self.words = n, words
        self.terms = sorted({t for _, found in items for t in found})
        place = {t: k for k, t in enumerate(self.terms)}
        self.items = [i for i, _ in items]
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms}
        pairs = [(place[t], weight[t] * k) for _, found in items for t, k in found.items()]
        self.place, self.weight = np.array([p for p, _ in pairs], np.int64), np.array([w for _, w in pairs], np.int64)
        sizes = [len(found) for _, found in items]
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)
        self.known = place

    def m(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths * self.n) // self.words

    def bounds(self, width: int, slices: bytes, lengths: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores (items, documents): weighted sums of the terms' bitmaps."""
        columns = -(-len(lengths) // 8)
        table = np.frombuffer(slices, np.uint8).reshape(width, columns)
        m, out, below = self.m(lengths), None, np.zeros(len(lengths), np.int64)
        for level in range(len(LEVELS)):
            top = highest if level + 1 == len(LEVELS) else np.minimum(highest, LEVELS[level + 1] - 1)
            most = (1_000_000_000 * top) // (1000 * top + 12 * m)
            bitmap = np.bitwise_and.reduce(table[slice_rows(at_level(self.hashes, level), width)], axis=1)
            there = np.flatnonzero(bitmap.any(axis=1))
            if not len(there) or not (most > below).any():
                below = np.maximum(most, below)
                continue
            bits = np.unpackbits(bitmap, axis=1, count=len(lengths))
            sums = np.add.reduceat(bits[self.place] * self.weight[:, None], self.starts, axis=0)
            part = sums * np.maximum(most - below, 0)
            out = part if out is None else out + part
            below = np.maximum(most, below)
        return np.zeros((len(self.items), len(lengths)), np.int64) if out is None else out

    def exact(self, text: bytes, length: int) -> np.ndarray:
        """Scores of one document for all items."""
        gives = np.zeros(len(self.terms), np.int64)
        m = int(self.m(np.array([length]))[0])
        for t, tf in Counter(terms(text)).items():
            k = self.known.get(t)
            if k is not None:
                gives[k] = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
        return np.add.reduceat(gives[self.place] * self.weight, self.starts)


def _searched(query: _Query, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in query.items]  # heaps of (score, ids from the highest on)
        least = np.ones(len(query.items), np.int64)
        scored = read = 0
        for batch in batches:
            for row in range(batch.num_rows):
                width, ids, lengths, highest, slices, texts = (batch.column(c)[row] for c in range(6))
                ids, length = ids.as_py(), np.array(lengths.as_py(), np.int64)
                bound = query.bounds(width.as_py(), slices.as_py(), length, np.array(highest.as_py(), np.int64))
                read += len(ids)
                for d in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                    if not (bound[:, d] >= least).any():
                        continue
                    scored += 1
                    scores = query.exact(texts[d].as_py(), int(length[d]))
                    key = -math.inf if ids[d] is None else -ids[d]
                    for i in np.flatnonzero((scores >= least) & (scores > 0)).tolist():
                        heap, entry = best[i], (int(scores[i]), key, ids[d])
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry[:2] > heap[0][:2]:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == top:
                            least[i] = heap[0][0]
        found = [(query.items[i], d, s) for i, heap in enumerate(best) for s, _, d in heap]
        columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([scored] * len(found), pa.int64()), pa.array([read] * len(found), pa.int64())], ["item", "doc_id", "score", "scored", "read"])

    return run


def search(spark: SparkSession, index: str, items: DataFrame, *, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    table = spark.read.schema(INDEX).parquet(index)
    blocks_, holders = table.where("width IS NOT NULL"), table.where("term IS NOT NULL")
    n, words = blocks_.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).distinct()
    shares = max(1, -(-asked.count() // ITEMS))
    kind = items.schema[id_col].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for share in range(shares if words else 0):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == share).collect()  # about ITEMS rows
        found = [(r.item_id, dict(Counter(terms(bytes(r.text))))) for r in own if r.text is not None]
        found = [(i, f) for i, f in found if f]
        if not found:
            continue
        wanted = spark.createDataFrame([(t,) for t in {t for _, f in found for t in f}], "term binary")
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
        df = {bytes(r.term): r.df for r in holders.join(few, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        query = _Query([(k, f) for k, (_, f) in enumerate(found)], df, n, words)
        ranked = blocks_.select("width", "doc_ids", "lengths", "highest", "slices", "texts").mapInArrow(_searched(query, top), "item long, doc_id long, score long, scored long, read long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(found)], f"item long, item_id {kind.simpleString()}")
        best = ranked.select("item", "doc_id", "score", place.cast("int").alias("rank")).where(F.col("rank") <= top)
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def ranked(docs: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """Indexes ``docs`` in the shared folder and searches it for all ``items``."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/signatures-{uuid.uuid4().hex}"
    build_index(docs, path)
    return search(spark, path, items, top=top)
