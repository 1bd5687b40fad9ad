"""MinHash near-duplicates (operator 6).

1. Each text becomes its set of word shingles (64-bit hashes), the minima of
   many universal hash functions over it, and from those one key per band.
2. Equal sets are one class; its least id stands for it from here on.
3. Within each band bucket every member is paired with the bucket's least
   member.  A pair goes on if the signatures agree enough, then is confirmed on
   the full sets.  Components of these links follow by large-star/small-star.
4. What that leaves out are pairs of one bucket in different components.  Such
   buckets are cut into blocks of bounded size, and block pairs are compared
   exactly on full sets; inside a component nothing is compared again, and at
   most one link per member and block pair is returned.  So no link between
   components is lost, and no list of all pairs is made.

Defined results: null, empty or blank texts have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle; rows that share
an id are one document (a link of one links both); a row with a null id links
with nothing, its component is null and it isn't kept.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO, blocks, materialise
from .components import connected_components

#: Minima in a band, and the chance that a pair at the threshold shares no band.
ROWS, MISS = 5, 1e-6
#: Most members of a block that is compared in one task.
BLOCK = 256


class _Words(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, n: int, words: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    words = _Words() if words is None else words
    h = np.array(list(map(words.__getitem__, parts)), np.uint64)
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def minima(sets: np.ndarray, hashes: int) -> np.ndarray:
    """Least values of ``hashes`` universal (multiply-shift) functions over a set."""
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(1, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, hashes, np.uint64)
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(sets), 4096):
            out = np.minimum(out, ((sets[i : i + 4096, None] * a + b) >> np.uint64(20)).min(axis=0))
    return out


def features(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, n_shingles, key, bands, sig) of each row; key identifies the set and is null for an empty one."""
    bands = n_bands(percent)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in blocks(batches, 1):
            sets = [shingles(t, n, words) for t in batch.column(1).to_pylist()]
            sigs = [minima(s, bands * ROWS) if len(s) else None for s in sets]
            keys = [None if m is None else [xxhash.xxh3_64_intdigest(m[i * ROWS : i * ROWS + ROWS].tobytes(), i) - 2**63 for i in range(bands)] for m in sigs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([None if m is None else m.astype(np.uint16).tobytes() for m in sigs], pa.binary()),
                ],
                ["id", "n_shingles", "key", "bands", "sig"],
            )

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(compute, "id long, n_shingles long, key binary, bands array<long>, sig binary")


def _sets(df: DataFrame, id_col: str, text_col: str, n: int, ids: DataFrame) -> DataFrame:
    """(id, set) of the rows whose id is in ``ids``; a set is packed unsigned 64-bit integers."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in blocks(batches, 1):
            sets = [shingles(t, n, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(ids, "id", "left_semi").mapInArrow(compute, "id long, set binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree as often as pairs at the threshold do, less six standard deviations."""
    hashes, t = n_bands(percent) * ROWS, percent / 100
    least = hashes * (t - 6 * math.sqrt(t * (1 - t) / hashes))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, hashes) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(agree, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    shared = np.flatnonzero(np.bincount(at, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    out = np.zeros((len(left), len(right)), np.float32)
    use = column[at] >= 0
    owner, at = owner[use], column[at][use]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, len(shared), 8192):
        lo, hi = np.searchsorted(at, (start, start + 8192))
        x = np.zeros((len(left) + len(right), 8192), np.float32)
        x[owner[lo:hi], at[lo:hi] - start] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _block_links(percent: int):
    """Compares one pair of blocks of a bucket and returns links between components, at most one per member and pass."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["id", "side"])
        left, right = (rows[rows.side == s].reset_index(drop=True) for s in (0, 1))
        if not len(right):
            right = left
        if not len(left):
            left = right
        xs, ys = ([np.frombuffer(s, np.uint64) for s in part.set] for part in (left, right))
        both = _overlaps(xs, ys)
        total = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :]
        close = (100 * both >= percent * (total - both)) & (left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        links = []
        for i, j in zip(*np.nonzero(close), strict=True):
            p, q = root(left.component[i]), root(right.component[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((left.id[i], right.id[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _rest(members: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components so far."""
    known = members.join(components, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    each = known.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"))
    buckets = (
        each.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("components"), F.sum("mark").alias("mark"))
        .where("n > 2 AND components > 1")
    )
    # buckets of several bands with the same members are compared once
    once = buckets.groupBy("n", "mark").agg(F.min(F.struct("bucket", "top")).alias("one")).select("one.bucket", "n", F.col("one.top.n").alias("n_top"), F.col("one.top.component").alias("top"))
    # blocks 0..k-1 hold the largest component, k..m-1 the others; two blocks of the former are not compared
    pieces = lambda n: F.ceil(n / BLOCK).cast("long")
    cut = known.join(once, "bucket").withColumns({"k": pieces(F.col("n_top")), "m": pieces(F.col("n_top")) + pieces(F.col("n") - F.col("n_top"))})
    h = F.xxhash64("id")
    block = F.when(F.col("component") == F.col("top"), F.pmod(h, F.col("k"))).otherwise(F.col("k") + F.pmod(h, F.col("m") - F.col("k")))
    cut = cut.withColumn("block", block)
    other = F.explode(F.when(F.col("block") < F.col("k"), F.sequence("k", F.col("m") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    dealt = cut.withColumn("other", other).select(
        "bucket", "id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    return dealt.join(sets, "id").groupBy("bucket", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of ``df``.

    Rows link where 100 * |intersection| >= percent * |union| of their shingle
    sets; component_id is the least id reachable.  See the module's docstring.
    """
    rows = materialise(features(df, id_col, text_col, words, percent))
    full = rows.where("key IS NOT NULL AND id IS NOT NULL")
    classes = full.groupBy("key").agg(F.min(F.struct("id", "bands", "sig")).alias("one")).select("key", "one.*")
    classes = materialise(classes)
    every = classes.select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = every.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    members = materialise(every.join(sizes, "bucket").select("bucket", "id", "n", "first"))
    pairs = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    sets = materialise(_sets(df, id_col, text_col, words, members.select("id").distinct()).distinct())
    links = materialise(_confirmed(_agreeing(pairs, classes.select("id", "sig"), percent), sets, percent))
    components = materialise(connected_components(links))
    more = _rest(members.where("n > 2").select("bucket", "id"), components, sets, percent).unionByName(_shared_ids(full, classes))
    of_class = classes.join(components, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    more = materialise(more)
    if not more.isEmpty():
        joined = more
        for end in ("a", "b"):
            joined = joined.join(components.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
        merged = connected_components(joined).select(F.col("id").alias("component_id"), F.col("component").alias("last"))
        of_class = of_class.join(merged, "component_id", "left").select("key", F.coalesce("last", "component_id").alias("component_id"))
    linked = full.join(of_class, "key").select("id", "n_shingles", "component_id")
    alone = rows.where("key IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _shared_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    twice = full.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    keys = full.join(twice, "id").select("id", "key").distinct()
    return keys.join(classes.select("key", F.col("id").alias("b")), "key").where("id <> b").select(F.col("id").alias("a"), "b")
