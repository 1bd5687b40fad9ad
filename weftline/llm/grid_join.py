"""Near-duplicates of embeddings by an epsilon grid order join (operator 5).

After Böhm et al., "Epsilon Grid Order" (2001).  Unit vectors of cosine c or
more lie within epsilon = sqrt(2 - 2c) of each other, in any projection too.

1. Equal vectors are one class with a weight; its least id stands for it.
2. The leading DIMS principal directions of a bounded sample (``max_sample``)
   give a projection.  Classes are sorted by their grid cells on the first CELLS of
   them, dimension by dimension, and the sequence is cut at wide gaps into intervals of
   at most LEAF vectors, each packed in one row with its bounding box.
3. A tree of intervals, FANOUT to a node, is descended from its root's pair with
   itself: pairs of nodes whose boxes are further apart than epsilon are
   dropped, the others are replaced by the pairs of their children.
4. The remaining pairs of leaves are dealt to tiles of TILE by TILE leaves, so a leaf
   is sent once for TILE partners.  A task halves each pair down to STEP vectors,
   skipping distant halves again, then skips the vectors that are further apart
   than epsilon in the projection, and compares the others by exact cosines in
   double precision.  It returns the number of links of each class, and for the
   components no more links than it has classes.

The sample only steers the order: every pair that isn't provably distant is
compared, whatever the projection.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers link with nothing; vectors of different lengths don't link; a row with
a null id links with nothing, its component is null and it isn't kept; repeated
rows link with each other; rows that share an id but not the vector are linked each by its own
vector (their ids alone link nothing); an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

DIMS, CELLS, LEAF, STEP, FANOUT, TILE = 16, 6, 1024, 256, 16, 8
#: A leaf of long vectors has fewer, so that its numbers in double precision stay at about LEAF_BYTES.
LEAF_BYTES, LEAST_LEAF = 4 << 20, 64


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): v an array of floats (as in the table) or doubles that can link, or null."""
    v = F.col(f"`{vector_col}`")
    if dict(df.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)) & F.col(f"`{id_col}`").isNotNull(), v).alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest number first so that nothing over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def directions(classes: DataFrame, size: int, max_sample: int) -> np.ndarray:
    """Leading principal directions (size x DIMS, orthonormal) of at most ``max_sample`` unit vectors."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").toArrow().column("v").combine_chunks()
    x = _unit(_matrix(sample, size))
    if len(x) < 2:  # no direction leads
        return np.eye(size)[:, :DIMS]
    _, _, axes = np.linalg.svd(np.cov((x - x.mean(axis=0)).T).reshape(size, size))
    return axes[:DIMS].T


def _leaves(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """(part, place, low, high, ids, weights, vectors) of each interval of the sequence."""
    dims, vectors = min(CELLS, axes.shape[1]), dict(classes.dtypes)["v"]
    most = min(LEAF, max(LEAST_LEAF, LEAF_BYTES // (8 * axes.shape[0])))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_unit(_matrix(batch.column("v"), axes.shape[0])) @ axes[:, :dims] / epsilon * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(dims))], [*batch.schema.names, *(f"c{k}" for k in range(dims))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in [*batches, None]:
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            while rows >= most or (batch is None and rows):
                table = pa.Table.from_batches(held)
                x = _matrix(table.column("v").slice(0, most).combine_chunks(), axes.shape[0])
                p = _unit(x) @ axes
                steps = (np.diff(p, axis=0) ** 2).sum(axis=1)
                # an interval ends at the widest gap in its second half
                n = len(x) if len(x) < most else most // 2 + int(np.argmax(steps[most // 2 - 1 :])) if len(steps) else 1
                x, p, leaf, rest = x[:n], p[:n], table.slice(0, n).combine_chunks(), table.slice(n)
                held, rows = rest.to_batches(), rest.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part]),
                        pa.array([place]),
                        pa.array([p.min(axis=0).tolist()]),
                        pa.array([p.max(axis=0).tolist()]),
                        *(pa.array([y.tobytes()], pa.binary()) for y in (leaf.column("id").to_numpy(), leaf.column("weight").to_numpy(), x)),
                    ],
                    ["part", "place", "low", "high", "ids", "weights", "vectors"],
                )
                place += 1

    cells = [f"c{k}" for k in range(dims)]
    ordered = classes.select("id", "weight", "v").mapInArrow(project, f"id long, weight long, v {vectors}, {', '.join(f'{c} int' for c in cells)}")
    ordered = ordered.repartitionByRange(*cells, "id").sortWithinPartitions(*cells, "id")
    return ordered.select("id", "weight", "v").mapInArrow(pack, "part long, place long, low array<double>, high array<double>, ids binary, weights binary, vectors binary")


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with node: their place in the whole sequence.  The driver sees one count for each partition."""
    counts = leaves.groupBy("part").count().orderBy("part").collect()
    starts = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    start = leaves.sparkSession.createDataFrame([(r.part, s) for r, s in zip(counts, starts, strict=False)], "part long, start long")
    return leaves.join(F.broadcast(start), "part").withColumn("node", F.col("start") + F.col("place")).drop("part", "place", "start")


def _near(epsilon: float):
    """Whether the boxes (low, high) and (low2, high2) are within epsilon."""
    gaps = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon


def _leaf_pairs(leaves: DataFrame, epsilon: float) -> DataFrame:
    """(a, b), a <= b: pairs of leaves that may hold a link."""
    level = materialise(leaves.select("node", "low", "high"))
    tree = [level]
    while tree[-1].count() > 1:
        up = tree[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node"))
        box = lambda c, f, g: F.array(*[f(F.get(c, k)) for k in range(g)])
        tree.append(materialise(up.agg(box("low", F.min, DIMS).alias("low"), box("high", F.max, DIMS).alias("high"))))
    pairs = tree[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(tree[:-1]):
        one = level.select(F.floor(F.col("node") / FANOUT).alias("a"), F.col("node").alias("x"), "low", "high")
        two = level.select(F.floor(F.col("node") / FANOUT).alias("b"), F.col("node").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        found = pairs.join(one, "a").join(two, "b").where((F.col("x") <= F.col("y")) & _near(epsilon))
        pairs = materialise(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


def _apart(p: np.ndarray, q: np.ndarray, epsilon: float) -> bool:
    gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
    return float((gap * gap).sum()) > epsilon * epsilon


class _Found:
    """Links of one tile."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        self.full = 0  # pairs of vectors that reached the exact cosine

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Counts the links (i, j) and joins their trees, all at once: roots hook to smaller ones, then all point at their root."""
        np.add.at(self.links, i, self.weights[j])
        np.add.at(self.links, j, self.weights[i])
        while True:
            p, q = self.root[i], self.root[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, i: int, j: int, same: bool, cut: float, epsilon: float, found: _Found) -> None:
    """Links between two intervals that start at positions i and j, by halves."""
    if not len(x) or not len(y) or (not same and _apart(px, py, epsilon)):
        return
    if max(len(x), len(y)) > STEP:
        h, k = (len(x) + 1) // 2, (len(y) + 1) // 2
        _join(x[:h], y[:k], px[:h], py[:k], i, j, same, cut, epsilon, found)
        _join(x[:h], y[k:], px[:h], py[k:], i, j + k, False, cut, epsilon, found)
        if not same:
            _join(x[h:], y[:k], px[h:], py[:k], i + h, j, False, cut, epsilon, found)
        _join(x[h:], y[k:], px[h:], py[k:], i + h, j + k, same, cut, epsilon, found)
        return
    # squared distances in the projection; 1e-9 is far above their rounding
    near = (px * px).sum(axis=1)[:, None] + (py * py).sum(axis=1)[None, :] - 2 * (px @ py.T) <= epsilon * epsilon + 1e-9
    if same:
        near = np.triu(near, 1)
    at, to = np.nonzero(near)
    found.full += len(at)
    if len(at) * 4 > near.size:
        close = (x @ y.T)[at, to] >= cut
    else:
        close = np.einsum("ij,ij->i", x[at], y[to]) >= cut
    if close.any():
        found.add(at[close] + i, to[close] + j)


def _tiles(pairs: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` and the leaves that they name, both with the numbers of their tile (i, j)."""
    tile = [F.floor(F.col(c) / TILE).alias(t) for c, t in (("a", "i"), ("b", "j"))]
    dealt = pairs.select(*tile, "a", "b")
    needed = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    return dealt, needed.join(leaves.select("node", "ids", "weights", "vectors"), "node")


def _compare(pairs: DataFrame, leaves: DataFrame, axes: np.ndarray, cut: float, epsilon: float, dtype: str) -> DataFrame:
    """Rows (id, n, other): n more links of a class, or a link (id, other) of a spanning forest."""
    size = axes.shape[0]

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("node")
        start = dict(zip(held.node, np.cumsum([0, *(len(x) // 8 for x in held.ids[:-1])]), strict=True))
        found = _Found(*(np.frombuffer(b"".join(held[c]), np.int64) for c in ("ids", "weights")))
        units = {n: _unit(np.frombuffer(v, dtype).reshape(-1, size)) for n, v in zip(held.node, held.vectors, strict=True)}
        shadows = {n: x @ axes for n, x in units.items()}
        for a, b in zip(asked.a, asked.b, strict=True):
            _join(units[a], units[b], shadows[a], shadows[b], start[a], start[b], a == b, cut, epsilon, found)
        some, child = np.flatnonzero(found.links), np.flatnonzero(found.root != np.arange(len(found.root)))
        return pd.DataFrame(
            {
                "id": np.concatenate([found.ids[some], found.ids[child]]),
                "n": np.concatenate([found.links[some], np.zeros(len(child), np.int64)]),
                "other": pd.array([None] * len(some) + found.ids[found.root[child]].tolist(), "Int64"),
            }
        )

    asked, held = _tiles(pairs, leaves)
    asked, held = asked.toDF("i", "j", "a", "b"), held.select("i", "j", "node", "ids", "weights", "vectors").toDF("k", "l", "node", "ids", "weights", "vectors")
    return asked.groupBy("i", "j").cogroup(held.groupBy("k", "l")).applyInPandas(compare, "id long, n long, other long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.95, max_sample: int = 20_000) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row.  See the module's docstring."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    rows = materialise(_usable(df, id_col, vector_col).withColumn("key", F.sha2(F.to_json("v").cast("binary"), 256)))
    fine = rows.where("v IS NOT NULL")
    classes = materialise(fine.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")).withColumn("class", F.monotonically_increasing_id()))
    links = None
    for size in [r[0] for r in classes.select(F.size("v")).distinct().orderBy("size(v)").collect()]:
        own = classes.where(F.size("v") == size).select(F.col("class").alias("id"), "key", "weight", "v")
        axes = directions(own, size, max_sample)
        axes = np.pad(axes, ((0, 0), (0, DIMS - axes.shape[1])))
        leaves = materialise(_numbered(materialise(_leaves(own, axes, epsilon))))
        pairs = _leaf_pairs(leaves, epsilon)
        dtype = "<f4" if dict(own.dtypes)["v"] == "array<float>" else "<f8"
        found = materialise(_compare(pairs, leaves, axes, cosine, epsilon, dtype))
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    components = connected_components(links.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    # a component's id is the least id of its classes' rows
    joined = components.select(F.col("id").alias("class"), "component").join(classes.select("class", "id"), "class")
    named = joined.groupBy("component").agg(F.min("id").alias("least"))
    known = classes.select("key", "class", "id", "weight").join(counts, "class", "left").join(joined.select("class", "component").join(named, "component").select("class", "least"), "class", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    linked = fine.join(known, "key").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
