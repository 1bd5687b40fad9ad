"""Mean lines, line distances and medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.affine import AXES
from ..sources.files import materialise
from .spatial import morton

#: Lines are cut into up to BLOCKS blocks of BLOCK lines at least, or more blocks of MOST_BLOCK lines; TILE lines of a block are compared at once.
BLOCK, MOST_BLOCK, BLOCKS, TILE = 256, 16_384, 12, 256
#: Pairs of blocks are dealt to this many tasks at most.
MOST_TASKS = 8_192
HASH, MODULUS = 2654435761, 4294967296


def as_arrays(resampled: DataFrame) -> DataFrame:
    """(sid, xyz): the coordinates of each resampled line (sid, k, x, y, z) in one array, in order."""
    point = F.struct("k", F.array(*AXES).alias("p"))
    return resampled.groupBy("sid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(point)), lambda s: s["p"])).alias("xyz"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean distance of points, direct or with the second line turned, of all lines of ``a`` and ``b`` (lines, points, 3)."""
    out = np.empty((len(a), len(b)))
    for i, line in enumerate(a):
        direct = np.sqrt(((line[None] - b) ** 2).sum(axis=2)).mean(axis=1)
        turned = np.sqrt(((line[None] - b[:, ::-1]) ** 2).sum(axis=2)).mean(axis=1)
        out[i] = np.minimum(direct, turned)
    return out


def _cube(xyz: pd.Series) -> np.ndarray:
    return np.stack(xyz.to_list()).reshape(len(xyz), -1, 3)


def _dealt(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Rows (cell, sid, xyz) of two sides, each once for every pair of blocks (p of the left, q of the right side of a cell) that its block is in.

    Without ``right`` the lines of a cell meet each other: each pair of blocks once, p <= q, so ``same`` tells where a pair of lines would come twice.
    A full cell is a task for each pair of its blocks, and a line is copied once for MOST_BLOCK lines of it.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        return df.groupBy("cell").agg(F.greatest(F.ceil(n / MOST_BLOCK), F.least(F.ceil(n / BLOCK), F.lit(BLOCKS))).cast("int").alias(name))

    sizes = blocks(left, "ps").withColumn("qs", F.col("ps")) if right is None else blocks(left, "ps").join(blocks(right, "qs"), "cell")
    parts = []
    for side, df, own, other in ((0, left, "p", "q"), (1, left if right is None else right, "q", "p")):
        block = F.pmod(F.xxhash64("sid"), F.col(f"{own}s")).cast("int").alias(own)
        first = F.col("p") if right is None and side == 0 else F.lit(0)
        last = F.col("q") if right is None and side == 1 else F.col(f"{other}s") - 1
        placed = df.join(sizes, "cell").select("cell", "sid", "xyz", block, "ps", "qs")
        parts.append(placed.withColumn(other, F.explode(F.sequence(first, last))).select("cell", "p", "q", F.lit(side).alias("side"), "sid", "xyz"))
    return parts[0].unionByName(parts[1]).withColumn("same", F.lit(right is None) & (F.col("p") == F.col("q")))


def _means(cube: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean points (lines, runs, 3) of quarters of each line, and the share of each run; a turned line has the same runs turned."""
    n = cube.shape[1]
    cuts = sorted({0, n // 4, *([n // 2] if n % 2 == 0 else []), n - n // 4, n})
    shares = np.diff(cuts) / n
    return np.stack([cube[:, a:b].mean(axis=1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1), shares


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns whose product is the squared distance of points of ``x`` and ``y`` (points, 3)."""
    one = lambda v: np.ones((len(v), 1))
    square = lambda v: (v * v).sum(axis=1, keepdims=True)
    return np.hstack([x, square(x), one(x)]), np.hstack([-2 * y, one(y), square(y)]).T


def _singles(cube: np.ndarray, middle: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (points, lines, 5) and columns (points, 5, lines) in single precision whose product is the squared distance of points times their share, and each line's greatest square."""
    weight = shares[:, None] * (1 - (len(shares) + 4) * 2.0**-23)  # roots are added up in single precision too
    with np.errstate(over="ignore", invalid="ignore"):
        p = np.ascontiguousarray(((cube - middle) * weight).transpose(1, 2, 0))
        square = p[:, 0] * p[:, 0] + p[:, 1] * p[:, 1] + p[:, 2] * p[:, 2]
        one = np.ones((len(p), 1, len(cube)))
        rows = np.concatenate([p, square[:, None], one], axis=1).astype(np.float32).transpose(0, 2, 1)
        columns = np.concatenate([-2 * p, one, square[:, None]], axis=1).astype(np.float32)
    return np.ascontiguousarray(rows), columns, square.max(axis=0, initial=0.0)


def _off(most: float) -> float:
    """What squared distances in single precision may be off by, at most 26 roundings of the greatest square; infinite where it can't hold them."""
    return most * 2.0**-18 + 1e-36 if most < 1e37 else np.inf


def _roots(rows: np.ndarray, columns: np.ndarray, off: float, close: bool = True) -> np.ndarray:
    """Lower bounds, in single precision, of the mean distances of points, direct or with the second line turned.

    Without ``close`` pairs with points nearer than what squares may be off by may be NaN.
    """
    n, rows = columns.shape[2], rows.copy()
    rows[:, :, 3] -= np.float32(off)
    both = np.concatenate([columns, columns[::-1]], axis=2)
    out, d = np.zeros((rows.shape[1], 2 * n), np.float32), np.empty((rows.shape[1], 2 * n), np.float32)
    with np.errstate(invalid="ignore"):
        for row, column in zip(rows, both, strict=True):
            np.matmul(row, column, out=d)
            if close and d.min() < 0:
                np.maximum(d, 0, out=d)
            np.sqrt(d, out=d)
            out += d
    return np.minimum(out[:, :n], out[:, n:])


def _at_least(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of lines by their mean points: a mean distance of points isn't below that of their means."""
    if len(x) and len(y):
        middle = x.mean(axis=(0, 1))
        (rows, _, own), (_, columns, other) = _singles(x, middle, shares), _singles(y, middle, shares)
        off = _off(max(own.max(), other.max()))
        if off < np.inf:
            return _roots(rows, columns, off)
    return np.zeros((len(x), len(y)), np.float32)


def _sums(lines: np.ndarray, others: np.ndarray, at_once: int = 256) -> np.ndarray:
    """For each of ``others`` (n, points, 3) the sum of its distances to ``lines``.

    Squared distances come from matrix products; those so small beside the points' own squares that digits are lost are taken from differences.
    """
    total, points = np.zeros(len(others)), lines.shape[1]
    for j in range(0, len(others), at_once):
        q = others[j : j + at_once]
        right = [_squares(q[:0, 0], q[:, k])[1] for k in range(points)]
        least = 1e-3 * (q * q).sum(axis=2).max(initial=0.0)
        for i in range(0, len(lines), at_once):
            p = lines[i : i + at_once]
            close = max(least, 1e-3 * (p * p).sum(axis=2).max(initial=0.0))
            d, both = np.empty((len(p), len(q))), []
            for turn in (False, True):
                out = np.zeros((len(p), len(q)))
                for k in range(points):
                    m = points - 1 - k if turn else k
                    np.matmul(_squares(p[:, k], q[:0, 0])[0], right[m], out=d)
                    if d.min() < close:
                        a, b = np.nonzero(d < close)
                        d[a, b] = ((p[a, k] - q[b, m]) ** 2).sum(axis=1)
                    out += np.sqrt(d, out=d)
                both.append(out)
            total[j : j + at_once] += np.minimum(*both).sum(axis=0) / points
    return total


def _tiles(cube: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines and ids in Morton order of their mean points, and the boxes (2, tiles, 3) of the mean points of TILE lines each, widened by what means may be off by."""
    order = morton(cube.mean(axis=1))
    cube, sid = cube[order], sid[order]
    means, off = cube.mean(axis=1), 1e-9 * np.abs(cube).max(initial=0.0)
    at = np.arange(0, len(cube), TILE)
    return cube, sid, np.stack([np.minimum.reduceat(means, at) - off, np.maximum.reduceat(means, at) + off])


class _Bounds:
    """Lower bounds of the distances of tiles of two blocks, by mean points or all points (``shares`` of each); squares are made once a block."""

    def __init__(self, p: np.ndarray, q: np.ndarray, shares: np.ndarray, limit: float):
        middle = p.mean(axis=(0, 1))
        self.p, self.q, self.shares = p, q, shares
        self.most, self.enough = np.nextafter(np.float32(limit), np.float32(np.inf)), 0.01 * (limit * shares.min()) ** 2
        (self.rows, _, self.own), (_, self.columns, self.other) = _singles(p, middle, shares), _singles(q, middle, shares)

    def least(self, a: slice, b: slice) -> np.ndarray:
        off = _off(max(self.own[a].max(), self.other[b].max()))
        return _roots(self.rows[:, a], self.columns[:, :, b], off) if off < np.inf else np.zeros((len(self.own[a]), len(self.other[b])), np.float32)

    def may(self, a: slice, b: slice) -> np.ndarray:
        """Which pairs of two tiles may be nearer than the limit."""
        off = _off(max(self.own[a].max(), self.other[b].max()))
        if not off <= self.enough:  # a tile far from the block's middle has one of its own
            return ~(_at_least(self.p[a], self.q[b], self.shares) >= self.most)
        may = ~(_roots(self.rows[:, a], self.columns[:, :, b], off, close=False) >= self.most)
        if np.count_nonzero(may) > 0.02 * may.size:  # perhaps only as NaN
            may = ~(_roots(self.rows[:, a], self.columns[:, :, b], off) >= self.most)
        return may


def _near(p: np.ndarray, sid: np.ndarray, q: np.ndarray, other: np.ndarray, limit: float, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Pairs of two blocks nearer than ``limit``, and how many were compared point by point, for some lines of ``p`` at a time.

    Tiles whose boxes of mean points are far apart are left out.  In the others the mean points of quarters tell which pairs may
    be near, unless a few lines show that these leave many, and where many are left all points.
    """
    (p, sid, own), (q, other, boxes) = _tiles(p, sid), _tiles(q, other)
    bounded, stages = np.isfinite(limit) and limit > 0, []
    if bounded:
        (mp, shares), (mq, _) = _means(p), _means(q)
        few = lambda v: v[:: -(-len(v) // 128)]
        if (_at_least(few(mp), few(mq), shares) < limit).mean() < 0.5:
            stages.append(_Bounds(mp, mq, shares, limit))
        stages.append(_Bounds(p, q, np.full(p.shape[1], 1 / p.shape[1]), limit))
    for i in range(0, len(p), TILE):
        k = i // TILE
        gap = np.maximum(0.0, np.maximum(own[0, k] - boxes[1], boxes[0] - own[1, k]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in np.flatnonzero(~(np.sqrt((gap * gap).sum(axis=1)) > limit * (1 + 1e-9))) * TILE:
            if ordered and j < i:
                continue  # a block that meets itself: each pair of tiles once
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            may = np.ones((len(p[a]), len(q[b])), bool)
            for stage in stages:
                if np.count_nonzero(may) > 0.02 * may.size:
                    may = stage.may(a, b)
            one, two = np.nonzero(np.triu(may, 1) if ordered and i == j else may)
            left.append(one + i)
            right.append(two + j)
        left, right = np.concatenate(left), np.concatenate(right)
        d = np.empty(len(left))
        for k in range(0, len(left), 4_096):
            a, b = p[left[k : k + 4_096]], q[right[k : k + 4_096]]
            d[k : k + 4_096] = np.minimum(np.sqrt(((a - b) ** 2).sum(axis=2)).mean(axis=1), np.sqrt(((a - b[:, ::-1]) ** 2).sum(axis=2)).mean(axis=1))
        keep = d < limit if np.isfinite(limit) else np.ones(len(d), bool)
        a, b = sid[left[keep]], other[right[keep]]
        yield np.minimum(a, b), np.maximum(a, b), d[keep], len(left)


def _finite() -> Column:
    return F.forall("xyz", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))


def _in_blocks(lines: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Finite ``lines`` in blocks by their mean points, and the pairs of blocks (p <= q) in which lines may be nearer than ``limit``.

    The blocks are stretches of the lines in order of cells of ``limit``, so a full cell is many of them.  A block's box of mean points tells
    how near its lines may be, less what the means may be off by, so no pair is lost wherever borders lie.  A line that isn't finite is near none.
    """
    n = F.size("xyz") / 3
    total = lambda axis: F.aggregate(F.filter("xyz", lambda _, k: k % 3 == axis), F.lit(0.0), lambda s, v: s + v)
    means = [(total(axis) / n).alias(f"m{axis}") for axis in range(3)]
    placed = materialise(lines.where(_finite()).select("sid", "xyz", *means, F.array_max(F.transform("xyz", F.abs)).alias("far")), "lines")
    count = placed.count()
    blocks = max(1, -(-count // MOST_BLOCK), min(-(-count // BLOCK), BLOCKS))
    order = [F.rint(F.col(f"m{k}") / F.lit(max(float(limit), 1e-300))) for k in range(3)]
    dealt = materialise(placed.repartitionByRange(blocks, *order, F.xxhash64("sid")).withColumn("block", F.spark_partition_id()), "blocks")
    boxes = dealt.groupBy("block").agg(F.max("far").alias("far"), *[f(f"m{k}").alias(f"{m}{k}") for k in range(3) for m, f in (("low", F.min), ("high", F.max))])
    left, right = (boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns]) for side in "pq")
    gaps = [F.greatest(F.lit(0.0), F.col(f"p_low{k}") - F.col(f"q_high{k}"), F.col(f"q_low{k}") - F.col(f"p_high{k}")) for k in range(3)]
    near = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) <= limit * (1 + 1e-9) + 1e-9 * F.greatest("p_far", "q_far")
    pairs = left.crossJoin(F.broadcast(right)).where((F.col("p_block") <= F.col("q_block")) & near)
    return dealt.select("block", "sid", "xyz"), pairs.select(F.col("p_block").alias("p"), F.col("q_block").alias("q"))


def _dealt_pairs(dealt: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (p, q, side, sid, xyz, same): the lines of both blocks of each pair; those of a block that meets itself once.

    Dealt by ranges of (p, q), so a pair of blocks is about a task and no task gets several by a hash.
    """
    pairs = materialise(pairs, "pairs")
    sides = [dealt.join(F.broadcast(pairs if side == 0 else pairs.where("p < q")), F.col("block") == F.col("pq"[side])).withColumn("side", F.lit(side)) for side in (0, 1)]
    rows = sides[0].unionByName(sides[1]).select("p", "q", "side", "sid", "xyz", (F.col("p") == F.col("q")).alias("same"))
    return rows.repartitionByRange(max(1, min(pairs.count(), MOST_TASKS)), "p", "q")


def mdf_pairs(lines: DataFrame, limit: float | None = None) -> DataFrame:
    """(a, b, mdf), a < b: distances of all pairs, or of those nearer than ``limit``.  ``lines`` is (sid, xyz).

    With a limit, blocks of lines meet only if their mean points may be so near: the distance of two
    lines isn't below that of their mean points.  Pairs that meet are compared point by point only if the
    mean points of quarters of the lines are near enough.
    """
    return mdf_compared(lines, limit).where("a IS NOT NULL").select("a", "b", "mdf")


def mdf_compared(lines: DataFrame, limit: float | None = None) -> DataFrame:
    """As ``mdf_pairs``, with ``compared``: how many pairs were compared point by point, on a row (a = b = null) for each TILE lines of a block."""
    if limit is None:
        rows = _dealt(lines.select(F.lit(0).alias("cell"), "sid", "xyz")).drop("cell")
    else:
        rows = _dealt_pairs(*_in_blocks(lines.select("sid", "xyz"), limit))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        if not rows.num_rows:
            return
        same = rows["same"][0].as_py()
        sides = [rows.filter(pc.equal(rows["side"], k)) for k in (0, 1)]
        if same:
            sides[1] = sides[0]
        if not all(side.num_rows for side in sides):
            return
        (p, sid), (q, other) = ((_flat(side["xyz"]), side["sid"].to_numpy()) for side in sides)
        for a, b, d, n in _near(p, sid, q, other, np.inf if limit is None else limit, same):
            columns = [pa.array(v, kind) for v, kind in ((a, pa.int64()), (b, pa.int64()), (d, pa.float64()), (np.zeros(len(a), np.int64), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.array([last], c.type)]) for c, last in zip(columns, (None, None, None, n), strict=True)], ["a", "b", "mdf", "compared"])

    return rows.groupBy("p", "q").applyInArrow(pairs, "a long, b long, mdf double, compared long")


def _flat(xyz: pa.ChunkedArray) -> np.ndarray:
    """Lines of equally many points (lines, points, 3)."""
    return xyz.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(xyz), -1, 3)


def _bounds(to_pivots: DataFrame, bins: int = 1_024) -> tuple[DataFrame, dict[int, float]]:
    """(sid, least): a lower bound of each line's total, and the totals of the pivots.

    By the triangle inequality d(i, j) >= |d(i, p) - d(j, p)|.  The sum of the right side over all j is taken from
    counts and sums of d(j, p) in ``bins`` ranges for each pivot, which go to the driver; in a line's own range it is bounded by the range's sum.
    """
    ends = to_pivots.groupBy("sample").agg(F.min("mdf").alias("low"), F.max("mdf").alias("high"), F.sum("mdf").alias("total")).toPandas().set_index("sample")
    limits = F.broadcast(to_pivots.sparkSession.createDataFrame([(int(k), float(r.low), float(max(r.high - r.low, 1e-300))) for k, r in ends.iterrows()], "sample long, low double, width double"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("mdf") - F.col("low")) / F.col("width") * bins)).cast("int")
    binned = to_pivots.join(limits, "sample").withColumn("bin", at)
    rows = binned.groupBy("sample", "bin").agg(F.count("*").alias("n"), F.sum("mdf").alias("s")).toPandas()
    tables = {}
    for pivot, part in rows.groupby("sample"):
        n, s = np.zeros(bins), np.zeros(bins)
        n[part.bin], s[part.bin] = part.n, part.s
        tables[int(pivot)] = (np.cumsum(n) - n, np.cumsum(s) - s, n, s)
    shared = to_pivots.sparkSession.sparkContext.broadcast(tables)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch))
            for pivot, (n0, s0, n, s) in shared.value.items():
                k = np.flatnonzero(batch["sample"] == pivot)
                x, b = batch.mdf.to_numpy()[k], batch["bin"].to_numpy()[k]
                above_n, above_s = n0[-1] + n[-1] - n0[b] - n[b], s0[-1] + s[-1] - s0[b] - s[b]
                out[k] = x * n0[b] - s0[b] + above_s - x * above_n + np.abs(x * n[b] - s[b])
            yield pd.DataFrame({"sid": batch.sid, "least": out})

    every = binned.select("sid", "sample", "mdf", "bin").mapInPandas(least, "sid long, least double")
    return every.groupBy("sid").agg(F.max("least").alias("least")), {int(k): float(v) for k, v in ends.total.items()}


def _totals(lines: DataFrame, wanted: DataFrame) -> dict[int, float]:
    """Total distance of each ``wanted`` line to all ``lines``, added up in the tasks: a task returns one row a wanted line."""
    rows = wanted.collect()
    ids, cube = [r.sid for r in rows], _cube(pd.Series([r.xyz for r in rows]))
    shared = lines.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), cube))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, others = shared.value
        total = np.zeros(len(own))
        for batch in batches:
            if len(batch):
                total += _sums(_cube(batch.xyz), others)
        yield pd.DataFrame({"sid": own, "total": total})

    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = lines.repartition(tasks).mapInPandas(sums, "sid long, total double").groupBy("sid").agg(F.sum("total").alias("total")).collect()
    shared.destroy()
    return {r.sid: r.total for r in found}


def _least_totals(lines: DataFrame) -> DataFrame:
    """(sid, least): lower bounds of the totals of finite ``lines``, less than these by what single precision is off by only.

    Each pair of blocks is met once and adds to the lines of both; a task returns a row a line.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        if not rows.num_rows:
            return
        same = rows["same"][0].as_py()
        sides = [rows.filter(pc.equal(rows["side"], 0 if same else k)) for k in (0, 1)]
        p, q = (_flat(side["xyz"]) for side in sides)
        bounds, own, other = _Bounds(p, q, np.full(p.shape[1], 1 / p.shape[1]), np.inf), np.zeros(len(p)), np.zeros(len(q))
        for i in range(0, len(p), TILE):
            for j in range(i if same else 0, len(q), TILE):
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                d = bounds.least(a, b)
                own[a] += d.sum(axis=1)
                if not same or i < j:
                    other[b] += d.sum(axis=0)
        for side, total in [(sides[0], own + other)] if same else [(sides[0], own), (sides[1], other)]:
            # a tile's sums are rounded once a line
            yield pa.RecordBatch.from_arrays([side["sid"].combine_chunks(), pa.array(total * (1 - TILE * 2.0**-23))], ["sid", "least"])

    return _dealt_pairs(*_in_blocks(lines, np.inf)).groupBy("p", "q").applyInArrow(sums, "sid long, least double").groupBy("sid").agg(F.sum("least").alias("least"))


def medoid_search(lines: DataFrame, pivots: int = 16, first: int = 64, most: int = 8_192) -> tuple[DataFrame, int]:
    """(sid, total) of the line of least total distance, ties to the least id, and how many lines were summed.

    The distance is a metric, so distances to a few pivots bound each line's total from
    below.  Where these leave more than a sixth of the lines, all pairs are met once in single precision,
    which bounds the totals closely.  Totals are summed for the lines of the least bounds first, ``first`` lines, then twice as
    many at a time (``most`` at most), until every line left is bounded above the least total found.
    """
    lines = materialise(lines.select("sid", "xyz"), "lines")  # each round reads them
    chosen = hash_sample(lines, pivots)
    if not chosen.count():
        return lines.sparkSession.createDataFrame([], "sid long, total double"), 0
    to_pivots = materialise(mdf_to_samples(lines, chosen))
    least, totals = _bounds(to_pivots)
    least = materialise(least)
    best = min(((round(v, 6), k) for k, v in totals.items()), default=None)
    if best is not None and least.where(F.col("least") <= best[0] + 1e-6 + 1e-9 * best[0]).count() > max(4 * first, least.count() // 6) and lines.where(~_finite()).isEmpty():
        least = materialise(_least_totals(lines))
    summed, at = set(totals), first
    last: tuple[float, int] | None = None
    while best is not None:
        slack = 1e-6 + 1e-9 * best[0]
        left = least.where(F.col("least") <= best[0] + slack)
        if last is not None:  # bounds rise from round to round, so a round goes on behind the last one
            left = left.where((F.col("least") > last[0]) | ((F.col("least") == last[0]) & (F.col("sid") > last[1])))
        some = left.orderBy("least", "sid").limit(at).collect()
        if not some:
            break
        last = (some[-1].least, some[-1].sid)
        new = [r.sid for r in some if r.sid not in summed]
        if new:
            wanted = lines.join(F.broadcast(lines.sparkSession.createDataFrame([(k,) for k in new], "sid long")), "sid", "left_semi")
            sums = _totals(lines, wanted)
            close = [k for k, v in sums.items() if v <= best[0] + 1e-6 + 1e-9 * best[0]]
            # sums of matrix products only tell which lines may be best; these are summed point by point
            for some in (close[k : k + 64] for k in range(0, len(close), 64)):
                exact = mdf_to_samples(lines, lines.where(F.col("sid").isin(some))).groupBy("sample").agg(F.round(F.sum("mdf"), 6).alias("total")).collect()
                best = min([best, *((r.total, r["sample"]) for r in exact)])
            summed |= set(new)
        at = min(most, 2 * at)
    found = [] if best is None else [(best[1], best[0])]
    return lines.sparkSession.createDataFrame(found, "sid long, total double"), len(summed)


def medoid_exact(lines: DataFrame) -> DataFrame:
    """(sid, total) of the line of least total distance, ties to the least id; see ``medoid_search``."""
    return medoid_search(lines)[0]


def hash_sample(lines: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` lines of the smallest (sid * HASH + seed) modulo MODULUS."""
    return lines.orderBy(F.pmod(F.col("sid") * HASH + seed, F.lit(MODULUS)), "sid").limit(k)


def mdf_to_samples(lines: DataFrame, samples: DataFrame, *, most: int = 2_000) -> DataFrame:
    """(sid, sample, mdf) of every line to at most ``most`` sample lines, which go to every task."""
    rows = samples.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sample lines")
    ids, cube = np.array([r.sid for r in rows], np.int64), _cube(pd.Series([r.xyz for r in rows])) if rows else np.zeros((0, 0, 3))
    shared = lines.sparkSession.sparkContext.broadcast((ids, cube))

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, others = shared.value
        for batch in batches:
            if len(batch) and len(own):
                d = _distances(_cube(batch.xyz), others)
                sid = np.repeat(batch.sid.to_numpy(), len(own))
                sample = np.tile(own, len(batch))
                yield pd.DataFrame({"sid": sid, "sample": sample, "mdf": np.where(sid == sample, 0.0, d.ravel())})

    return lines.mapInPandas(distances, "sid long, sample long, mdf double")


def medoid_sampled(lines: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(sid, total) of the line of least total distance to ``k`` sample lines."""
    sampled = mdf_to_samples(lines, hash_sample(lines, k, seed))
    return sampled.groupBy("sid").agg(F.round(F.sum("mdf"), 6).alias("total")).orderBy("total", "sid").limit(1)


def centroid(resampled: DataFrame) -> DataFrame:
    """(k, x, y, z): mean of the lines (sid, k, x, y, z), each turned if that brings it strictly nearer to the line of the least id.

    Lines have equally many points.  The line of the least id goes to the driver.
    """
    lines = resampled.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("k", *AXES))).alias("points"))
    model = lines.agg(F.min_by("points", "sid")).first()[0]
    if model is None:
        return resampled.select("k", *AXES).limit(0)
    fixed = F.array(*[F.struct(*[F.lit(p[a]).alias(a) for a in AXES]) for p in model])

    def away(points: Column) -> Column:
        each = F.zip_with(points, fixed, lambda p, m: F.sqrt(sum(((p[a] - m[a]) * (p[a] - m[a]) for a in AXES), F.lit(0.0))))
        return F.aggregate(each, F.lit(0.0), lambda x, y: x + y)

    direct, turned = F.col("points"), F.reverse("points")
    placed = lines.select(F.posexplode(F.when(away(turned) < away(direct), turned).otherwise(direct)).alias("k", "p"))
    return placed.groupBy("k").agg(*[F.avg(f"p.{a}").alias(a) for a in AXES])
