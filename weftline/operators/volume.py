"""Voxel tables (i, j, k, value) and their metadata."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.affine import AXES, INDEX, Affine, transformed

MOST_VOXELS, PAD, TILE = 512**3, 2.0, 32


def slice_volume(voxels: DataFrame, axis: str, index: int, dims: Sequence[int]) -> DataFrame:
    """One plane; the index is held inside the grid."""
    n = dims[INDEX.index(axis)]
    return voxels.where(F.col(axis) == max(0, min(n - 1, index)))


def infer_voxel_type(voxels: DataFrame) -> DataFrame:
    """One row: low, high and the smallest type that holds all values, float where some isn't whole."""
    v = F.col("value")
    whole = F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))
    found = voxels.agg(F.bool_and(whole).alias("whole"), F.min(v).alias("low"), F.max(v).alias("high"))
    low, high = F.col("low"), F.col("high")
    kind = F.when(~F.col("whole"), "float32").when((low >= 0) & (high <= 255), "uint8").when((low >= 0) & (high <= 65535), "uint16").when((low >= -32768) & (high <= 32767), "int16")
    return found.select("low", "high", kind.otherwise("int32").alias("voxel_type"))


def _finite(c: str = "value") -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def value_range_sampled(voxels: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Least and greatest finite value on the planes at 25, 50 and 75 % of each axis."""
    planes = reduce(lambda a, b: a | b, [F.col(c).isin(*{int(n * q) for q in (0.25, 0.5, 0.75)}) for c, n in zip(INDEX, dims, strict=True)])
    return voxels.where(planes).agg(F.min(_finite()).alias("low"), F.max(_finite()).alias("high"))


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], *, bins: int = 256, few: int = 10_000) -> list[float]:
    """The values of ``column`` (without nulls) at ``ranks`` from 0 in ascending order, exactly.

    Repeated histograms: each pass cuts the range that holds a rank at ``bins`` percentiles of a mergeable
    sketch, counts the rows below, at and between them, and goes on with the one stretch that holds the rank, until
    ``few`` rows are left in it, which are sorted on the driver.  So only counts leave the tasks, whatever the number of distinct values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    return [_order_statistic(values, rank, bins, few) for rank in ranks]


def _order_statistic(left: DataFrame, rank: int, bins: int, few: int) -> float:
    n = left.count()
    while n > few:
        shares = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
        cuts = sorted(set(left.agg(F.percentile_approx("v", shares, 20 * bins)).first()[0]))
        starts = [-math.inf, *cuts]
        binned = Bucketizer(splits=[*starts, math.inf], inputCol="v", outputCol="bin").transform(left).withColumn("bin", F.col("bin").cast("int"))
        at_start = F.sum((F.col("v") == F.get(F.array(*map(F.lit, starts)), "bin")).cast("long"))
        counts = {r.bin: (r.equal, r.n) for r in binned.groupBy("bin").agg(at_start.alias("equal"), F.count("*").alias("n")).collect()}
        for k, start in enumerate(starts):
            equal, every = counts.get(k, (0, 0))
            if rank < every:
                break
            rank -= every
        if rank < equal:
            return start
        rank, n = rank - equal, every - equal
        left = left.where((F.col("v") > start) & (F.col("v") < (cuts[k] if k < len(cuts) else math.inf)))
    return sorted(r.v for r in left.collect())[rank]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of ``column``, between neighbouring values in proportion; None of no values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    found = dict(zip(ranks, order_statistics(df, column, ranks), strict=True))
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def intensity_window(voxels: DataFrame) -> DataFrame:
    """5th and 99th percentile of the finite values, the upper one widened by a fifth of their distance."""
    low, high = quantiles(voxels.select(_finite().cast("double").alias("value")), "value", (0.05, 0.99))
    return voxels.sparkSession.createDataFrame([(low, None if high is None else high + 0.2 * (high - low))], "low double, high double")


def downsample_step(dims: Sequence[int], most: int = MOST_VOXELS) -> int:
    return 1 if math.prod(dims) <= most else math.ceil(max(dims) / int(most ** (1 / 3)))


def downsample_stride(voxels: DataFrame, step: int) -> DataFrame:
    test = reduce(lambda a, b: a & b, [F.col(c) % step == 0 for c in INDEX])
    return voxels.where(test).withColumns({c: F.floor(F.col(c) / step).cast("int") for c in INDEX})


def scaled_affine(affine: Affine, step: int) -> Affine:
    a = np.array(affine, float).reshape(4, 4)
    a[:3, :3] *= step
    return tuple(a.ravel().tolist())


def downsample(voxels: DataFrame, affine: Affine, dims: Sequence[int], most: int = MOST_VOXELS, sigma: float = 0.8) -> tuple[DataFrame, Affine, tuple[int, ...]]:
    """Every step-th voxel of a grid of over ``most`` voxels, smoothed, with its affine and dims; a smaller grid is returned as it is."""
    step = downsample_step(dims, most)
    if step == 1:
        return voxels, affine, tuple(dims)
    small = tuple(-(-n // step) for n in dims)
    return gaussian_smooth(downsample_stride(voxels, step), small, sigma), scaled_affine(affine, step), small


def kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian cut at 4 sigma."""
    reach = int(4.0 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def _smoothed(block: np.ndarray, weights: np.ndarray, sources: list[np.ndarray]) -> np.ndarray:
    """``block`` filtered along its first three axes; ``sources`` are, for each axis, the places of the block that stand for targets and halo."""
    size = len(weights)
    for axis, at in enumerate(sources):
        wide = np.take(block, at, axis=axis)
        n = len(at) - size + 1
        block = sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(weights))
    return block


def gaussian_smooth(voxels: DataFrame, dims: Sequence[int], sigma: float = 0.8, *, tile: int = TILE) -> DataFrame:
    """Smoothing with repeated edges; voxels that aren't there are 0, and a result has the voxels that one in reach of it is in.

    The volume is cut into tiles of ``tile`` voxels a side.  A voxel goes to its tile and to those whose halo it
    lies in, so one shuffle brings each tile together, and each is filtered as an array, an axis at a time.
    """
    weights = kernel(sigma)
    reach = len(weights) // 2
    rows = voxels.select(*INDEX, F.col("value").cast("double").alias("value"))
    for c, n in zip(INDEX, dims, strict=True):
        low, high = F.greatest(F.lit(0), F.floor((F.col(c) - reach) / tile)).cast("int"), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + reach) / tile)).cast("int")
        rows = rows.withColumn(f"t{c}", F.explode(F.sequence(low, high)))

    def smooth(table: pa.Table) -> pa.Table:
        first = [table.column(f"t{c}")[0].as_py() * tile for c in INDEX]
        stop = [min(n, a + tile) for a, n in zip(first, dims, strict=True)]
        begin, end = [max(0, a - reach) for a in first], [min(n, b + reach) for b, n in zip(stop, dims, strict=True)]
        block = np.zeros([*(b - a for a, b in zip(begin, end, strict=True)), 2])  # values, and whether there are any
        at = tuple(table.column(c).to_numpy() - a for c, a in zip(INDEX, begin, strict=True))
        np.add.at(block[..., 0], at, table.column("value").to_numpy())
        block[(*at, 1)] = 1.0
        sources = [np.clip(np.arange(a - reach, b + reach), 0, n - 1) - lo for a, b, n, lo in zip(first, stop, dims, begin, strict=True)]
        out = _smoothed(block, weights, sources)
        there = np.nonzero(out[..., 1] > 0)
        return pa.table({**{c: pa.array((x + a).astype(np.int32)) for c, x, a in zip(INDEX, there, first, strict=True)}, "value": out[(*there, 0)]})

    return rows.groupBy(*[f"t{c}" for c in INDEX]).applyInArrow(smooth, "i int, j int, k int, value double")


def canonical_axes(affine: Affine) -> tuple[list[int], list[int]]:
    """For each world axis the voxel axis that runs along it most, and its direction."""
    a = np.array(affine, float).reshape(4, 4)[:3, :3]
    left, order = np.abs(a / np.linalg.norm(a, axis=0)), [-1, -1, -1]
    for _ in range(3):
        world, voxel = np.unravel_index(np.argmax(left), left.shape)
        order[world] = int(voxel)
        left[world, :] = left[:, voxel] = -1
    return order, [1 if a[w, v] >= 0 else -1 for w, v in enumerate(order)]


def canonical_orientation(voxels: DataFrame, affine: Affine, dims: Sequence[int]) -> tuple[DataFrame, Affine, tuple[int, ...]]:
    """Voxels with axes along +x, +y, +z as nearly as may be, and the new affine and dims."""
    order, signs = canonical_axes(affine)
    new = [F.col(INDEX[v]) if s > 0 else dims[v] - 1 - F.col(INDEX[v]) for v, s in zip(order, signs, strict=True)]
    move = np.zeros((4, 4))
    move[3, 3] = 1
    for w, (v, s) in enumerate(zip(order, signs, strict=True)):
        move[v, w] = s
        move[v, 3] = 0 if s > 0 else dims[v] - 1
    turned = np.array(affine, float).reshape(4, 4) @ move
    rest = [c for c in voxels.columns if c not in INDEX]
    return voxels.select(*[c.alias(n) for c, n in zip(new, INDEX, strict=True)], *rest), tuple(turned.ravel().tolist()), tuple(dims[v] for v in order)


def deoblique(meta: DataFrame, limit: float = 1e-4) -> DataFrame:
    """``meta`` (volume_id, nx, ny, nz, affine) with oblique, and for those volumes an upright affine of the same voxel sizes and centre."""
    at = lambda r, c: F.get("affine", 4 * r + c)
    size = [F.sqrt(at(0, c) * at(0, c) + at(1, c) * at(1, c) + at(2, c) * at(2, c)) for c in range(3)]
    tilt = F.greatest(*[F.acos(F.least(F.lit(1.0), F.greatest(*[F.abs(at(r, c)) for r in range(3)]) / size[c])) for c in range(3)])
    middle = [(F.col(n) - 1) / 2 for n in ("nx", "ny", "nz")]
    centre = [at(r, 0) * middle[0] + at(r, 1) * middle[1] + at(r, 2) * middle[2] + at(r, 3) for r in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    upright = [size[c] if c == r else (centre[r] - size[r] * middle[r] if c == 3 else zero) for r in range(3) for c in range(4)] + [zero, zero, zero, one]
    return meta.withColumn("oblique", tilt > limit).withColumn("affine", F.when(F.col("oblique"), F.array(*upright)).otherwise(F.col("affine")))


def occupied_bounds(voxels: DataFrame) -> DataFrame:
    """One row: least and greatest index of the voxels over 0."""
    return voxels.where("value > 0").agg(*[f(c).alias(f"{n}_{c}") for c in INDEX for n, f in (("min", F.min), ("max", F.max))])


def crop_to_bounds(voxels: DataFrame, dims: Sequence[int], margin: int = 1) -> tuple[DataFrame, tuple[int, ...]]:
    """Voxels near the occupied ones, counted from the crop's corner, and that corner.  Six numbers go to the driver.

    Without occupied voxels there is nothing to crop: no rows and the corner of the grid.
    """
    row = occupied_bounds(voxels).first()
    if row.min_i is None:
        return voxels.limit(0), (0, 0, 0)
    low = tuple(max(0, row[f"min_{c}"] - margin) for c in INDEX)
    high = [min(n - 1, row[f"max_{c}"] + margin) for c, n in zip(INDEX, dims, strict=True)]
    test = reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, lo, hi in zip(INDEX, low, high, strict=True)])
    return voxels.where(test).withColumns({c: F.col(c) - lo for c, lo in zip(INDEX, low, strict=True)}), low


def shifted_affine(affine: Affine, corner: Sequence[int]) -> Affine:
    """The affine of voxels counted from ``corner``."""
    a = np.array(affine, float).reshape(4, 4)
    a[:3, 3] += a[:3, :3] @ np.array(corner, float)
    return tuple(a.ravel().tolist())


def roi_world_aabb(rois: DataFrame, affine: Affine, pad: float = PAD) -> DataFrame:
    """(roi_id, minx..maxz): world box of the eight corners of each region's occupied voxels, padded."""
    ends = rois.where("value > 0").groupBy("roi_id").agg(*[F.min(c).alias(f"lo_{c}") for c in INDEX], *[(F.max(c) + 1).alias(f"hi_{c}") for c in INDEX])
    corners = F.array(*[F.struct(*[F.col(f"{e}_{c}").alias(c) for e, c in zip((x, y, z), INDEX, strict=True)]) for x in ("lo", "hi") for y in ("lo", "hi") for z in ("lo", "hi")])
    each = ends.select("roi_id", F.explode(corners).alias("c"))
    world = each.select("roi_id", *[w.alias(a) for w, a in zip(transformed(affine, [F.col(f"c.{c}") for c in INDEX]), AXES, strict=True)])
    return world.groupBy("roi_id").agg(*[(F.min(a) - pad).alias(f"min{a}") for a in AXES], *[(F.max(a) + pad).alias(f"max{a}") for a in AXES])


def label_histogram(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("label").agg(F.count("*").alias("n"))
