"""Shapes to voxels: the table of shapes drives the job."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.affine import AXES, INDEX, Affine, inverse, transformed

LEAST_RADIUS, MOST_STEPS, SLAB = 0.5, 100_000, 0.5
FLAT = {"axial": 2, "coronal": 1, "sagittal": 0}
PALETTE_SIZE = 10
#: Samples of strokes that a task holds at a time.
SAMPLES = 262_144


def _grid(df: DataFrame, low: Sequence[Column], high: Sequence[Column], dims: Sequence[int]) -> DataFrame:
    """A row for each voxel of [low, high] that is inside the grid."""
    for c, lo, hi, n in zip(INDEX, low, high, dims, strict=True):
        df = df.withColumns({f"__lo{c}": F.greatest(lo, F.lit(0)), f"__hi{c}": F.least(hi, F.lit(n - 1))})
    df = df.where(reduce(lambda a, b: a & b, [F.col(f"__lo{c}") <= F.col(f"__hi{c}") for c in INDEX]))
    for c in INDEX:
        df = df.withColumn(c, F.explode(F.sequence(f"__lo{c}", f"__hi{c}"))).drop(f"__lo{c}", f"__hi{c}")
    return df


def rasterise_spheres(spheres: DataFrame, affine: Affine, dims: Sequence[int]) -> DataFrame:
    """(roi_id, i, j, k) of voxel centres within each sphere (roi_id, cx, cy, cz, r), in world distance on any affine."""
    back = np.array(inverse(affine)).reshape(4, 4)[:3, :3]
    reach = np.sqrt((back**2).sum(axis=1)).tolist()  # voxels along each axis for one world unit
    centre = transformed(inverse(affine), [F.col(f"c{a}") for a in AXES])
    low = [F.floor(c - F.col("r") * w).cast("int") for c, w in zip(centre, reach, strict=True)]
    high = [F.ceil(c + F.col("r") * w).cast("int") for c, w in zip(centre, reach, strict=True)]
    world = transformed(affine, [F.col(c) for c in INDEX])
    d2 = reduce(lambda a, b: a + b, [(w - F.col(f"c{a}")) * (w - F.col(f"c{a}")) for w, a in zip(world, AXES, strict=True)])
    return _grid(spheres, low, high, dims).where(d2 <= F.col("r") * F.col("r")).select("roi_id", *INDEX)


def rasterise_spheres_voxel(spheres: DataFrame, affine: Affine, dims: Sequence[int]) -> DataFrame:
    """As ``rasterise_spheres`` but in voxel distance, with the radius in voxels along x.  Radii that aren't finite and positive are left out."""
    size = float(np.linalg.norm(np.array(affine).reshape(4, 4)[:3, 0]))
    good = spheres.where((F.col("r") > 0) & (F.col("r") < float("inf")) & ~F.isnan("r"))
    centre = [F.rint(c).cast("int") for c in transformed(inverse(affine), [F.col(f"c{a}") for a in AXES])]
    placed = good.withColumns({f"v{c}": v for c, v in zip(INDEX, centre, strict=True)} | {"vr": F.col("r") / size})
    low = [F.floor(F.col(f"v{c}") - F.col("vr")).cast("int") for c in INDEX]
    high = [F.ceil(F.col(f"v{c}") + F.col("vr")).cast("int") for c in INDEX]
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"v{c}")) * (F.col(c) - F.col(f"v{c}")) for c in INDEX])
    return _grid(placed, low, high, dims).where(d2 <= F.col("vr") * F.col("vr")).select("roi_id", *INDEX)


def padded_radii(n: int, radii: Sequence[float], default: float = 5.0) -> list[float]:
    """One radius a sphere: the last given one is repeated."""
    given = list(radii) or [default]
    return [given[min(i, len(given) - 1)] for i in range(n)]


def rasterise_boxes(boxes: DataFrame, dims: Sequence[int], view: str) -> DataFrame:
    """(roi_id, i, j, k) of closed boxes (roi_id, i0..k0, i1..k1 as fractional voxels): cut, held in the grid, two voxels thick if flat along the view."""
    low = {c: F.greatest(F.lit(0), F.least(f"{c}0", f"{c}1").cast("int")) for c in INDEX}
    high = {c: F.least(F.lit(n - 1), F.greatest(f"{c}0", f"{c}1").cast("int")) for c, n in zip(INDEX, dims, strict=True)}
    flat = INDEX[FLAT[view]]
    high[flat] = F.when(low[flat] == high[flat], high[flat] + 1).otherwise(high[flat])
    return _grid(boxes, list(low.values()), list(high.values()), dims).select("roi_id", *INDEX)


def _stroke_voxels(sid: np.ndarray, xyz: np.ndarray, alone: np.ndarray, dims: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Different (line number, voxel number) along the segments between neighbouring rows of one line and at rows that are ``alone``."""
    same = sid[1:] == sid[:-1]
    p, q, line = xyz[:-1][same], xyz[1:][same], sid[:-1][same]
    with np.errstate(invalid="ignore", over="ignore"):
        d = q - p
        n = np.ceil(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) * 10)
        good = (n > 0) & (n <= MOST_STEPS)
    p, q, d, line, n = (np.concatenate([v[good], w]) for v, w in ((p, xyz[alone]), (q, xyz[alone]), (d, 0 * xyz[alone]), (line, sid[alone]), (n, np.zeros(alone.sum()))))
    n, codes = n.astype(np.int64), []
    ends = np.cumsum(n + 1)
    begin = 0
    while begin < len(n):  # SAMPLES at a time, one segment at least
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SAMPLES, side="right")))
        steps = n[begin:stop]
        row = np.repeat(np.arange(begin, stop), steps + 1)
        s = np.arange(len(row)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.rint(np.where((s == n[row])[:, None], q[row], p[row] + s[:, None] * (d / np.maximum(n, 1)[:, None])[row]))
            inside = ((at >= 0) & (at <= np.array(dims) - 1)).all(axis=1)
        i, j, k = at[inside].astype(np.int64).T
        codes.append(np.unique(line[row[inside]] * np.int64(math.prod(dims)) + (i * dims[1] + j) * dims[2] + k))
        begin = stop
    return np.divmod(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), math.prod(dims))


def rasterise_strokes(strokes: DataFrame, dims: Sequence[int]) -> DataFrame:
    """(sid, i, j, k) along each polyline (sid, pid, x, y, z in voxels): ten samples a voxel, rounded half to even.

    Segments of more than MOST_STEPS samples are left out, as are those of no length.  A line's rows
    come in order, as a stream: a task holds the samples of some segments, and which voxels its current line has.
    """
    kind = strokes.schema["sid"].dataType
    schema = T.StructType([T.StructField("sid", kind), *[T.StructField(c, T.IntegerType()) for c in INDEX]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last row: what follows may be of its line
        first, seen = True, np.zeros(math.prod(dims), bool)  # whether the kept row begins its line, and the voxels of that line
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            if last and kept is None or not last and not batch.num_rows:
                continue
            rows = kept if last else batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            sids = rows.column("sid").dictionary_encode(null_encoding="encode").indices.to_numpy()
            line = np.concatenate([[0], np.cumsum(sids[1:] != sids[:-1])])
            xyz = np.stack([pc.fill_null(rows.column(a), math.nan).to_numpy() for a in AXES], axis=1).astype(float).reshape(-1, 3)
            begins = np.concatenate([[first], line[1:] != line[:-1]])
            ends = np.concatenate([line[1:] != line[:-1], [last]])
            number, code = _stroke_voxels(line, xyz, begins & ends, dims)
            fresh = (number > 0) | ~seen[code]
            number, code = number[fresh], code[fresh]
            if line[-1] > 0:
                seen[:] = False
            seen[code[number == line[-1]]] = True
            first, kept = bool(begins[-1]), rows.slice(rows.num_rows - 1)
            where = np.searchsorted(line, number)
            yield pa.RecordBatch.from_arrays(
                [rows.column("sid").take(pa.array(where)), *[pa.array(v.astype(np.int32)) for v in (code // (dims[1] * dims[2]), code // dims[2] % dims[1], code % dims[2])]], ["sid", *INDEX]
            )

    rows = strokes.select("sid", "pid", *[F.col(a).cast("double").alias(a) for a in AXES])
    return rows.repartition("sid").sortWithinPartitions("sid", "pid").select("sid", *AXES).mapInArrow(run, schema)


def expand_brush(voxels: DataFrame, dims: Sequence[int], view: str, size: int) -> DataFrame:
    """A square brush in the plane of the view; even sizes reach one further upwards."""
    reach = [(0, 0) if FLAT[view] == a else (-((size - 1) // 2), size // 2) for a in range(3)]
    rest = [c for c in voxels.columns if c not in INDEX]
    for c, (lo, hi), n in zip(INDEX, reach, dims, strict=True):
        others = [x for x in voxels.columns if x != c]
        voxels = voxels.select(*others, F.explode(F.sequence(F.col(c) + lo, F.col(c) + hi)).alias(c)).where(F.col(c).between(0, n - 1))
    return voxels.select(*rest, *INDEX).distinct()


def fill_polygon(corners: DataFrame, dims: Sequence[int], view: str = "axial") -> DataFrame:
    """(roi_id, i, j, k) inside each polygon (roi_id, pid, x, y, z in voxels) on the slice of its mean, by even-odd crossings.

    Scan lines: each edge gives its crossing with each row that it passes, the crossings of a row are
    sorted, and the cells between the first and second, third and fourth, .. are filled.  So the cost is that of
    the edges' rows and the filled cells.  A cell on a crossing is inside if it begins a stretch.
    """
    flat = FLAT[view]
    u, v = [a for n, a in enumerate(AXES) if n != flat]
    (iu, nu), (iv, nv) = [(c, dims[n]) for n, c in enumerate(INDEX) if n != flat]
    order = Window.partitionBy("roi_id").orderBy("pid")
    boxes = corners.groupBy("roi_id").agg(
        F.count("*").alias("n"), F.rint(F.avg(AXES[flat])).cast("int").alias(INDEX[flat]), *[f(a).alias(f"{m}_{a}") for a in (u, v) for m, f in (("lo", F.min), ("hi", F.max))], *[F.max_by(a, "pid").alias(f"last_{a}") for a in (u, v)]
    )
    boxes = boxes.where((F.col("n") >= 3) & F.col(INDEX[flat]).between(0, dims[flat] - 1))
    # the edge into each corner comes from the corner before it, the first one's from the last
    edges = corners.select("roi_id", F.col(u).alias("ui"), F.col(v).alias("vi"), F.lag(u).over(order).alias("uj"), F.lag(v).over(order).alias("vj")).join(boxes, "roi_id")
    edges = edges.withColumns({"uj": F.coalesce("uj", f"last_{u}"), "vj": F.coalesce("vj", f"last_{v}")})
    first = F.greatest(F.lit(0), F.ceil(F.least("vi", "vj"))).cast("int")
    last = F.least(F.lit(nv - 1), F.ceil(F.greatest("vi", "vj")) - 1).cast("int")
    rows = edges.withColumns({"__first": first, "__last": last}).where("__first <= __last").withColumn(iv, F.explode(F.sequence("__first", "__last")))
    at = (F.col("uj") - F.col("ui")) * (F.col(iv) - F.col("vi")) / (F.col("vj") - F.col("vi") + 1e-10) + F.col("ui")
    crossings = rows.select("roi_id", iv, INDEX[flat], f"lo_{u}", f"hi_{u}", at.alias("at"))
    along = Window.partitionBy("roi_id", iv).orderBy("at")
    pairs = crossings.withColumns({"number": F.row_number().over(along), "to": F.lead("at").over(along)}).where("number % 2 = 1 AND to IS NOT NULL")
    begin = F.greatest(F.lit(0), F.floor(f"lo_{u}"), F.ceil("at")).cast("int")
    end = F.least(F.lit(nu - 1), F.ceil(f"hi_{u}"), F.ceil("to") - 1).cast("int")
    return pairs.withColumns({"__begin": begin, "__end": end}).where("__begin <= __end").withColumn(iu, F.explode(F.sequence("__begin", "__end"))).select("roi_id", *INDEX)


def erase_voxels(roi: DataFrame, strokes: DataFrame) -> DataFrame:
    return roi.join(strokes, list(INDEX), "left_anti")


def move_resize(shapes: DataFrame, changes: DataFrame) -> DataFrame:
    """``shapes`` with new centres and radii from ``changes`` (roi_id, dx, dy, dz, dr); radii stay at LEAST_RADIUS or more."""
    rows = shapes.join(changes, "roi_id", "left")
    moved = [(F.col(f"c{a}") + F.coalesce(f"d{a}", F.lit(0.0))).alias(f"c{a}") for a in AXES]
    return rows.select("roi_id", *moved, F.greatest(F.lit(LEAST_RADIUS), F.col("r") + F.coalesce("dr", F.lit(0.0))).alias("r"))


def view_to_world_boxes(boxes: DataFrame) -> DataFrame:
    """(roi_id, minx..maxz) of boxes drawn in a view (roi_id, view, x0..z0, x1..z1): x is mirrored in axial and coronal views, and the view's axis is a slab."""
    mirrored = F.col("view").isin("axial", "coronal")
    ends = {a: [F.when(mirrored, -F.col(f"{a}{e}")).otherwise(F.col(f"{a}{e}")) if a == "x" else F.col(f"{a}{e}") for e in "01"] for a in AXES}
    thick = {a: F.when(F.col("view") == view, SLAB).otherwise(0.0) for view, n in FLAT.items() for a in [AXES[n]]}
    return boxes.select("roi_id", *[(F.least(*ends[a]) - thick[a]).alias(f"min{a}") for a in AXES], *[(F.greatest(*ends[a]) + thick[a]).alias(f"max{a}") for a in AXES])


def new_roi_like(catalog: DataFrame, volume_id: str) -> DataFrame:
    """``catalog`` (roi_id, name, volume_id, palette_index) with an empty region behind the last one."""
    row = catalog.agg(F.coalesce(F.max("roi_id"), F.lit(-1)).alias("last"), F.count("*").alias("n"))
    new = row.select(
        (F.col("last") + 1).alias("roi_id"), F.concat(F.lit("ROI_"), (F.col("n") + 1).cast("string")).alias("name"), F.lit(volume_id).alias("volume_id"), (F.col("n") % PALETTE_SIZE).alias("palette_index")
    )
    return catalog.unionByName(new)
