"""Spatial selection: boxes, spheres, voxel regions, endpoint labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.affine import AXES, INDEX, Affine, nearest
from .geometry import endpoints, nearest_voxel

DEFAULT_RADIUS, LEAST_RADIUS = 3.5, 0.5
#: A table of shapes of up to this many rows goes to every task; more are joined by grid cells.
BROADCAST_SHAPES = 100_000
#: As many different boxes go to every task, each in some cells of every level.
BROADCAST_BOXES = 2_000
#: The ids of equal shapes go to every task up to this many.
BROADCAST_MEMBERS = 1_000_000
SPHERE = ["cx", "cy", "cz", "r"]
#: Segments of a run, spheres of a group (and groups of a group), and how much is tested at once.
RUN, FAN, RUNS_AT_ONCE, PAIRS_AT_ONCE, LINES_AT_ONCE = 4, 8, 4_096, 8_192, 4_096
#: Rows of hits that a task writes at once, and lines whose hits stand together for each id: a short run comes again within a page on disk.
WRITTEN_AT_ONCE, RUN_OF_LINES = 262_144, 256
#: Boxes smaller than cells of 2 ** FINEST lie on that level.
FINEST = -10


def box_meets(low: Sequence, high: Sequence) -> Column:
    """Whether a line's box meets [low, high], ends included.  On flat columns, so Parquet can skip row groups."""
    test = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        test &= (F.col(f"max{a}") >= lo) & (F.col(f"min{a}") <= hi)
    return test


def bbox_overlap(lines: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return lines.where(box_meets(low, high))


def _level(df: DataFrame, low: str, high: str) -> Column:
    """The level of a box: cells of it are at least as wide as the box, so it touches two of them along an axis at most."""
    extent = F.greatest(*[F.col(f"{high}{a}") - F.col(f"{low}{a}") for a in AXES])
    return F.greatest(F.lit(FINEST), F.ceil(F.log2(F.greatest(extent, F.lit(2.0**FINEST))))).cast("int")


def range_join(lines: DataFrame, boxes: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Pairs of lines and ``boxes`` (roi_id, lowx..highz) that meet, each once; all columns of both, or ``only`` these.

    Equal boxes are joined once and their pairs then to the rows that share them.  Up to BROADCAST_BOXES different
    boxes go to every task, so lines aren't shuffled.  With ``only``, up to BROADCAST_MEMBERS boxes go there too, and
    the pairs of a box with some lines are written together, so columns on disk hold many in little space.
    """
    corners = [f"{m}{a}" for m in ("low", "high") for a in AXES]
    known = boxes.dropna(subset=corners)
    kinds = known.groupBy(*corners).agg(F.count("*").alias("n"))
    if kinds.limit(BROADCAST_BOXES + 1).count() > BROADCAST_BOXES:
        return _grid_join(lines, known) if only is None else _grid_join(lines, known).select(*only)
    table = kinds.toArrow()
    numbered = boxes.sparkSession.createDataFrame(table.select(corners).append_column("__class", pa.array(np.arange(table.num_rows))), ", ".join(f"{c} {kinds.schema[c].dataType.simpleString()}" for c in corners) + ", __class long")
    members = known.join(F.broadcast(numbered), corners)
    pairs, few = _grid_join(lines, numbered, few=True).drop(*corners), (pc.sum(table.column("n")).as_py() or 0) <= BROADCAST_MEMBERS
    if only is not None and few:
        return _written_pairs(pairs, members, table.num_rows, only)
    joined = pairs.join(F.broadcast(members) if few else members, "__class").drop("__class")
    return joined if only is None else joined.select(*only)


def _written_pairs(pairs: DataFrame, members: DataFrame, classes: int, only: Sequence[str]) -> DataFrame:
    """``pairs`` joined to ``members`` by __class in the tasks, the columns ``only``: for each batch of pairs all of one member, then of the next."""
    theirs = [c for c in only if c in members.columns]
    table = members.select("__class", *theirs).toArrow().sort_by("__class").combine_chunks()
    starts = np.searchsorted(table.column("__class").to_numpy(), np.arange(classes + 1))
    shared = pairs.sparkSession.sparkContext.broadcast((table.select(theirs), starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts = shared.value
        for batch in batches:
            kinds = batch.column("__class").to_numpy()
            order = np.argsort(kinds, kind="stable")
            for place, row in _written(kinds[order], starts):
                place, row = pa.array(place), pa.array(order[row])
                yield pa.RecordBatch.from_arrays([ids.column(c).combine_chunks().take(place) if c in theirs else batch.column(c).take(row) for c in only], list(only))

    schema = ", ".join(f"{c} {(members if c in theirs else pairs).schema[c].dataType.simpleString()}" for c in only)
    return pairs.select("__class", *[c for c in only if c not in theirs]).mapInArrow(run, schema)


def _grid_join(lines: DataFrame, boxes: DataFrame, *, few: bool = False) -> DataFrame:
    """``range_join`` by a hierarchy of grids.

    Each box lies on the level of its own extent, where it touches at
    most eight cells, and is dealt also to the coarser levels that the other side has.  A pair
    is joined on the coarser of its two levels only, and counts in the cell of the greater of
    its lower corners only.  So a row is copied at most eight times for each level of the other side,
    however large it is.  The levels in use (a few numbers) go to the driver; ``few`` boxes go to every task.
    """
    sides = []
    for df, low, high, own in ((lines, "min", "max", "__la"), (boxes, "low", "high", "__lb")):
        known = reduce(lambda a, b: a & b, [F.col(f"{m}{a}").isNotNull() for m in (low, high) for a in AXES])
        sides.append((df.where(known).withColumn(own, _level(df, low, high)), low, high, own))
    levels = [sorted(r[0] for r in df.select(own).distinct().collect()) for df, _, _, own in sides]

    def dealt(side: int) -> DataFrame:
        df, low, high, own = sides[side]
        coarser = F.filter(F.array(*[F.lit(v) for v in levels[1 - side]]).cast("array<int>"), lambda v: v > F.col(own))
        df = df.withColumn("__level", F.explode(F.concat(F.array(own), coarser)))
        size = F.pow(F.lit(2.0), F.col("__level"))
        for a in AXES:
            df = df.withColumn(f"__cell{a}", F.explode(F.sequence(F.floor(F.col(f"{low}{a}") / size), F.floor(F.col(f"{high}{a}") / size))))
        return df

    on = ["__level", *[f"__cell{a}" for a in AXES]]
    pairs = dealt(0).join(F.broadcast(dealt(1)) if few else dealt(1), on)
    test = F.col("__level") == F.greatest("__la", "__lb")
    for a in AXES:
        test &= (F.col(f"max{a}") >= F.col(f"low{a}")) & (F.col(f"min{a}") <= F.col(f"high{a}"))
        test &= F.col(f"__cell{a}") == F.floor(F.greatest(f"min{a}", f"low{a}") / F.pow(F.lit(2.0), F.col("__level")))
    return pairs.where(test).drop(*on, "__la", "__lb")


def in_sphere(points: Column, centre: Sequence, r2) -> Column:
    """Whether a vertex, or a point of a segment of positive length, is nearer than r."""
    cx, cy, cz = centre
    away = lambda x, y, z: (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)

    def touches(p: Column, q: Column) -> Column:
        dx, dy, dz = (q[a] - p[a] for a in AXES)
        length = dx * dx + dy * dy + dz * dz
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - p["x"]) * dx + (cy - p["y"]) * dy + (cz - p["z"]) * dz) / F.when(length > 0, length)))
        return F.coalesce((length > 0) & (away(p["x"] + t * dx, p["y"] + t * dy, p["z"] + t * dz) < r2), F.lit(False))

    vertex = F.exists(points, lambda p: away(p["x"], p["y"], p["z"]) < r2)
    segments = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points)), touches)
    return vertex | ((F.size(points) > 1) & F.exists(segments, lambda hit: hit))


def select_in_sphere(lines: DataFrame, centre: Sequence[float], radius: float = DEFAULT_RADIUS) -> DataFrame:
    """(sid) of nested ``lines`` within the sphere."""
    r = max(LEAST_RADIUS, float(radius))
    near = bbox_overlap(lines, [c - r for c in centre], [c + r for c in centre])
    return near.where(in_sphere(F.col("points"), [F.lit(float(c)) for c in centre], F.lit(r * r))).select("sid")


def morton(points: np.ndarray) -> np.ndarray:
    """The order of ``points`` (n, 3) along a Morton curve."""
    low = points.min(axis=0, initial=0.0)
    width = max(float((points - low).max(initial=0.0)), 1e-300)
    cells = ((points - low) / width * 1023).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for bit in range(10):
        for axis in range(3):
            code |= ((cells[:, axis] >> bit) & 1) << (3 * bit + axis)
    return np.argsort(code, kind="stable")


class SphereTree:
    """Spheres in Morton order under levels of boxes of FAN each; descended level by level with boxes of runs of segments."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        self.order = morton(centres)
        n = -(-max(1, len(centres)) // FAN) * FAN
        self.centres, self.radii = np.full((n, 3), np.inf), np.full(n, -np.inf)  # spheres that fill up the last group meet nothing
        self.centres[: len(centres)], self.radii[: len(radii)] = centres[self.order], radii[self.order]
        reach = np.abs(radii)[self.order][:, None]
        boxes = np.tile([[np.inf] * 3, [-np.inf] * 3], (n, 1, 1))
        boxes[: len(centres)] = np.stack([centres[self.order] - reach, centres[self.order] + reach], axis=1)
        self.levels = []
        while True:
            boxes = np.concatenate([boxes, np.tile([[[np.inf] * 3, [-np.inf] * 3]], (-len(boxes) % FAN, 1, 1))]).reshape(-1, FAN, 2, 3)
            boxes = np.stack([boxes[:, :, 0].min(axis=1), boxes[:, :, 1].max(axis=1)], axis=1)
            self.levels.append(boxes)
            if len(boxes) == 1:
                break

    def candidates(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a run's box and a lowest group of FAN spheres that meet."""
        run, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for depth, boxes in enumerate(reversed(self.levels)):
            if depth:
                run, node = np.repeat(run, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(boxes)
                run, node = run[real], node[real]
            meets = ((high[run] >= boxes[node, 0]) & (low[run] <= boxes[node, 1])).all(axis=1)
            run, node = run[meets], node[meets]
        return run, node


def line_hits(points: np.ndarray, sizes: np.ndarray, tree: SphereTree) -> tuple[np.ndarray, np.ndarray]:
    """(line, sphere) numbers that hit, each once, of lines of ``sizes`` points that stand one behind the other in ``points``.

    A hit is a vertex, or a point of a segment of positive length, nearer than r.  Blocks of
    runs of RUN segments are tested against groups of spheres that their boxes meet.
    """
    n = len(points)
    line = np.repeat(np.arange(len(sizes)), sizes)
    after = np.minimum(np.arange(n) + 1, max(n - 1, 0))
    ends = np.where((line[after] == line)[:, None], points[after], points)  # the last vertex is a segment of no length
    # runs: RUN segments of one line, the last one filled up with its last segment
    first = np.cumsum(sizes) - sizes
    runs = -(-sizes // RUN)
    start = np.repeat(first, runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    owner = np.repeat(np.arange(len(sizes)), runs)
    segment = np.minimum(start[:, None] + np.arange(RUN), (first + sizes - 1)[owner][:, None])
    a, b = points[segment], ends[segment]
    low, high = np.minimum(a, b).min(axis=1), np.maximum(a, b).max(axis=1)
    found = []
    for part in range(0, len(owner), RUNS_AT_ONCE):
        run, group = tree.candidates(low[part : part + RUNS_AT_ONCE], high[part : part + RUNS_AT_ONCE])
        for k in range(0, len(run), PAIRS_AT_ONCE):
            r, g = run[k : k + PAIRS_AT_ONCE] + part, group[k : k + PAIRS_AT_ONCE]
            sphere = g[:, None] * FAN + np.arange(FAN)
            hit = _touches(a[r][:, :, None], b[r][:, :, None], tree.centres[sphere][:, None], tree.radii[sphere][:, None]).any(axis=1)
            pair, which = np.nonzero(hit)
            found.append(np.unique(owner[r[pair]] * np.int64(len(tree.radii)) + sphere[pair, which]))
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return every // len(tree.radii), tree.order[every % len(tree.radii)]


def _touches(p: np.ndarray, q: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether a sphere holds p or, for p <> q, a point of the segment from p to q, nearer than r.  The last axis is x, y, z."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d, from_p = q - p, p - c
        length = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
        along = -(from_p[..., 0] * d[..., 0] + from_p[..., 1] * d[..., 1] + from_p[..., 2] * d[..., 2])
        t = np.clip(along / length, 0.0, 1.0)
        r2 = np.where(r >= 0, r * r, -1.0)
        vertex = from_p[..., 0] * from_p[..., 0] + from_p[..., 1] * from_p[..., 1] + from_p[..., 2] * from_p[..., 2] < r2
        x, y, z = (p[..., k] + t * d[..., k] - c[..., k] for k in range(3))
        return vertex | ((length > 0) & (x * x + y * y + z * z < r2))


def _xyz(points: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and sizes of lines."""
    flat = points.flatten()
    return np.stack([flat.field(a).to_numpy(zero_copy_only=False) for a in AXES], axis=1).astype(float).reshape(-1, 3), np.asarray(pc.fill_null(pc.list_value_length(points), 0)).astype(np.int64)


def _spheres(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([table.column(f"c{a}").to_numpy() for a in AXES], axis=1).astype(float), table.column("r").to_numpy().astype(float)


def _classes(spheres: DataFrame) -> tuple[pa.Table, DataFrame] | None:
    """The different ``spheres`` (cx, cy, cz, r), and (__class, roi_id) of the ids that share each row of them; None for more than BROADCAST_SHAPES."""
    kinds = spheres.groupBy(*SPHERE).agg(F.count("*").alias("n"))
    if kinds.limit(BROADCAST_SHAPES + 1).count() > BROADCAST_SHAPES:
        return None
    table = kinds.toArrow()
    numbered = spheres.sparkSession.createDataFrame(table.select(SPHERE).append_column("__class", pa.array(np.arange(table.num_rows))))
    return table, spheres.join(F.broadcast(numbered), SPHERE).select("__class", "roi_id").distinct()


def sphere_hits(lines: DataFrame, spheres: DataFrame) -> DataFrame:
    """(roi_id, sid), each once, for ``spheres`` (roi_id, cx, cy, cz, r) and nested ``lines``; spheres with a null meet nothing.

    Equal spheres are tested once, and their hits written for each id that shares them: up to BROADCAST_MEMBERS ids go to every task,
    where an id's hits in a block of lines stand together, so columns on disk hold many in little space; more ids are joined.  Lines are
    dealt to tasks and tested in blocks against a tree of all different spheres, up to
    BROADCAST_SHAPES of them (counted first; 40 bytes each).  Of more, runs of
    segments are joined by their boxes to the spheres' boxes, and the pairs tested in blocks.
    """
    spark, known = lines.sparkSession, spheres.select("roi_id", *[F.col(c).cast("double") for c in SPHERE]).dropna()
    sid = f"sid {lines.schema['sid'].dataType.simpleString()}"
    found = _classes(known)
    if found is None:
        return _joined_hits(lines, known, f"roi_id {spheres.schema['roi_id'].dataType.simpleString()}, {sid}")
    table, members = found
    if (pc.sum(table.column("n")).as_py() or 0) <= BROADCAST_MEMBERS:
        every = _class_hits(lines, table, f"roi_id {spheres.schema['roi_id'].dataType.simpleString()}, {sid}", members.toArrow().sort_by("__class"))
    else:
        every = _class_hits(lines, table, f"__class long, {sid}").join(members, "__class").select("roi_id", "sid")
    # an id with two different spheres may hit a line twice
    twice = known.select("roi_id", *SPHERE).distinct().groupBy("roi_id").agg(F.count("*").alias("n")).where("n > 1")
    return every if twice.isEmpty() else every.distinct()


def _written(kinds: np.ndarray, starts: np.ndarray, at_once: int = WRITTEN_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of ids and of hits for each id of the kind of each hit, some at a time: all hits of one id, then of the next.

    ``kinds`` of the hits are sorted; the ids of a kind k stand from ``starts[k]`` to ``starts[k + 1]``.
    """
    kind, first, n = np.unique(kinds, return_index=True, return_counts=True)
    ids = starts[kind + 1] - starts[kind]
    of = np.repeat(np.arange(len(kind)), ids)
    place = starts[kind][of] + np.arange(len(of)) - np.repeat(np.cumsum(ids) - ids, ids)
    ends = np.cumsum(n[of])
    low = 0
    while low < len(of):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        size = n[of[low:high]]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(place[low:high], size), np.repeat(first[of[low:high]], size) + within
        low = high


def _class_hits(lines: DataFrame, table: pa.Table, kinds: str, members: pa.Table | None = None) -> DataFrame:
    """Hits (__class, sid) of a few spheres, which go to every task, or those (roi_id, sid) of their ``members`` (__class, roi_id), sorted by class."""
    spark = lines.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = None if members is None else (members.column("roi_id").combine_chunks(), np.searchsorted(members.column("__class").to_numpy(), np.arange(table.num_rows + 1)))
    shared = spark.sparkContext.broadcast((*_spheres(table), ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, ids = shared.value
        tree = SphereTree(centres, radii)
        for batch in batches:
            for k in range(0, batch.num_rows, LINES_AT_ONCE):
                some = batch.slice(k, LINES_AT_ONCE)
                line, sphere = line_hits(*_xyz(some.column(1)), tree)
                if ids is None:
                    yield pa.RecordBatch.from_arrays([pa.array(sphere), some.column(0).take(pa.array(line))], ["__class", "sid"])
                    continue
                for at in range(0, some.num_rows, RUN_OF_LINES):
                    part = slice(*np.searchsorted(line, [at, at + RUN_OF_LINES]))
                    order = np.argsort(sphere[part], kind="stable")
                    hit = some.column(0).take(pa.array(line[part][order]))
                    for place, row in _written(sphere[part][order], ids[1]):
                        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(place)), hit.take(pa.array(row))], ["roi_id", "sid"])

    return lines.select("sid", "points").repartition(tasks, "sid").mapInArrow(run, kinds)


def _joined_hits(lines: DataFrame, spheres: DataFrame, kinds: str) -> DataFrame:
    """Hits of any number of spheres, by the boxes of runs of segments."""
    begins = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("points") - 1), F.lit(RUN))
    runs = lines.where(F.size("points") > 0).select("sid", F.explode(F.transform(begins, lambda k: F.slice("points", k, F.lit(RUN + 1)))).alias("points"))
    for a in AXES:
        values = F.col(f"points.{a}")
        runs = runs.withColumns({f"min{a}": F.array_min(values), f"max{a}": F.array_max(values)})
    boxes = spheres.select("*", *[(F.col(f"c{a}") - F.abs("r")).alias(f"low{a}") for a in AXES], *[(F.col(f"c{a}") + F.abs("r")).alias(f"high{a}") for a in AXES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes = _xyz(batch.column("points"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            after = np.minimum(np.arange(len(points)) + 1, max(len(points) - 1, 0))
            ends = np.where((row[after] == row)[:, None], points[after], points)
            centres, radii = _spheres(pa.Table.from_batches([batch]))
            hit = np.unique(row[_touches(points, ends, centres[row], radii[row])])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hit)) for c in ("roi_id", "sid")], ["roi_id", "sid"])

    pairs = range_join(runs, boxes).select("roi_id", "sid", "points", *[f"c{a}" for a in AXES], "r")
    return pairs.mapInArrow(run, kinds).distinct()


def select_in_box(lines: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """(sid) of nested ``lines`` with a vertex in the closed box."""
    inside = lambda p: (p["x"].between(low[0], high[0])) & (p["y"].between(low[1], high[1])) & (p["z"].between(low[2], high[2]))
    return bbox_overlap(lines, low, high).where(F.exists("points", inside)).select("sid")


def roi_intersection(points: DataFrame, roi: DataFrame, affine: Affine, dims: Sequence[int], *, compat_uint8: bool = False) -> DataFrame:
    """(sid) of lines with a vertex in a voxel of ``roi`` (i, j, k, value) over 0."""
    value = F.col("value").cast("long") % 256 if compat_uint8 else F.col("value")
    voxels = roi.where(value > 0).select(*INDEX).distinct()
    return nearest_voxel(points, affine, dims).join(voxels, list(INDEX), "left_semi").select("sid").distinct()


def update_shape_hits(hits: DataFrame, lines: DataFrame, changed: DataFrame) -> DataFrame:
    """``hits`` (roi_id, sid) with those of the ``changed`` spheres found anew."""
    ids = changed.select("roi_id")
    few = F.broadcast(ids) if ids.limit(BROADCAST_SHAPES + 1).count() <= BROADCAST_SHAPES else ids
    return hits.join(few, "roi_id", "left_anti").unionByName(sphere_hits(lines, changed))


def label_endpoints(points: DataFrame, parcels: DataFrame, affine: Affine) -> DataFrame:
    """(sid, label_a, label_b): labels at both ends; 0 outside, unlabelled, and for lines of one point."""
    ends = endpoints(points)
    for e, label in (("0", "label_a"), ("1", "label_b")):
        at = [c.alias(v) for c, v in zip(nearest(affine, [F.col(a + e) for a in AXES]), INDEX, strict=True)]
        ends = ends.select("*", *at).join(parcels.select(*INDEX, F.col("label").alias(label)), list(INDEX), "left").drop(*INDEX)
    return ends.select("sid", *[F.when(F.col("n_points") > 1, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("label_a", "label_b")])


def region_hits(labelled: DataFrame, label: int) -> DataFrame:
    return labelled.where((F.col("label_a") == label) | (F.col("label_b") == label)).select("sid")


def visible_candidates(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    return candidates.join(visible.select("sid"), "sid", "left_semi")


def stale_region_refresh(points: DataFrame, visible: DataFrame, parcels: DataFrame, affine: Affine, modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoint labels of the lines visible now, and ``modes`` (kind, roi_id, mode) with the filters of all regions reset.

    Hits of a region come from the labels, so a filter that was set on older ones no longer holds;
    modes of other kinds stay.
    """
    reset = F.when(F.col("kind") == "region", "none").otherwise(F.col("mode"))
    return label_endpoints(visible_candidates(points, visible), parcels, affine), modes.withColumn("mode", reset)
