"""Long, nested and CSR layouts of line bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import AXES, IDENTITY, Affine, transformed
from .sampling import prefix_sums

BBOX = [f"{m}{a}" for m in ("min", "max") for a in AXES]


def bbox_columns() -> list:
    """Aggregates of the six flat box columns; flat so that Parquet's statistics apply to them."""
    return [f(a).alias(f"{m}{a}") for m, f in (("min", F.min), ("max", F.max)) for a in AXES]


def to_nested(points: DataFrame) -> DataFrame:
    """(sid, n_points, box, points) from (sid, pid, x, y, z)."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("pid", *AXES))), lambda p: F.struct(*[p[a].alias(a) for a in AXES]))
    return points.groupBy("sid").agg(F.count("*").alias("n_points"), *bbox_columns(), line.alias("points"))


def to_long(nested: DataFrame) -> DataFrame:
    return nested.select("sid", F.posexplode("points").alias("pid", "p")).select("sid", "pid", *[F.col(f"p.{a}").alias(a) for a in AXES])


def csr_to_points(csr_points: DataFrame, csr_lines: DataFrame) -> DataFrame:
    """(sid, pid, x, y, z) from points (point_id, x, y, z) and lines (line_id, conn): through the connectivity, in its order."""
    places = csr_lines.select(F.col("line_id").alias("sid"), F.posexplode("conn").alias("pid", "point_id"))
    return places.join(csr_points, "point_id").select("sid", "pid", *AXES)


def to_csr(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat points (point_id, x, y, z) in line order, and lines (sid, start, n_points)."""
    lines = prefix_sums(points.groupBy("sid").agg(F.count("*").alias("n_points")), "sid", F.col("n_points"), "start")
    flat = points.join(lines.select("sid", "start"), "sid").select((F.col("start") + F.col("pid")).alias("point_id"), *AXES)
    return flat, lines.select("sid", "start", "n_points")


def load_bundle(points: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """Nested lines with single-precision coordinates; lines without points don't arise; scalars (sid, pid, name, value) become a map of arrays."""
    rounded = points.select("sid", "pid", *[F.col(a).cast("float").cast("double").alias(a) for a in AXES])
    nested = to_nested(rounded)
    if scalars is None:
        return nested
    values = F.transform(F.sort_array(F.collect_list(F.struct("pid", "value"))), lambda s: s["value"])
    each = scalars.groupBy("sid", "name").agg(values.alias("values"))
    named = each.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("scalars"))
    return nested.join(named, "sid", "left")


def visible_lines(nested: DataFrame, visible: DataFrame) -> DataFrame:
    """The visible lines; scalars stay with their lines as they are columns."""
    return nested.join(visible.select("sid"), "sid", "left_semi")


def save_visible(nested: DataFrame, visible: DataFrame, path: str) -> None:
    visible_lines(nested, visible).repartitionByRange("sid").sortWithinPartitions("sid").write.parquet(path)


def apply_bundle_affine(points: DataFrame, affine: Affine) -> DataFrame:
    if tuple(affine) == tuple(IDENTITY):
        return points
    return points.select("sid", "pid", *[c.alias(a) for c, a in zip(transformed(affine, [F.col(a) for a in AXES]), AXES, strict=True)])


def streamline_bbox(points: DataFrame) -> DataFrame:
    return points.groupBy("sid").agg(*bbox_columns())


def reuse_bbox(points: DataFrame, cached: DataFrame) -> DataFrame:
    """``cached`` boxes where a line has one without nulls, computed ones for the others.

    Only the points of lines that lack a good box are aggregated.
    """
    good = cached.dropna(subset=BBOX).select("sid", *BBOX).join(points.select("sid").distinct(), "sid", "left_semi")
    missing = points.join(good.select("sid"), "sid", "left_anti")
    return good.withColumn("reused", F.lit(True)).unionByName(streamline_bbox(missing).withColumn("reused", F.lit(False)))
