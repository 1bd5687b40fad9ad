"""Projections of points, lines, scalars and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import AXES, INDEX, Affine, inside, inverse, nearest, product, transformed

STEPS = 1000
PALETTE = 20


def _xyz(suffix: str = "") -> list[Column]:
    return [F.col(a + suffix) for a in AXES]


def voxel_to_world(df: DataFrame, affine: Affine) -> DataFrame:
    """``df`` with x, y, z of its i, j, k."""
    return df.withColumns(dict(zip(AXES, transformed(affine, [F.col(c) for c in INDEX]), strict=True)))


def world_to_voxel(df: DataFrame, affine: Affine) -> DataFrame:
    """``df`` with the fractional indices vi, vj, vk of its x, y, z."""
    return df.withColumns(dict(zip(("vi", "vj", "vk"), transformed(inverse(affine), _xyz()), strict=True)))


def nearest_voxel(df: DataFrame, affine: Affine, dims: Sequence[int]) -> DataFrame:
    """Rows inside the grid, with their voxel i, j, k."""
    return df.withColumns(dict(zip(INDEX, nearest(affine, _xyz()), strict=True))).where(inside(dims, [F.col(c) for c in INDEX]))


def snap_clamped(df: DataFrame, affine: Affine, dims: Sequence[int]) -> DataFrame:
    """``df`` with the nearest voxel i, j, k, held inside the grid."""
    return df.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)) for c, v, n in zip(INDEX, nearest(affine, _xyz()), dims, strict=True)})


def _along() -> Window:
    return Window.partitionBy("sid").orderBy("pid")


def arc_length(points: DataFrame) -> DataFrame:
    """``points`` with cum: the length of the line up to each point."""
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(_along())) ** 2 for a in AXES), F.lit(0.0)))
    return points.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("cum", F.sum("__step").over(_along())).drop("__step")


def line_lengths(points: DataFrame) -> DataFrame:
    return arc_length(points).groupBy("sid").agg(F.max("cum").alias("length"))


def resample(points: DataFrame, n: int = 100) -> DataFrame:
    """(sid, k, x, y, z): ``n`` points uniform in arc length.

    Each segment of positive length makes the points that fall on it, so lines
    are only brought together for the running length.  Lines without length
    repeat their first point.
    """
    if n < 2:
        raise ValueError("a line is resampled to two points or more")
    whole = Window.partitionBy("sid")
    lead = {f"{c}2": F.lead(c).over(_along()) for c in ("cum", *AXES)}
    rows = arc_length(points).withColumns(lead | {"total": F.max("cum").over(whole), "first": F.col("pid") == F.min("pid").over(whole)})
    place = lambda d: F.floor(d * (n - 1) / F.col("total"))
    moving = rows.where("total > 0 AND cum2 > cum")
    start = F.when(F.col("cum") == 0, F.lit(0)).otherwise(place(F.col("cum")) + 1)
    stop = F.when(F.col("cum2") == F.col("total"), F.lit(n - 1)).otherwise(place(F.col("cum2")))
    made = moving.withColumns({"k0": start, "k1": stop}).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * F.col("total") / (n - 1) - F.col("cum")) / (F.col("cum2") - F.col("cum"))))
    made = made.withColumn("t", t).select("sid", F.col("k").cast("int").alias("k"), *[(F.col(a) + F.col("t") * (F.col(f"{a}2") - F.col(a))).alias(a) for a in AXES])
    still = rows.where("total = 0 AND first").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("sid", "k", *AXES)
    return made.unionByName(still)


def endpoints(points: DataFrame) -> DataFrame:
    """(sid, n_points, x0..z0, x1..z1): first and last point, by partial aggregation."""
    first, last = F.min(F.struct("pid", *AXES)), F.max(F.struct("pid", *AXES))
    ends = points.groupBy("sid").agg(F.count("*").alias("n_points"), first.alias("a"), last.alias("b"))
    return ends.select("sid", "n_points", *[F.col(f"a.{c}").alias(f"{c}0") for c in AXES], *[F.col(f"b.{c}").alias(f"{c}1") for c in AXES])


def orientation_rgb(points: DataFrame) -> DataFrame:
    """(sid, r, g, b): the absolute direction from first to last point; 0 for lines shorter than 1e-8."""
    ends = endpoints(points)
    step = [F.col(f"{a}1") - F.col(f"{a}0") for a in AXES]
    norm = F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2])
    return ends.withColumn("norm", norm).select("sid", *[F.when(F.col("norm") > 1e-8, F.abs(s / F.col("norm"))).otherwise(0.0).alias(c) for s, c in zip(step, "rgb", strict=True)])


def scalar_range(scalars: DataFrame) -> DataFrame:
    """(name, low, high): widened by 0.5 on both sides if equal; 0 and 1 without a finite value."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    ends = scalars.groupBy("name").agg(F.min(finite).alias("a"), F.max(finite).alias("b"))
    same = F.col("a") == F.col("b")
    return ends.select(
        "name",
        F.coalesce(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")), F.lit(0.0)).alias("low"),
        F.coalesce(F.when(same, F.col("b") + 0.5).otherwise(F.col("b")), F.lit(1.0)).alias("high"),
    )


def rescaled(value: Column, low: Column, high: Column) -> Column:
    """Step 0..STEPS of a value held between low and high, half to even."""
    return F.rint(STEPS * (F.greatest(low, F.least(high, value)) - low) / (high - low)).cast("int")


def scalar_rescale(scalars: DataFrame) -> DataFrame:
    """``scalars`` with step, and back: the value that the step stands for."""
    rows = scalars.join(scalar_range(scalars), "name").withColumn("step", rescaled(F.col("value"), F.col("low"), F.col("high")))
    return rows.withColumn("back", F.col("low") + F.col("step") / float(STEPS) * (F.col("high") - F.col("low"))).drop("low", "high")


def hue_to_rgb(hue: Column) -> list[Column]:
    """Full saturation and value; hue in 0..1."""
    h = hue * 6
    ramp = lambda shift: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.pmod(h + shift, F.lit(6.0)) - 3) - 1))
    return [ramp(0.0), ramp(4.0), ramp(2.0)]


def scalar_colormap(points: DataFrame, scalars: DataFrame, bins: int = 256) -> DataFrame:
    """(sid, pid, bin, r, g, b): hue from 0.667 (low) to 0 (high); grey for lines whose scalars don't match their points."""
    values = scalars.join(F.broadcast(scalar_range(scalars)), "name")
    counts = values.groupBy("sid").agg(F.count("*").alias("n_scalars"))
    full = points.groupBy("sid").agg(F.count("*").alias("n")).join(counts, "sid", "left").select("sid", F.coalesce(F.col("n") == F.col("n_scalars"), F.lit(False)).alias("full"))
    share = (F.greatest("low", F.least("high", "value")) - F.col("low")) / (F.col("high") - F.col("low"))
    binned = values.select("sid", "pid", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    rows = points.select("sid", "pid").join(full, "sid").join(binned, ["sid", "pid"], "left")
    rgb = hue_to_rgb(F.lit(0.667) * (1 - F.col("bin") / float(bins - 1)))
    return rows.select("sid", "pid", F.when(F.col("full"), F.col("bin")).alias("bin"), *[F.when(F.col("full"), c).otherwise(0.5).alias(n) for c, n in zip(rgb, "rgb", strict=True)])


def broadcast_line_scalar(points: DataFrame, per_line: DataFrame, value: str) -> DataFrame:
    """Each point with its line's ``value``."""
    return points.join(per_line.select("sid", value), "sid")


def categorical_colour(labels: DataFrame, connected: DataFrame) -> DataFrame:
    """(label, palette_index, hue): place among the connected labels modulo PALETTE, and a golden-ratio hue.  One row a label."""
    rank = F.dense_rank().over(Window.orderBy("label")) - 1
    ranked = labels.join(connected, "label", "left_semi").withColumn("rank", rank)
    return ranked.select("label", (F.col("rank") % PALETTE).alias("palette_index"), F.pmod(F.col("rank") * 0.618033988749895, F.lit(1.0)).alias("hue"))


def bundle_info(bundles: DataFrame, headers: DataFrame) -> DataFrame:
    """Number of lines and points of each bundle, beside its header's fields."""
    counts = bundles.groupBy("bundle_id").agg(F.count_distinct("sid").alias("n_lines"), F.count("*").alias("n_points"))
    return counts.join(headers, "bundle_id", "left")


def grid_to_grid(voxels: DataFrame, source: Affine, target: Affine, dims: Sequence[int]) -> DataFrame:
    """``voxels`` with the nearest voxel ti, tj, tk of another grid, where that is inside it."""
    both = product(inverse(target), source)
    index = [F.rint(c).cast("int") for c in transformed(both, [F.col(c) for c in INDEX])]
    return voxels.withColumns(dict(zip(("ti", "tj", "tk"), index, strict=True))).where(inside(dims, [F.col(c) for c in ("ti", "tj", "tk")]))
