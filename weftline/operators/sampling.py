"""Global ranks without a single-task window, strides, even samples."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import AXES

TARGET, PRE_STRIDE_ABOVE = 20_000, 150_000
#: Ranges of a global rank.
BUCKETS = 512
#: Colour of a line without a direction.
GREY = 200


def ranged(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``__bucket``: ranges of ``key`` (a number) of about equally many rows, in order, wherever the keys lie.

    The ends of the ranges are percentiles from mergeable sketches (at most ``buckets`` numbers go to the driver).
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 20 * buckets).alias("ends")).first()[0]
    ends = sorted(set(found or []))
    if not ends:
        return df.withColumn("__bucket", F.lit(0.0))
    bucketed = Bucketizer(splits=[-math.inf, *ends, math.inf], inputCol="__key", outputCol="__bucket")
    return bucketed.transform(df.withColumn("__key", F.col(key).cast("double"))).drop("__key")


def prefix_sums(df: DataFrame, key: str, value: Column, out: str, *, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows of a smaller ``key`` (a number, unique).

    Keys are cut into at most ``buckets`` ranges of about equally many rows.  Only the ranges'
    totals are summed in one task; the rows are summed within their range.
    """
    rows = ranged(df, key, buckets).withColumn("__value", value.cast("long"))
    totals = rows.groupBy("__bucket").agg(F.sum("__value").alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__bucket", before.alias("__before"))
    within = Window.partitionBy("__bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(totals), "__bucket").withColumn(out, F.col("__before") + F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return placed.drop("__bucket", "__value", "__before")


def global_rank(ids: DataFrame, key: str = "sid", out: str = "rank") -> DataFrame:
    """``ids`` with the place of each row by ``key``, from 0."""
    return prefix_sums(ids, key, F.lit(1), out)


def stride_sample(ids: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th id in order."""
    return global_rank(ids).where(F.col("rank") % stride == 0).drop("rank")


def auto_stride(ids: DataFrame, *, target: int = TARGET) -> DataFrame:
    """One row: n, skip_percent, stride and pre_stride for about ``target`` rows."""
    n = F.col("n")
    percent = F.greatest(F.lit(0), F.least(F.lit(99), ((1 - target / n) * 100).cast("int")))
    counted = ids.agg(F.count("*").alias("n"))
    with_percent = counted.select("n", F.when(n > target, percent).otherwise(0).cast("int").alias("skip_percent"))
    return with_percent.select(
        "n",
        "skip_percent",
        F.greatest(F.lit(1), (100 / (100 - F.col("skip_percent"))).cast("int")).alias("stride"),
        F.when(n >= PRE_STRIDE_ABOVE, F.greatest(F.lit(1), F.floor(n / target))).otherwise(1).cast("int").alias("pre_stride"),
    )


def linspace_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, evenly spaced in order, the first and the last among them."""
    ranked = global_rank(ids)
    n = ids.count()
    if n <= most:
        return ranked.drop("rank")
    picks = ids.sparkSession.range(most).select(F.expr(f"id * {n - 1} div {max(1, most - 1)}").alias("rank")).distinct()
    return ranked.join(picks, "rank", "left_semi").drop("rank")


def step_points(points: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th point of each line of two points or more."""
    lengths = points.groupBy("sid").agg(F.count("*").alias("__n")).where("__n > 1").select("sid")
    return points.where(F.col("pid") % step == 0).join(lengths, "sid", "left_semi")


def export_sample(points: DataFrame, most: int, step: int = 2) -> DataFrame:
    """Sampled lines, sampled points and the colour of each line as integers of 0..255; lines left with one point are grey."""
    chosen = linspace_sample(points.select("sid").distinct(), most)
    stepped = step_points(points.join(chosen, "sid", "left_semi"), step)
    steps = stepped.groupBy("sid").agg(*[(F.max_by(a, "pid") - F.min_by(a, "pid")).alias(f"d{a}") for a in AXES], F.count("*").alias("__left"))
    norm = F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in AXES), F.lit(0.0)))
    shade = {c: F.when(norm > 1e-8, F.abs(F.col(f"d{a}") / norm) * 255).otherwise(0.0).cast("int") for c, a in zip("rgb", AXES, strict=True)}
    colours = steps.select("sid", *[F.when(F.col("__left") > 1, value).otherwise(GREY).alias(c) for c, value in shade.items()])
    return stepped.join(colours, "sid")


def sample_counts(points: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: how many lines ``sample`` shows and how many there are."""
    both = points.select("sid", F.lit(0).alias("shown")).unionAll(sample.select("sid", F.lit(1).alias("shown")))
    return both.groupBy("sid").agg(F.max("shown").alias("shown")).agg(F.coalesce(F.sum("shown"), F.lit(0)).alias("num_streamlines"), F.count("*").alias("total_streamlines"))
