"""Loosely typed bundle headers as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.affine import IDENTITY


def parse_numeric_tuple(text: Column, kind: str, length: int) -> Column:
    """array<kind> of a string such as '(1, 2, 3)' or '1 2 3'; null if it hasn't ``length`` numbers.  Whole numbers are cut from decimals."""
    parts = F.filter(F.split(F.translate(F.translate(text, "[]()", ""), ",", " "), r"\s+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(numbers) == length) & ~F.exists(numbers, lambda n: n.isNull())
    typed = F.transform(numbers, lambda n: n.cast("int")) if kind == "int" else numbers
    return F.when(good, typed)


def unparsed(text: Column, kind: str, length: int) -> Column:
    """``text`` as it is where it hasn't ``length`` numbers, else null: what ``parse_numeric_tuple`` leaves."""
    return F.when(parse_numeric_tuple(text, kind, length).isNull(), text)


def voxel_order_from_affine(affine: Column) -> Column:
    """Three letters: for each voxel axis the world axis that it runs along most, and its direction."""
    letters = []
    for c in range(3):
        x, y, z = (F.get(affine, 4 * r + c) for r in range(3))
        letters.append(
            F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), F.when(x >= 0, "R").otherwise("L"))
            .when(F.abs(y) >= F.abs(z), F.when(y >= 0, "A").otherwise("P"))
            .otherwise(F.when(z >= 0, "S").otherwise("I"))
        )
    return F.when(affine.isNotNull(), F.concat(*letters))


def _order(fallback: Column) -> Column:
    return F.when(F.length("voxel_order") == 3, F.upper("voxel_order")).otherwise(fallback)


def normalise_trk(headers: DataFrame, counts: DataFrame, image_affine: DataFrame | None = None) -> DataFrame:
    """Typed header fields with defaults: order from the image's affine or RAS, sizes of 1, dimensions of 1, identity affine.

    ``headers`` (bundle_id, voxel_order, voxel_sizes, dimensions), ``counts`` (bundle_id, n), ``image_affine`` (bundle_id, affine).
    """
    rows = headers.join(counts, "bundle_id", "left")
    rows = rows.join(image_affine, "bundle_id", "left") if image_affine is not None else rows.withColumn("affine", F.lit(None).cast("array<double>"))
    return rows.select(
        "bundle_id",
        _order(F.coalesce(voxel_order_from_affine(F.col("affine")), F.lit("RAS"))).alias("voxel_order"),
        F.coalesce(parse_numeric_tuple(F.col("voxel_sizes"), "float", 3), F.array(*[F.lit(1.0)] * 3)).alias("voxel_sizes"),
        F.coalesce(parse_numeric_tuple(F.col("dimensions"), "int", 3), F.array(*[F.lit(1)] * 3)).alias("dimensions"),
        F.coalesce("affine", F.array(*map(F.lit, IDENTITY))).alias("voxel_to_rasmm"),
        F.coalesce("n", F.lit(0).cast("long")).alias("nb_streamlines"),
    )


def normalise_tck(headers: DataFrame, counts: DataFrame) -> DataFrame:
    """Three fields as strings, and the count."""
    rows = headers.join(counts, "bundle_id", "left")
    return rows.select("bundle_id", *[F.col(c).cast("string").alias(c) for c in ("voxel_order", "voxel_sizes", "dimensions")], F.coalesce("n", F.lit(0).cast("long")).cast("string").alias("count"))


def normalise_trx(headers: DataFrame) -> DataFrame:
    """Checked dimensions and sizes (null where bad), order RAS by default; no count."""
    return headers.select(
        "bundle_id",
        _order(F.lit("RAS")).alias("voxel_order"),
        parse_numeric_tuple(F.col("voxel_sizes"), "float", 3).alias("voxel_sizes"),
        parse_numeric_tuple(F.col("dimensions"), "int", 3).alias("dimensions"),
    )
