"""Matrices, masks and summaries to write."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import INDEX, Affine, transformed


def axis_names(matrix: DataFrame, names: DataFrame | None, most: int = 5_000) -> list[tuple[int, str]]:
    """(label, name) of the matrix's axis, in order.  It goes to the driver, as columns must have names; over ``most`` labels are an error.

    A label without a name is Region_<label>; a name of several labels is followed by _<label>.
    """
    axis = matrix.select(F.col("label_a").alias("label")).distinct()
    axis = axis.join(names, "label", "left") if names is not None else axis.withColumn("name", F.lit(None).cast("string"))
    found = axis.select("label", F.coalesce("name", F.concat(F.lit("Region_"), F.col("label").cast("string")))).orderBy("label").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels for a wide table")
    uses = Counter(name for _, name in found)
    return [(label, name if uses[name] == 1 else f"{name}_{label}") for label, name in found]


def wide_matrix(matrix: DataFrame, axis: list[tuple[int, str]]) -> DataFrame:
    """A row for each label of ``axis``, with its name, and a column for each, by name."""
    wide = matrix.groupBy("label_a").pivot("label_b", [label for label, _ in axis]).agg(F.first("n"))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in axis for x in pair]), F.col("label_a")) if axis else F.lit(None).cast("string")
    return wide.select(F.col("label_a").alias("label"), name.alias("name"), *[F.coalesce(F.col(f"`{label}`"), F.lit(0)).alias(n) for label, n in axis])


def export_connectivity_csv(matrix: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """The matrix at ``path`` as CSV with names as its first row and column, and its axis (label, name, n_regions) at ``path``_labels as JSON.

    ``names`` (label, name): one row a label.
    """
    axis = axis_names(matrix, names)
    wide_matrix(matrix, axis).orderBy("label").drop("label").write.option("header", True).csv(path)
    table = matrix.sparkSession.createDataFrame([(*x, len(axis)) for x in axis], "label long, name string, n_regions long")
    table.coalesce(1).write.json(f"{path}_labels")


def region_mask(parcels: DataFrame, label: int) -> DataFrame:
    """Voxels of one label with value 1; an error if there is none."""
    mask = parcels.where(F.col("label") == label).select(*INDEX, F.lit(1).alias("value"))
    if mask.isEmpty():
        raise ValueError(f"no voxel has label {label}")
    return mask


def roi_summary(rois: DataFrame, shapes: DataFrame, affine: Affine) -> DataFrame:
    """(roi_id, cx, cy, cz, r): a shape's own numbers, else the centre of mass and half the mean extent of its voxels."""
    drawn = rois.where("value > 0").groupBy("roi_id").agg(*[F.avg(c).alias(f"m{c}") for c in INDEX], *[(F.max(c) - F.min(c)).alias(f"s{c}") for c in INDEX])
    centre = transformed(affine, [F.col(f"m{c}") for c in INDEX])
    found = drawn.select("roi_id", *[c.alias(f"g{n}") for c, n in zip(centre, "xyz", strict=True)], ((F.col("si") + F.col("sj") + F.col("sk")) / 6).alias("gr"))
    return found.join(shapes, "roi_id", "full").select("roi_id", *[F.coalesce(f"c{n}", f"g{n}").alias(f"c{n}") for n in "xyz"], F.coalesce("r", "gr").alias("r"))
