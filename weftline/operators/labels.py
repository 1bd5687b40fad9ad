"""Label names and hemispheres."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: what the names of left and right regions hold
LEFT = ("left-", "ctx-lh-", "-lh-", "lh-", "lh_")
RIGHT = ("right-", "ctx-rh-", "-rh-", "rh-", "rh_")


def parse_lut(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """(label, name) of lines 'id name ...'; comments, blank lines and bad ids are skipped.

    Of lines with one id the last by the column ``order`` counts; without such a
    column, the last by name.
    """
    parts = F.split(F.trim(column), r"\s+")
    place = F.col(order) if order else F.get(parts, 1)
    rows = lines.where(~F.trim(column).startswith("#")).select(F.get(parts, 0).try_cast("int").alias("label"), F.get(parts, 1).alias("name"), place.alias("__place"))
    return rows.where("label IS NOT NULL AND name IS NOT NULL").groupBy("label").agg(F.max_by("name", "__place").alias("name"))


def lut_or_builtin(spark: SparkSession, path: str | None, builtin: DataFrame) -> DataFrame:
    """(label, name) of the label file at ``path``, its last line of an id counting; ``builtin`` (label, name), a table of usual names, where there is no such file or no label in it."""
    if path is None:
        return builtin.select("label", "name")
    try:
        lines = spark.read.text(path)
    except AnalysisException:  # there is no such path
        return builtin.select("label", "name")
    found = parse_lut(lines.withColumn("line", F.monotonically_increasing_id()), order="line")
    return builtin.select("label", "name") if found.isEmpty() else found


def named(labels: DataFrame, lut: DataFrame) -> DataFrame:
    return labels.join(lut, "label", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Region_"), F.col("label").cast("string"))))


def hemisphere(name: Column) -> Column:
    """left, right or other; left is looked for first."""
    lower = F.lower(name)
    any_of = lambda words: F.greatest(*[lower.contains(w) for w in words])
    return F.when(any_of(LEFT), "left").when(any_of(RIGHT), "right").otherwise("other")


def regions_by_hemisphere(named_labels: DataFrame, most: int = 100) -> DataFrame:
    """(hemisphere, label, name, rank, overflow): the first ``most`` by name of each side, and how many are left out."""
    sided = named_labels.withColumn("hemisphere", hemisphere(F.col("name")))
    side = Window.partitionBy("hemisphere")
    ranked = sided.withColumn("rank", F.row_number().over(side.orderBy(F.lower("name"), "label"))).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(side) - most))
    return ranked.where(F.col("rank") <= most).select("hemisphere", "label", "name", "rank", "overflow")
