"""Set logic on line ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_logic_mode(log: DataFrame, key: str = "roi_id") -> DataFrame:
    """(key, mode): the last mode of each id by seq; 'none' drops out."""
    return log.groupBy(key).agg(F.max_by("mode", "seq").alias("mode")).where("mode <> 'none'")


def _of(hits: DataFrame, modes: DataFrame, mode: str, key: str) -> DataFrame:
    return hits.join(modes.where(F.col("mode") == mode).select(key), key, "left_semi")


def _narrowed(visible: DataFrame, hits: DataFrame, modes: DataFrame, key: str) -> DataFrame:
    """In every included set and in no excluded one; an id without hits is an empty set."""
    needed = modes.where("mode = 'include'").count()  # one number
    if needed:
        counts = _of(hits, modes, "include", key).groupBy("sid").agg(F.count_distinct(key).alias("n"))
        visible = visible.join(counts.where(F.col("n") == needed), "sid", "left_semi")
    return visible.join(_of(hits, modes, "exclude", key), "sid", "left_anti")


def apply_logic_filters(manual: DataFrame, roi_hits: DataFrame, roi_modes: DataFrame, region_hits: DataFrame | None = None, region_modes: DataFrame | None = None) -> DataFrame:
    """(sid): the manual set, narrowed by regions of interest, then by labelled regions."""
    visible = _narrowed(manual.select("sid"), roi_hits, roi_modes, "roi_id")
    if region_hits is not None and region_modes is not None:
        visible = _narrowed(visible, region_hits, region_modes, "label")
    return visible


def roi_highlight(hits: DataFrame, modes: DataFrame) -> DataFrame:
    return _of(hits, modes, "select", "roi_id").select("sid").distinct()


def selection_add(selected: DataFrame, ids: DataFrame) -> DataFrame:
    return selected.select("sid").union(ids.select("sid")).distinct()


def selection_remove(selected: DataFrame, ids: DataFrame) -> DataFrame:
    return selected.select("sid").join(ids.select("sid"), "sid", "left_anti")


def selection_invert(visible: DataFrame, selected: DataFrame) -> DataFrame:
    return visible.select("sid").join(selected.select("sid"), "sid", "left_anti")


def delete_selected(manual: DataFrame, selected: DataFrame) -> DataFrame:
    return manual.select("sid").join(selected.select("sid"), "sid", "left_anti")


def rename_roi(table: DataFrame, old: str, new: str, column: str = "name") -> DataFrame:
    return table.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def remove_roi(table: DataFrame, roi_id: int) -> DataFrame:
    return table.where(F.col("roi_id") != roi_id)
