"""Density, connectivity, masks and spherical harmonics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.affine import AXES, INDEX, Affine, diagonal
from ..sources.files import materialise
from .geometry import nearest_voxel

PADDING = 5.0
#: Most labels of a dense matrix, and most vertices, and different rows of a basis, that go to every task.
BROADCAST_LABELS, BROADCAST_BASIS, BROADCAST_CLASSES = 5_000, 1_000_000, 20_000


def density_map(points: DataFrame, affine: Affine, dims: Sequence[int]) -> DataFrame:
    """(i, j, k, n): points in each voxel.  Partial sums first, so a full voxel is no hot key."""
    return nearest_voxel(points, affine, dims).groupBy(*INDEX).agg(F.count("*").alias("n"))


def density_grid(points: DataFrame, image: tuple[Affine, Sequence[int]] | None = None, header: tuple[Affine, Sequence[int]] | None = None) -> tuple[Affine, tuple[int, ...]]:
    """The image's grid, else the header's, else 1 mm voxels over the points' bounds and PADDING.  Six numbers go to the driver."""
    for known in (image, header):
        if known is not None:
            return known[0], tuple(known[1])
    row = grid_of_bounds(points).first()
    return diagonal((1, 1, 1), [row[f"origin_{a}"] for a in AXES]), tuple(int(row[f"n{a}"]) for a in AXES)


def grid_of_bounds(points: DataFrame) -> DataFrame:
    """One row: origin_x.. and nx.. of the grid of 1 mm voxels over the points."""
    ends = points.agg(*[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES])
    low, high = {a: F.col(f"lo{a}") - PADDING for a in AXES}, {a: F.col(f"hi{a}") + PADDING for a in AXES}
    return ends.select(*[low[a].alias(f"origin_{a}") for a in AXES], *[F.ceil(high[a] - low[a]).cast("int").alias(f"n{a}") for a in AXES])


def density_summary(density: DataFrame) -> DataFrame:
    return density.agg(F.count("*").alias("voxels"), F.sum("n").alias("points"), F.max("n").alias("most"))


def connectivity_edges(labelled: DataFrame) -> DataFrame:
    """(label_a, label_b, n): lines between two labels over 0, in both directions; a label's lines to itself once."""
    low, high = F.least("label_a", "label_b"), F.greatest("label_a", "label_b")
    half = labelled.where("label_a > 0 AND label_b > 0").groupBy(low.alias("a"), high.alias("b")).agg(F.count("*").alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")))).otherwise(
        F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))
    )
    return half.select(F.explode(ways).alias("w"), "n").select(F.col("w.p").alias("label_a"), F.col("w.q").alias("label_b"), "n")


def connected_labels(labelled: DataFrame) -> DataFrame:
    """(label): labels over 0 at any end."""
    return labelled.select(F.explode(F.array("label_a", "label_b")).alias("label")).where("label > 0").distinct()


def connectivity_matrix(labelled: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(label_a, label_b, n) for all pairs of connected labels, with zeros; names beside them if given.

    The result is the square of the labels by what it is.  The labels are counted first and then
    go to every task; more than BROADCAST_LABELS are an error, as their square is no table to export
    (``connectivity_edges`` has the pairs that occur).
    """
    axis = [r.label for r in connected_labels(labelled).limit(BROADCAST_LABELS + 1).collect()]
    if len(axis) > BROADCAST_LABELS:
        raise ValueError(f"a matrix of more than {BROADCAST_LABELS} labels; take connectivity_edges")
    kind = labelled.schema["label_a"].dataType
    labels = labelled.sparkSession.createDataFrame([(x,) for x in sorted(axis)], T.StructType([T.StructField("label", kind)]))
    rows = labels.select(F.col("label").alias("label_a"), F.explode(F.array(*[F.lit(x) for x in sorted(axis)]) if axis else F.array().cast(T.ArrayType(kind))).alias("label_b"))
    dense = rows.join(connectivity_edges(labelled), ["label_a", "label_b"], "left").select("label_a", "label_b", F.coalesce("n", F.lit(0)).alias("n"))
    if names is None:
        return dense
    for c in ("a", "b"):
        own = names.select(F.col("label").alias(f"label_{c}"), F.col("name").alias(f"name_{c}"))
        dense = dense.join(own, f"label_{c}", "left").withColumn(f"name_{c}", F.coalesce(f"name_{c}", F.concat(F.lit("Region_"), f"label_{c}")))
    return dense


def region_degree(labelled: DataFrame) -> DataFrame:
    """(label, degree): row sums of the matrix, zeros included."""
    sums = connectivity_edges(labelled).groupBy(F.col("label_a").alias("label")).agg(F.sum("n").alias("degree"))
    return connected_labels(labelled).join(sums, "label", "left").select("label", F.coalesce("degree", F.lit(0)).alias("degree"))


def dilate(voxels: DataFrame, dims: Sequence[int], times: int) -> DataFrame:
    """Voxels and their six neighbours inside the grid, ``times`` over."""
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    for _ in range(times):
        moved = F.explode(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(INDEX, s, strict=True)]) for s in steps]))
        voxels = voxels.select(moved.alias("v")).select("v.*")
        voxels = voxels.where(reduce(lambda a, b: a & b, [F.col(c).between(0, n - 1) for c, n in zip(INDEX, dims, strict=True)])).distinct()
    return voxels


def tunnel_mask(points: DataFrame, affine: Affine, dims: Sequence[int], dilations: int = 1) -> DataFrame:
    return dilate(nearest_voxel(points, affine, dims).select(*INDEX).distinct(), dims, dilations)


def mask_extent(mask: DataFrame) -> DataFrame:
    return mask.agg(*[f(c).alias(f"{n}_{c}") for c in INDEX for n, f in (("min", F.min), ("max", F.max))])


def sh_order(counts: DataFrame, column: str = "n") -> DataFrame:
    """``counts`` with sh_order, null where no order has so many coefficients."""
    order = (F.sqrt(8 * F.col(column) + 1) - 3) / 2
    return counts.withColumn("sh_order", F.when(order == F.floor(order), order.cast("int")))


def sh_basis(vertices: DataFrame, order: int) -> DataFrame:
    """(vertex, idx, b): real even-order basis at (vertex, x, y, z), by closed sums as column expressions.

    idx counts l = 0, 2, .. and m = -l..l; b is sqrt(2) times the imaginary part
    for m < 0 and the real part for m > 0 of the complex harmonic of (l, m).
    """
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rows = vertices.select("vertex", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / r)).alias("c"), F.atan2("y", "x").alias("phi"))
    rows = rows.withColumn("s", F.sqrt(1 - F.col("c") * F.col("c")))
    terms, idx = [], 0
    for degree in range(0, order + 1, 2):
        for m in range(-degree, degree + 1):
            terms.append(F.struct(F.lit(idx).alias("idx"), _harmonic(degree, m).alias("b")))
            idx += 1
    return rows.select("vertex", F.explode(F.array(*terms)).alias("t")).select("vertex", "t.idx", "t.b")


def _harmonic(degree: int, m: int):
    """One real basis function of the columns c, s (cosine and sine of the polar angle) and phi."""
    a = abs(m)
    scale = math.sqrt((2 * degree + 1) / (4 * math.pi) * math.factorial(degree - a) / math.factorial(degree + a))
    # associated Legendre function as s^a times the a-th derivative of the Legendre polynomial
    powers = [(degree - 2 * q, (-1) ** q * math.factorial(2 * degree - 2 * q) / (2**degree * math.factorial(q) * math.factorial(degree - q) * math.factorial(degree - 2 * q))) for q in range(degree // 2 + 1)]
    derived = [(p - a, f * math.factorial(p) / math.factorial(p - a)) for p, f in powers if p >= a]
    legendre = reduce(lambda x, y: x + y, [F.lit(f) * F.pow("c", F.lit(float(p))) for p, f in derived]) * F.pow("s", F.lit(float(a))) * float((-1) ** a)
    if m == 0:
        return legendre * scale
    if m > 0:
        return legendre * F.cos(a * F.col("phi")) * (scale * math.sqrt(2))
    # Y(l, -a) = (-1)^a conj(Y(l, a)), whose imaginary part has the other sign
    return legendre * F.sin(a * F.col("phi")) * (-1.0) ** (a + 1) * (scale * math.sqrt(2))


def masked_odf_amplitudes(coefficients: DataFrame, mask: DataFrame, basis: DataFrame) -> DataFrame:
    """(i, j, k, vertex, amplitude) at masked voxels, from ``coefficients`` (i, j, k, coeffs) and a ``basis`` (vertex, idx, b) of vertices times coefficients rows.

    Coefficients of one voxel are added up first.  Vertices with equal rows of the basis are one class: each voxel
    is multiplied with each class once, inside a row, and the amplitudes are joined to the vertices of the class.
    """
    spark = coefficients.sparkSession
    few = lambda df, most: F.broadcast(df) if df.limit(most + 1).count() <= most else df
    in_order = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("idx", v))), lambda t: t[v])
    terms = coefficients.join(mask, list(INDEX), "left_semi").select(*INDEX, F.posexplode("coeffs").alias("idx", "c"))
    voxels = terms.groupBy(*INDEX, "idx").agg(F.sum("c").alias("c")).groupBy(*INDEX).agg(in_order("c").alias("cs"))
    voxels = voxels.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # few rows here, but many after the join
    by_idx = basis.where("idx >= 0").groupBy("vertex", "idx").agg(F.sum("b").alias("b")).groupBy("vertex").agg(F.map_from_entries(F.collect_list(F.struct("idx", "b"))).alias("b"))
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("b"))), lambda k: F.try_element_at("b", k))
    vertices = materialise(by_idx.select("vertex", F.array_min(F.map_keys("b")).alias("first"), dense.alias("bs")), "vertices")
    kinds = vertices.groupBy("first", "bs").agg(F.min("vertex").alias("__class"))
    members = few(vertices.join(kinds, ["first", "bs"]).select("vertex", "__class"), BROADCAST_BASIS)
    products = F.filter(F.zip_with("cs", "bs", lambda c, b: c * b), lambda v: v.isNotNull())
    each = voxels.crossJoin(few(kinds, BROADCAST_CLASSES)).where(F.col("first") < F.size("cs")).select(*INDEX, "__class", products.alias("products"))
    amplitude = F.when(F.size("products") > 0, F.aggregate("products", F.lit(0.0), lambda x, v: x + v))
    return each.select(*INDEX, "__class", amplitude.alias("amplitude")).join(members, "__class").select(*INDEX, "vertex", "amplitude")


def top_regions(histogram: DataFrame, connected: DataFrame, *, most: int = 20, least_voxels: int = 50) -> DataFrame:
    """The ``most`` largest connected regions, of those the ones of enough voxels."""
    return histogram.join(connected, "label", "left_semi").orderBy(F.desc("n"), "label").limit(most).where(F.col("n") >= least_voxels)


def ranked_by(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
