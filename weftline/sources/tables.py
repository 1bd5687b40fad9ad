"""Canonical tables derived from the given Parquet tables, and the same in SQL.

``WITH`` holds one SQL expression for each table; ``with_tables`` prefixes those
that a query names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.affine import AXES, diagonal
from ..operators.geometry import nearest_voxel

GRID = diagonal((4, 4, 4), (-48, -48, -48))
DIMS = (25, 25, 25)
SMALL = diagonal((4, 4, 4), (-24, -24, -24))
SMALL_DIMS = (13, 13, 13)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 21 points from the embeddings."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("bundle_id"), F.col("vec_id").alias("sid"), "embedding")
    rows = e.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return rows.select("bundle_id", "sid", "pid", *[(F.get("embedding", 3 * F.col("pid") + k).cast("double") * 100.0).alias(a) for k, a in enumerate(AXES)])


def lines_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged lines from the line items."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[c for c in li.columns if c not in ("l_orderkey", "l_linenumber")])
    return li.select(
        F.col("l_orderkey").alias("sid"),
        (F.row_number().over(order) - 1).alias("pid"),
        (F.col("l_quantity") - 25).alias("x"),
        (F.col("l_extendedprice") / 2000 - 26).alias("y"),
        (500 * F.col("l_discount") - 25).alias("z"),
    )


def points_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of ``lines_l`` without their order: no window."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") / 2000 - 26).alias("y"), (500 * F.col("l_discount") - 25).alias("z"))


def lines_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the events of each user."""
    order = Window.partitionBy("user_id").orderBy("ts")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), (F.row_number().over(order) - 1).alias("pid"), F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"), F.dayofmonth("ts").cast("double").alias("z")
    )


def scalars_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_e(spark, sf_dir).select("sid", "pid", F.lit("mag").alias("name"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("value"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels (i, j, k, value): how many line items fall in each."""
    return nearest_voxel(points_l(spark, sf_dir), GRID, DIMS).groupBy("i", "j", "k").agg(F.count("*").cast("double").alias("value"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels (i, j, k, label) of the image; every seventh diagonal is unlabelled."""
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    label = F.when((i + j + k) % 7 == 0, 0).otherwise(1 + F.floor(i / 5) + 5 * F.floor(j / 5) + 25 * F.floor(k / 5))
    return image(spark, sf_dir).select("i", "j", "k", label.cast("int").alias("label"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("label"), F.col("p_name").alias("name"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        s.alias("roi_id"), *[((m * s) % 40 - 20).cast("double").alias(c) for m, c in ((7, "cx"), (11, "cy"), (13, "cz"))], (3 + s % 5).cast("double").alias("r")
    )


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of modes: the last of each id counts."""
    s = F.col("s_suppkey")
    mode = F.when(s.isin(2, 8), "include").when(s == 1, "exclude").when(s == 3, "select").otherwise("none")
    rows = read(spark, sf_dir, "supplier")
    return rows.select(s.alias("roi_id"), F.lit("exclude").alias("mode"), F.lit(0).alias("seq")).unionByName(rows.select(s.alias("roi_id"), mode.alias("mode"), F.lit(1).alias("seq")))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed header fields, one row a nation."""
    n = F.col("n_nationkey")
    kind = n % 5
    sizes = (
        F.when(kind == 0, F.concat(F.lit("("), n + 1, F.lit(", 2, 3)")))
        .when(kind == 1, F.concat(F.lit("[1 "), n, F.lit(" 3.5]")))
        .when(kind == 2, F.concat(F.lit("1,"), n, F.lit(" 3")))
        .when(kind == 3, F.lit("bad value"))
    )
    dims = F.when(kind == 0, F.concat(n, F.lit(".9 20 30"))).when(kind == 1, F.lit("[25, 25, 25]")).when(kind == 2, F.lit("1,2"))
    return read(spark, sf_dir, "nation").select(n.alias("bundle_id"), F.when(n % 3 == 0, "RAS").when(n % 3 == 1, "LPS").alias("voxel_order"), sizes.alias("voxel_sizes"), dims.alias("dimensions"))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        (v % 25).cast("int").alias("i"), (F.floor(v / 25) % 25).cast("int").alias("j"), (12 + F.floor(v / 625)).cast("int").alias("k"), F.slice("embedding", 1, 15).cast("array<double>").alias("coeffs")
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "add", "view", "remove", "signup", "redo", "error", "undo", "purchase", "delete")]), F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 500).alias("sid"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines in voxel coordinates: every user's events of one kind."""
    v = lines_v(spark, sf_dir)
    return v.select("sid", "pid", (F.col("x") / 10).alias("x"), F.col("y"), (F.col("z") % 25).alias("z"))


_LI = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_VOX = ", ".join(f"round_even(({a} + 48.0::DOUBLE) / 4.0::DOUBLE, 0)::INT AS {c}" for a, c in zip("xyz", "ijk", strict=True))
WITH = {
    "e": "SELECT label AS bundle_id, vec_id AS sid, p::INT AS pid, embedding[3*p+1]::DOUBLE*100.0::DOUBLE AS x, embedding[3*p+2]::DOUBLE*100.0::DOUBLE AS y, embedding[3*p+3]::DOUBLE*100.0::DOUBLE AS z"
    " FROM embeddings, range(21) t(p)",
    "l": f"SELECT l_orderkey AS sid, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LI}) - 1)::INT AS pid, l_quantity - 25 AS x, l_extendedprice / 2000 - 26 AS y, 500 * l_discount - 25 AS z FROM lineitem",
    "v": "SELECT user_id AS sid, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS pid, value AS x, hour(ts)::DOUBLE AS y, day(ts)::DOUBLE AS z FROM events",
    "s": "SELECT sid, pid, 'mag' AS name, sqrt(x*x + y*y + z*z) AS value FROM e",
    "ev": f"SELECT * FROM (SELECT *, {_VOX} FROM e) WHERE i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 24 AND k BETWEEN 0 AND 24",
    "img": f"SELECT i, j, k, count(*)::DOUBLE AS value FROM (SELECT {_VOX} FROM (SELECT l_quantity - 25 AS x, l_extendedprice / 2000 - 26 AS y, 500 * l_discount - 25 AS z FROM lineitem))"
    " WHERE i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 24 AND k BETWEEN 0 AND 24 GROUP BY i, j, k",
    "parc": "SELECT i, j, k, (CASE WHEN (i+j+k)%7 = 0 THEN 0 ELSE 1 + i//5 + 5*(j//5) + 25*(k//5) END)::INT AS label FROM img",
    "lut": "SELECT p_partkey::INT AS label, p_name AS name FROM part",
    "shapes": "SELECT s_suppkey AS roi_id, ((7*s_suppkey)%40-20)::DOUBLE AS cx, ((11*s_suppkey)%40-20)::DOUBLE AS cy, ((13*s_suppkey)%40-20)::DOUBLE AS cz, (3+s_suppkey%5)::DOUBLE AS r FROM supplier",
    "modes": "SELECT s_suppkey AS roi_id, CASE WHEN s_suppkey IN (2, 8) THEN 'include' WHEN s_suppkey = 1 THEN 'exclude' WHEN s_suppkey = 3 THEN 'select' ELSE 'none' END AS mode FROM supplier",
    "coef": "SELECT (vec_id % 25)::INT AS i, ((vec_id // 25) % 25)::INT AS j, (12 + vec_id // 625)::INT AS k, embedding[1:15]::DOUBLE[] AS coeffs FROM embeddings",
    "ends": "SELECT sid, count(*) AS n_points, arg_min(x, pid) AS x0, arg_min(y, pid) AS y0, arg_min(z, pid) AS z0, arg_max(x, pid) AS x1, arg_max(y, pid) AS y1, arg_max(z, pid) AS z1 FROM e GROUP BY sid",
    "voxends": "SELECT *, " + ", ".join(f"round_even(({a}{e} + 48.0::DOUBLE) / 4.0::DOUBLE, 0)::INT AS {c}{e}" for e in "01" for a, c in zip("xyz", "ijk", strict=True)) + " FROM ends",
    "lab": "SELECT sid, coalesce(p.label, 0) AS label_a, coalesce(q.label, 0) AS label_b FROM voxends v LEFT JOIN parc p ON p.i = i0 AND p.j = j0 AND p.k = k0 LEFT JOIN parc q ON q.i = i1 AND q.j = j1 AND q.k = k1",
    "hits": "SELECT DISTINCT roi_id, sid FROM shapes JOIN (SELECT e.*, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM e WINDOW w AS (PARTITION BY sid ORDER BY pid)) g ON"
    " ((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz) < r*r OR (x2 IS NOT NULL AND (x2-x)*(x2-x) + (y2-y)*(y2-y) + (z2-z)*(z2-z) > 0 AND {seg} < r*r))",
    "res": "SELECT sid, k, x, y, z FROM ({resample})",
}
# squared distance of a sphere's centre to the nearest point of a segment
_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx-x)*(x2-x) + (cy-y)*(y2-y) + (cz-z)*(z2-z)) / ((x2-x)*(x2-x) + (y2-y)*(y2-y) + (z2-z)*(z2-z))))"
SEGMENT = " + ".join(f"({a} + {_T}*({a}2-{a}) - c{a})*({a} + {_T}*({a}2-{a}) - c{a})" for a in "xyz")
WITH["hits"] = WITH["hits"].replace("{seg}", f"({SEGMENT})")
NEEDS = {"s": ["e"], "ev": ["e"], "parc": ["img"], "ends": ["e"], "voxends": ["ends"], "lab": ["voxends", "parc"], "hits": ["shapes", "e"], "res": ["e"], "cum": ["e"]}


def resample_sql(source: str, n: int) -> str:
    return f"""
    WITH st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)), 0) AS step FROM {source} WINDOW w AS (PARTITION BY sid ORDER BY pid)),
    cu AS (SELECT *, sum(step) OVER (PARTITION BY sid ORDER BY pid) AS cum FROM st),
    sg AS (SELECT *, lead(cum) OVER w AS cum2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, max(cum) OVER (PARTITION BY sid) AS total, pid = min(pid) OVER (PARTITION BY sid) AS first FROM cu WINDOW w AS (PARTITION BY sid ORDER BY pid)),
    kk AS (SELECT *, CASE WHEN cum = 0 THEN 0 ELSE floor(cum * {n - 1} / total)::INT + 1 END AS k0, CASE WHEN cum2 = total THEN {n - 1} ELSE floor(cum2 * {n - 1} / total)::INT END AS k1 FROM sg WHERE total > 0 AND cum2 > cum),
    ks AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM kk WHERE k0 <= k1),
    tt AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (k * total / {n - 1} - cum) / (cum2 - cum))) AS t FROM ks)
    SELECT sid, k::INT AS k, x + t*(x2-x) AS x, y + t*(y2-y) AS y, z + t*(z2-z) AS z FROM tt
    UNION ALL SELECT sid, unnest(range({n}))::INT AS k, x, y, z FROM sg WHERE total = 0 AND first
    """


WITH["res"] = resample_sql("e", 12)


def with_tables(sql: str) -> str:
    """``sql`` behind the definitions of those tables that it, or they, name."""
    used: list[str] = []

    def use(name: str) -> None:
        if name not in used:
            for other in NEEDS.get(name, []):
                use(other)
            used.append(name)

    for name in WITH:
        if re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", sql):
            use(name)
    head = ", ".join(f"{n} AS ({WITH[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
