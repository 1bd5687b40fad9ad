"""Queries of layouts, projections and samples (L, G, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.affine import AXES, IDENTITY
from ..operators import geometry as g
from ..operators import layout, sampling
from ..sources import tables as t
from .base import Plans

plan = Plans()
TURN = (0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0)


@plan("""SELECT e.sid, count(*) AS n_points, min(x::FLOAT)::DOUBLE AS minx, max(z::FLOAT)::DOUBLE AS maxz, arg_min(x::FLOAT, e.pid)::DOUBLE AS first_x, arg_max(value, e.pid) AS last_mag
FROM e JOIN s ON e.sid = s.sid AND e.pid = s.pid GROUP BY e.sid""")
def load_bundle(spark, d):
    b = layout.load_bundle(t.lines_e(spark, d), t.scalars_e(spark, d))
    return b.select("sid", "n_points", "minx", "maxz", F.get("points", 0)["x"].alias("first_x"), F.element_at(F.col("scalars")["mag"], -1).alias("last_mag"))


def _csr(spark, d):
    """Points numbered backwards, so that the connectivity matters."""
    e = t.lines_e(spark, d).withColumn("point_id", 1_000_000_000 - F.col("sid") * 100 - F.col("pid"))
    lines = e.groupBy(F.col("sid").alias("line_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pid", "point_id"))), lambda s: s["point_id"]).alias("conn"))
    return e.select("point_id", *AXES), lines


@plan("SELECT sid, pid, x, y, z FROM e")
def csr_to_streamlines(spark, d):
    return layout.csr_to_points(*_csr(spark, d))


@plan("""SELECT l.sid, l.pid, sum(1) OVER (ORDER BY l.sid, l.pid) - 1 AS point_id, x, y, z FROM l""")
def streamlines_to_csr(spark, d):
    points = t.lines_l(spark, d)
    flat, lines = layout.to_csr(points)
    back = lines.select("sid", F.explode(F.sequence("start", F.col("start") + F.col("n_points") - 1)).alias("point_id"), "start")
    return back.join(flat, "point_id").select("sid", (F.col("point_id") - F.col("start")).alias("pid"), "point_id", *AXES)


@plan("SELECT sid, count(*) AS n_points, min(x) AS minx, max(y) AS maxy, arg_min(z, pid) AS z0, arg_max(z, pid) AS z1 FROM l GROUP BY sid")
def long_to_nested(spark, d):
    return layout.to_nested(t.lines_l(spark, d)).select("sid", "n_points", "minx", "maxy", F.get("points", 0)["z"].alias("z0"), F.element_at("points", -1)["z"].alias("z1"))


@plan("SELECT sid, pid, x, y, z FROM v")
def nested_to_long(spark, d):
    return layout.to_long(layout.to_nested(t.lines_v(spark, d)))


@plan("SELECT e.sid, e.pid, x, y, z, value FROM e JOIN s ON e.sid = s.sid AND e.pid = s.pid WHERE e.sid % 3 = 0")
def save_visible(spark, d):
    from ..sources.files import scratch

    bundle = layout.load_bundle(t.lines_e(spark, d), t.scalars_e(spark, d)).drop("points").join(layout.to_nested(t.lines_e(spark, d)).select("sid", "points"), "sid")
    path = scratch(spark, "visible")
    layout.save_visible(bundle, t.lines_e(spark, d).where("sid % 3 = 0").select("sid").distinct(), path)
    saved = spark.read.parquet(path)
    rows = saved.select("sid", F.posexplode(F.arrays_zip("points", F.col("scalars")["mag"].alias("mag"))).alias("pid", "p"))
    return rows.select("sid", "pid", *[F.col(f"p.points.{a}").alias(a) for a in AXES], F.col("p.mag").alias("value"))


@plan("SELECT sid, pid, -y + 5 AS x, x - 2 AS y, 2*z + 1 AS z FROM l")
def apply_bundle_affine(spark, d):
    return layout.apply_bundle_affine(layout.apply_bundle_affine(t.lines_l(spark, d), IDENTITY), TURN)


@plan("""SELECT sid, min(x) AS minx, min(y) AS miny, min(z) AS minz, max(x) AS maxx, max(y) AS maxy, max(z) AS maxz, sid % 4 = 0 AS reused FROM l GROUP BY sid""")
def bbox_columns_reuse(spark, d):
    points = t.lines_l(spark, d)
    box = layout.streamline_bbox(points.where("sid % 2 = 0"))
    return layout.reuse_bbox(points, box.withColumn("minx", F.when(F.col("sid") % 4 == 0, F.col("minx"))))


@plan("SELECT i, j, k, (i*4 - 48)::DOUBLE AS x, (j*4 - 48)::DOUBLE AS y, (k*4 - 48)::DOUBLE AS z FROM img")
def voxel_to_world(spark, d):
    return g.voxel_to_world(t.image(spark, d).select("i", "j", "k"), t.GRID)


@plan("SELECT sid, pid, (x + 48)/4 AS vi, (y + 48)/4 AS vj, (z + 48)/4 AS vk FROM e")
def world_to_voxel(spark, d):
    return g.world_to_voxel(t.lines_e(spark, d), t.GRID).select("sid", "pid", "vi", "vj", "vk")


@plan("SELECT sid, pid, i, j, k FROM ev")
def nearest_voxel(spark, d):
    return g.nearest_voxel(t.lines_e(spark, d), t.GRID, t.DIMS).select("sid", "pid", "i", "j", "k")


@plan("SELECT sid, min(x) AS minx, min(y) AS miny, min(z) AS minz, max(x) AS maxx, max(y) AS maxy, max(z) AS maxz FROM l GROUP BY sid")
def streamline_bbox(spark, d):
    return layout.streamline_bbox(t.lines_l(spark, d))


@plan("SELECT sid, pid, greatest(0, least(12, round_even((x+24)/4, 0)::INT)) AS i, greatest(0, least(12, round_even((y+24)/4, 0)::INT)) AS j, greatest(0, least(12, round_even((z+24)/4, 0)::INT)) AS k FROM e")
def snap_ras_clamped(spark, d):
    return g.snap_clamped(t.lines_e(spark, d), t.SMALL, t.SMALL_DIMS).select("sid", "pid", "i", "j", "k")


@plan("""WITH st AS (SELECT sid, pid, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)), 0) AS step FROM l WINDOW w AS (PARTITION BY sid ORDER BY pid))
SELECT sid, pid, round(sum(step) OVER (PARTITION BY sid ORDER BY pid), 6) AS cum FROM st""")
def arc_length(spark, d):
    return g.arc_length(t.lines_l(spark, d)).select("sid", "pid", F.round("cum", 6).alias("cum"))


@plan("SELECT sid, k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM res")
def resample_streamlines(spark, d):
    return g.resample(t.lines_e(spark, d), 12).select("sid", "k", *[F.round(a, 6).alias(a) for a in AXES])


@plan("SELECT sid, n_points, x0, y0, z0, x1, y1, z1 FROM ends")
def endpoints(spark, d):
    return g.endpoints(t.lines_e(spark, d))


@plan("""WITH n AS (SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) AS norm FROM ends)
SELECT sid, CASE WHEN norm > 1e-8 THEN abs((x1-x0)/norm) ELSE 0 END AS r, CASE WHEN norm > 1e-8 THEN abs((y1-y0)/norm) ELSE 0 END AS g, CASE WHEN norm > 1e-8 THEN abs((z1-z0)/norm) ELSE 0 END AS b FROM n""")
def orientation_rgb(spark, d):
    return g.orientation_rgb(t.lines_e(spark, d))


@plan("SELECT name, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS low, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS high FROM s GROUP BY name")
def scalar_range(spark, d):
    return g.scalar_range(t.scalars_e(spark, d))


@plan("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM s), q AS (SELECT s.*, lo, hi, round_even(1000*(value - lo)/(hi - lo), 0)::INT AS step FROM s, r)
SELECT sid, pid, step, round(lo + step/1000.0::DOUBLE*(hi - lo), 6) AS back FROM q""")
def scalar_rescale(spark, d):
    return g.scalar_rescale(t.scalars_e(spark, d)).select("sid", "pid", "step", F.round("back", 6).alias("back"))


@plan("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM s WHERE NOT (sid % 10 = 0 AND pid = 3)),
b AS (SELECT sid, pid, CASE WHEN sid % 10 <> 0 THEN least(floor((value - lo)/(hi - lo)*256), 255)::INT END AS bin FROM s, r),
h AS (SELECT *, 6*0.667::DOUBLE*(1 - bin/255.0::DOUBLE) AS h FROM b)
SELECT sid, pid, bin, CASE WHEN bin IS NULL THEN 0.5 ELSE round(greatest(0, least(1, abs(h - 3) - 1)), 6) END AS r,
CASE WHEN bin IS NULL THEN 0.5 ELSE round(greatest(0, least(1, abs((h + 4) - 6*floor((h + 4)/6) - 3) - 1)), 6) END AS g,
CASE WHEN bin IS NULL THEN 0.5 ELSE round(greatest(0, least(1, abs((h + 2) - 6*floor((h + 2)/6) - 3) - 1)), 6) END AS b FROM h""")
def scalar_colormap(spark, d):
    scalars = t.scalars_e(spark, d).where("NOT (sid % 10 = 0 AND pid = 3)")
    return g.scalar_colormap(t.lines_e(spark, d), scalars).select("sid", "pid", "bin", *[F.round(c, 6).alias(c) for c in "rgb"])


@plan("SELECT l.sid, l.pid, n AS weight FROM l JOIN (SELECT sid, count(*) AS n FROM l GROUP BY sid) c ON l.sid = c.sid")
def broadcast_streamline_scalar(spark, d):
    points = t.lines_l(spark, d)
    return g.broadcast_line_scalar(points, points.groupBy("sid").agg(F.count("*").alias("weight")), "weight").select("sid", "pid", "weight")


@plan("""WITH c AS (SELECT DISTINCT label_a AS label FROM lab WHERE label_a > 0 UNION SELECT DISTINCT label_b FROM lab WHERE label_b > 0), r AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS k FROM c)
SELECT label, k % 20 AS palette_index, round(k*0.618033988749895::DOUBLE - floor(k*0.618033988749895::DOUBLE), 9) AS hue FROM r""")
def categorical_colour(spark, d):
    from ..operators import aggregate, spatial

    labels = t.parcels(spark, d).select("label").distinct()
    connected = aggregate.connected_labels(spatial.label_endpoints(t.lines_e(spark, d), t.parcels(spark, d), t.GRID))
    return g.categorical_colour(labels, connected).withColumn("hue", F.round("hue", 9))


@plan("""SELECT e.bundle_id::BIGINT AS bundle_id, count(DISTINCT sid) AS n_lines, count(*) AS n_points, any_value(CASE WHEN n_nationkey % 3 = 0 THEN 'RAS' WHEN n_nationkey % 3 = 1 THEN 'LPS' END) AS voxel_order
FROM e LEFT JOIN nation ON n_nationkey = bundle_id GROUP BY 1""")
def bundle_info(spark, d):
    info = g.bundle_info(t.lines_e(spark, d), t.headers(spark, d))
    return info.select(F.col("bundle_id").cast("long").alias("bundle_id"), "n_lines", "n_points", "voxel_order")


@plan("""WITH q AS (SELECT i, j, k, round_even((4*i - 48 + 24)/4.0::DOUBLE, 0)::INT AS ti, round_even((4*j - 48 + 24)/4.0::DOUBLE, 0)::INT AS tj, round_even((4*k - 48 + 24)/4.0::DOUBLE, 0)::INT AS tk FROM img)
SELECT * FROM q WHERE ti BETWEEN 0 AND 12 AND tj BETWEEN 0 AND 12 AND tk BETWEEN 0 AND 12""")
def grid_to_grid(spark, d):
    return g.grid_to_grid(t.image(spark, d).select("i", "j", "k"), t.GRID, t.SMALL, t.SMALL_DIMS)


@plan("SELECT sid FROM (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS r FROM (SELECT DISTINCT sid FROM l)) WHERE r % 7 = 0")
def stride_sample(spark, d):
    return sampling.stride_sample(t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid")).distinct(), 7)


@plan("""WITH c AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT n, CASE WHEN n > 20000 THEN greatest(0, least(99, trunc((1 - 20000/n::DOUBLE)*100)::INT)) ELSE 0 END AS skip_percent FROM c)
SELECT n, skip_percent, greatest(1, trunc(100.0/(100 - skip_percent))::INT) AS stride, CASE WHEN n >= 150000 THEN greatest(1, n // 20000) ELSE 1 END::INT AS pre_stride FROM p""")
def auto_stride(spark, d):
    return sampling.auto_stride(t.read(spark, d, "lineitem").select("l_orderkey"))


@plan("""WITH r AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS rank FROM (SELECT DISTINCT sid FROM l)), n AS (SELECT count(*) AS n FROM r)
SELECT sid FROM r, n WHERE rank IN (SELECT k*(n - 1) // 99 FROM range(100) t(k), n)""")
def linspace_sample(spark, d):
    return sampling.linspace_sample(t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("sid")).distinct(), 100)


@plan("SELECT sid, pid, x, y, z FROM l WHERE pid % 2 = 0 AND sid IN (SELECT sid FROM l GROUP BY sid HAVING count(*) > 1)")
def step_points(spark, d):
    return sampling.step_points(t.lines_l(spark, d), 2)


@plan("""WITH r AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS rank FROM (SELECT DISTINCT sid FROM e)), n AS (SELECT count(*) AS n FROM r),
p AS (SELECT * FROM e WHERE pid % 2 = 0 AND sid IN (SELECT sid FROM r, n WHERE rank IN (SELECT k*(n - 1) // 49 FROM range(50) t(k), n))),
c AS (SELECT sid, arg_max(x, pid) - arg_min(x, pid) AS dx, arg_max(y, pid) - arg_min(y, pid) AS dy, arg_max(z, pid) - arg_min(z, pid) AS dz FROM p GROUP BY sid),
m AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS norm FROM c)
SELECT p.sid, pid, x, y, z, trunc(CASE WHEN norm > 1e-8 THEN abs(dx/norm) ELSE 0 END*255)::INT AS r, trunc(CASE WHEN norm > 1e-8 THEN abs(dy/norm) ELSE 0 END*255)::INT AS g,
trunc(CASE WHEN norm > 1e-8 THEN abs(dz/norm) ELSE 0 END*255)::INT AS b FROM p JOIN m ON p.sid = m.sid""")
def export_sample(spark, d):
    return sampling.export_sample(t.lines_e(spark, d).drop("bundle_id"), 50)


@plan("""WITH c AS (SELECT sid, count(*) AS m FROM l GROUP BY sid), r AS (SELECT *, row_number() OVER (ORDER BY sid) - 1 AS rank, count(*) OVER () AS total FROM c)
SELECT count(*) FILTER (WHERE m > 1 AND rank IN (SELECT k*(total - 1) // 99 FROM range(100) t(k))) AS num_streamlines, max(total) AS total_streamlines FROM r""")
def sample_counts(spark, d):
    points = t.lines_l(spark, d)
    return sampling.sample_counts(points, sampling.export_sample(points, 100))
