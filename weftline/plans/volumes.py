"""Queries of volumes, labels, headers, exports and rasterisation (V, L08-L15, R)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.affine import AXES, INDEX, transformed
from ..operators import aggregate, export, labels, raster, spatial, volume
from ..operators import headers as h
from ..sources import tables as t
from ..sources.files import scratch
from .base import Plans

plan = Plans()


@plan("SELECT i, j, k, value FROM img WHERE k = 12")
def slice_volume(spark, d):
    return volume.slice_volume(t.image(spark, d), "k", 12, t.DIMS)


@plan("SELECT min(value) AS low, max(value) AS high, CASE WHEN max(value) <= 255 THEN 'uint8' WHEN max(value) <= 65535 THEN 'uint16' ELSE 'int32' END AS voxel_type FROM img")
def infer_voxel_type(spark, d):
    return volume.infer_voxel_type(t.image(spark, d))


@plan("SELECT min(value) AS low, max(value) AS high FROM img WHERE i IN (6, 12, 18) OR j IN (6, 12, 18) OR k IN (6, 12, 18)")
def value_range_sampled(spark, d):
    return volume.value_range_sampled(t.image(spark, d), t.DIMS)


@plan("WITH p AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.99) AS b FROM img) SELECT round(a, 6) AS low, round(b + 0.2::DOUBLE*(b - a), 6) AS high FROM p")
def intensity_window(spark, d):
    return volume.intensity_window(t.image(spark, d)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@plan("SELECT i//3 AS i, j//3 AS j, k//3 AS k, value FROM img WHERE i%3 = 0 AND j%3 = 0 AND k%3 = 0")
def downsample_stride(spark, d):
    return volume.downsample_stride(t.image(spark, d), volume.downsample_step(t.DIMS, 13**3))


_KERNEL = """g AS (SELECT o, exp(-0.5*o*o/0.64)/(SELECT sum(exp(-0.5*p*p/0.64)) FROM range(-3, 4) t(p)) AS w FROM range(-3, 4) t(o)),
kr AS (SELECT greatest(0, least(24, t + o)) AS s, t, sum(w) AS w FROM range(25) q(t), g GROUP BY 1, 2)"""


@plan(f"""WITH {_KERNEL}, a AS (SELECT t AS i, j, k, sum(value*w) AS v FROM img JOIN kr ON s = i GROUP BY 1, 2, 3), b AS (SELECT i, t AS j, k, sum(v*w) AS v FROM a JOIN kr ON s = j GROUP BY 1, 2, 3)
SELECT i, j, t AS k, round(sum(v*w), 6) AS value FROM b JOIN kr ON s = k GROUP BY 1, 2, 3""")
def gaussian_smooth(spark, d):
    return volume.gaussian_smooth(t.image(spark, d), t.DIMS).withColumn("value", F.round("value", 6))


@plan(f"""WITH {_KERNEL.replace("24", "8").replace("25", "9")}, d AS (SELECT i//3 AS i, j//3 AS j, k//3 AS k, value FROM img WHERE i%3 = 0 AND j%3 = 0 AND k%3 = 0),
a AS (SELECT t AS i, j, k, sum(value*w) AS v FROM d JOIN kr ON s = i GROUP BY 1, 2, 3), b AS (SELECT i, t AS j, k, sum(v*w) AS v FROM a JOIN kr ON s = j GROUP BY 1, 2, 3)
SELECT i, j, t AS k, i*12.0::DOUBLE - 48 AS x, j*12.0::DOUBLE - 48 AS y, t*12.0::DOUBLE - 48 AS z, round(sum(v*w), 6) AS value FROM b JOIN kr ON s = k GROUP BY 1, 2, 3""")
def downsample(spark, d):
    small, affine, _ = volume.downsample(t.image(spark, d), t.GRID, t.DIMS, 13**3)
    return small.select("i", "j", "k", *_world(affine), F.round("value", 6).alias("value"))


def _world(affine):
    return [c.alias(a) for c, a in zip(transformed(affine, [F.col(c) for c in INDEX]), AXES, strict=True)]


@plan("SELECT j AS i, 24 - i AS j, k, value FROM img")
def canonical_orientation(spark, d):
    # voxel axis i runs along -y, j along +x
    return volume.canonical_orientation(t.image(spark, d), (0, 4, 0, -48, -4, 0, 0, 48, 0, 0, 4, -48, 0, 0, 0, 1), t.DIMS)[0]


def _meta(spark, d):
    """A volume for each supplier, turned about z by a tenth of its key modulo 3."""
    a = (F.col("s_suppkey") % 3) * 0.1
    c, s = F.cos(a), F.sin(a)
    zero, one = F.lit(0.0), F.lit(1.0)
    affine = F.array(c * 2, -s * 3, zero, F.lit(-10.0), s * 2, c * 3, zero, F.lit(5.0), zero, zero, F.lit(4.0), F.lit(1.0), zero, zero, zero, one)
    return t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("volume_id"), F.lit(9).alias("nx"), F.lit(10).alias("ny"), F.lit(11).alias("nz"), affine.alias("affine"))


@plan("""WITH q AS (SELECT s_suppkey AS volume_id, cos((s_suppkey % 3)*0.1::DOUBLE) AS c, sin((s_suppkey % 3)*0.1::DOUBLE) AS s, s_suppkey % 3 <> 0 AS oblique FROM supplier)
SELECT volume_id, oblique, round(CASE WHEN oblique THEN 2.0 ELSE 2*c END, 6) AS a00, round(CASE WHEN oblique THEN 2*c*4 - 3*s*4.5 - 10 - 2*4 ELSE -10 END, 6) AS a03, round(CASE WHEN oblique THEN 2*s*4 + 3*c*4.5 + 5 - 3*4.5 ELSE 5 END, 6) AS a13 FROM q""")
def deoblique(spark, d):
    at = lambda k: F.round(F.get("affine", k), 6)
    return volume.deoblique(_meta(spark, d)).select("volume_id", "oblique", at(0).alias("a00"), at(3).alias("a03"), at(7).alias("a13"))


@plan("SELECT label, count(*) AS n FROM parc GROUP BY label")
def label_histogram(spark, d):
    return volume.label_histogram(t.parcels(spark, d))


@plan("""WITH c AS (SELECT label_a AS label FROM lab WHERE label_a > 0 UNION SELECT label_b FROM lab WHERE label_b > 0), n AS (SELECT label, count(*) AS n FROM parc GROUP BY label)
SELECT label, n FROM (SELECT n.* FROM n JOIN c USING (label) ORDER BY n DESC, label LIMIT 20) WHERE n >= 50""")
def top_regions(spark, d):
    connected = aggregate.connected_labels(spatial.label_endpoints(t.lines_e(spark, d), t.parcels(spark, d), t.GRID))
    return aggregate.top_regions(volume.label_histogram(t.parcels(spark, d)), connected)


@plan("""WITH o AS (SELECT * FROM img WHERE value > 8), b AS (SELECT greatest(0, min(i) - 1) AS a, greatest(0, min(j) - 1) AS b, greatest(0, min(k) - 1) AS c, least(24, max(i) + 1) AS p, least(24, max(j) + 1) AS q, least(24, max(k) + 1) AS r FROM o)
SELECT i - a AS i, j - b AS j, k - c AS k, i*4.0::DOUBLE - 48 AS x, j*4.0::DOUBLE - 48 AS y, k*4.0::DOUBLE - 48 AS z, value - 8 AS value FROM img, b WHERE i BETWEEN a AND p AND j BETWEEN b AND q AND k BETWEEN c AND r""")
def occupied_bounds(spark, d):
    crop, corner = volume.crop_to_bounds(t.image(spark, d).withColumn("value", F.col("value") - 8), t.DIMS)
    return crop.select("i", "j", "k", *_world(volume.shifted_affine(t.GRID, corner)), "value")


@plan("""SELECT label AS roi_id, min(i)*4.0::DOUBLE - 50 AS minx, min(j)*4.0::DOUBLE - 50 AS miny, min(k)*4.0::DOUBLE - 50 AS minz, (max(i) + 1)*4.0::DOUBLE - 46 AS maxx, (max(j) + 1)*4.0::DOUBLE - 46 AS maxy, (max(k) + 1)*4.0::DOUBLE - 46 AS maxz
FROM parc WHERE label > 0 GROUP BY label""")
def roi_world_aabb(spark, d):
    rois = t.parcels(spark, d).where("label > 0").select(F.col("label").alias("roi_id"), "i", "j", "k", F.lit(1).alias("value"))
    return volume.roi_world_aabb(rois, t.GRID)


def _lut_lines(spark, d):
    """Lines of a label file: every fifth one a comment, every seventh with a bad id, every third id named again further down."""
    p = F.col("p_partkey")
    line = F.concat(p.cast("string"), F.lit("  "), F.translate("p_name", " ", "-"), F.lit(" 10 20 30 0"))
    part = t.read(spark, d, "part")
    first = part.select(F.when(p % 5 == 0, F.concat(F.lit("# "), line)).when(p % 7 == 0, F.concat(F.lit("x"), line)).otherwise(line).alias("value"), p.alias("line"))
    again = F.concat(p.cast("string"), F.lit(" Again-"), p.cast("string"))
    return first.unionAll(part.where(p % 3 == 0).select(again, p + 1_000_000_000_000))


@plan("""WITH lt AS (SELECT p_partkey AS label, CASE WHEN p_partkey % 3 = 0 THEN 'Again-' || p_partkey ELSE replace(p_name, ' ', '-') END AS name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)
SELECT label, coalesce(name, 'Region_' || label) AS name FROM (SELECT DISTINCT label FROM parc) LEFT JOIN lt USING (label)""")
def label_lut(spark, d):
    return labels.named(t.parcels(spark, d).select("label").distinct(), labels.parse_lut(_lut_lines(spark, d), order="line"))


@plan("SELECT label, coalesce(name, 'Region_' || label) AS name FROM (SELECT DISTINCT label FROM parc) LEFT JOIN lut USING (label)")
def label_lut_builtin(spark, d):
    """Without a label file the names come from a given table."""
    return labels.named(t.parcels(spark, d).select("label").distinct(), labels.lut_or_builtin(spark, f"{d}/no-such-labels.txt", t.names(spark, d)))


def _region_names(spark, d):
    """Part names behind a side's prefix."""
    p = F.col("p_partkey")
    side = F.when(p % 4 == 0, "Left-").when(p % 4 == 1, "ctx-rh-").when(p % 4 == 2, "lh_").otherwise("")
    return t.read(spark, d, "part").select(p.alias("label"), F.concat(side, F.translate("p_name", " ", "_")).alias("name"))


_NAMES = "nm AS (SELECT p_partkey AS label, CASE p_partkey % 4 WHEN 0 THEN 'Left-' WHEN 1 THEN 'ctx-rh-' WHEN 2 THEN 'lh_' ELSE '' END || replace(p_name, ' ', '_') AS name FROM part)"
_SIDE = "CASE label % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'other' END AS hemisphere"


@plan(f"WITH {_NAMES} SELECT label, name, {_SIDE} FROM nm")
def classify_hemisphere(spark, d):
    return _region_names(spark, d).withColumn("hemisphere", labels.hemisphere(F.col("name")))


@plan(f"""WITH {_NAMES}, sd AS (SELECT *, {_SIDE} FROM nm), rk AS (SELECT *, row_number() OVER (PARTITION BY hemisphere ORDER BY lower(name), label) AS rank, greatest(0, count(*) OVER (PARTITION BY hemisphere) - 100) AS overflow FROM sd)
SELECT hemisphere, label, name, rank, overflow FROM rk WHERE rank <= 100""")
def regions_by_hemisphere(spark, d):
    return labels.regions_by_hemisphere(_region_names(spark, d))


_SIZES = """CASE n % 5 WHEN 0 THEN [n + 1.0::DOUBLE, 2, 3] WHEN 1 THEN [1.0::DOUBLE, n, 3.5] WHEN 2 THEN [1.0::DOUBLE, n, 3] END"""
_DIMS = "CASE n % 5 WHEN 0 THEN [n::INT, 20, 30] WHEN 1 THEN [25, 25, 25] END"
_N = "hn AS (SELECT n_nationkey AS n, CASE n_nationkey % 3 WHEN 0 THEN 'RAS' WHEN 1 THEN 'LPS' END AS o FROM nation)"


def _flat(df, *columns):
    return df.select(*[c for c in df.columns if c not in columns], *[F.get(c, k).alias(f"{c}_{k}") for c in columns for k in range(3)])


def _flat_sql(name: str, expr: str) -> str:
    return ", ".join(f"({expr})[{k + 1}] AS {name}_{k}" for k in range(3))


@plan(f"WITH {_N} SELECT n AS bundle_id, {_flat_sql('sizes', _SIZES)}, {_flat_sql('dims', _DIMS)}, CASE WHEN n % 5 = 3 THEN 'bad value' END AS sizes_text, CASE WHEN n % 5 = 2 THEN '1,2' END AS dims_text FROM hn")
def parse_numeric_tuple(spark, d):
    fields = [("sizes", F.col("voxel_sizes"), "float"), ("dims", F.col("dimensions"), "int")]
    parsed = [h.parse_numeric_tuple(text, kind, 3).alias(name) for name, text, kind in fields]
    rows = t.headers(spark, d).select("bundle_id", *parsed, *[h.unparsed(text, kind, 3).alias(f"{name}_text") for name, text, kind in fields])
    return _flat(rows, "sizes", "dims")


def _counts(spark, d):
    return t.read(spark, d, "embeddings").groupBy(F.col("label").alias("bundle_id")).agg(F.count("*").alias("n"))


@plan(f"""WITH {_N}, c AS (SELECT label, count(*) AS m FROM embeddings GROUP BY label)
SELECT n AS bundle_id, coalesce(o, CASE WHEN n % 2 = 0 THEN 'PRS' ELSE 'RAS' END) AS voxel_order, {_flat_sql('voxel_sizes', f"coalesce({_SIZES}, [1.0::DOUBLE, 1, 1])")}, {_flat_sql('dimensions', f"coalesce({_DIMS}, [1, 1, 1])")},
CASE WHEN n % 2 = 0 THEN -4.0 ELSE 0.0 END::DOUBLE AS a10, coalesce(m, 0) AS nb_streamlines FROM hn LEFT JOIN c ON label = n""")
def normalise_headers_trk(spark, d):
    affine = F.array(*[F.lit(float(x)) for x in (0, 4, 0, 0, -4, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0, 1)])
    images = t.headers(spark, d).where("bundle_id % 2 = 0").select("bundle_id", affine.alias("affine"))
    out = _flat(h.normalise_trk(t.headers(spark, d), _counts(spark, d), images), "voxel_sizes", "dimensions")
    return out.withColumn("a10", F.get("voxel_to_rasmm", 4)).drop("voxel_to_rasmm")


@plan(f"""WITH {_N}, c AS (SELECT label, count(*) AS m FROM embeddings GROUP BY label)
SELECT n AS bundle_id, o AS voxel_order, CASE n % 5 WHEN 0 THEN '(' || (n + 1) || ', 2, 3)' WHEN 1 THEN '[1 ' || n || ' 3.5]' WHEN 2 THEN '1,' || n || ' 3' WHEN 3 THEN 'bad value' END AS voxel_sizes,
CASE n % 5 WHEN 0 THEN n || '.9 20 30' WHEN 1 THEN '[25, 25, 25]' WHEN 2 THEN '1,2' END AS dimensions, coalesce(m, 0)::VARCHAR AS "count" FROM hn LEFT JOIN c ON label = n""")
def normalise_headers_tck(spark, d):
    return h.normalise_tck(t.headers(spark, d), _counts(spark, d))


@plan(f"WITH {_N} SELECT n AS bundle_id, coalesce(o, 'RAS') AS voxel_order, {_flat_sql('voxel_sizes', _SIZES)}, {_flat_sql('dimensions', _DIMS)} FROM hn")
def normalise_headers_trx(spark, d):
    return _flat(h.normalise_trx(t.headers(spark, d)), "voxel_sizes", "dimensions")


@plan("SELECT s_suppkey AS volume_id, 'RAS' AS voxel_order FROM supplier")
def voxel_order_from_affine(spark, d):
    return _meta(spark, d).select("volume_id", h.voxel_order_from_affine(F.col("affine")).alias("voxel_order"))


def _labelled(spark, d):
    return spatial.label_endpoints(t.lines_e(spark, d), t.parcels(spark, d), t.GRID)


@plan("""WITH ed AS (SELECT least(label_a, label_b) AS a, greatest(label_a, label_b) AS b, count(*) AS n FROM lab WHERE label_a > 0 AND label_b > 0 GROUP BY 1, 2),
ax AS (SELECT label_a AS label FROM lab WHERE label_a > 0 UNION SELECT label_b FROM lab WHERE label_b > 0),
an AS (SELECT label, CASE WHEN p_partkey % 2 = 0 THEN 'Part, ' || p_partkey ELSE 'Region_' || label END AS name FROM ax LEFT JOIN part ON p_partkey = label)
SELECT p.label, p.name, q.name AS region, (SELECT count(*) FROM an) AS n_regions, coalesce(n, 0) AS n FROM an p CROSS JOIN an q LEFT JOIN ed ON a = least(p.label, q.label) AND b = greatest(p.label, q.label)""")
def export_connectivity_csv(spark, d):
    path, p = scratch(spark, "matrix"), F.col("p_partkey")
    names = t.read(spark, d, "part").where(p % 2 == 0).select(p.alias("label"), F.concat(F.lit("Part, "), p.cast("string")).alias("name"))
    export.export_connectivity_csv(aggregate.connectivity_matrix(_labelled(spark, d)), path, names)
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    cells = wide.unpivot(["name"], [f"`{c}`" for c in wide.columns if c != "name"], "region", "n").withColumn("n", F.col("n").cast("long"))
    return cells.join(spark.read.schema("label long, name string, n_regions long").json(f"{path}_labels"), "name")


@plan("SELECT i, j, k, 1 AS value FROM parc WHERE label = 63")
def export_region_mask(spark, d):
    return export.region_mask(t.parcels(spark, d), 63)


@plan("""WITH p AS (SELECT label AS roi_id, round(avg(i)*4 - 48, 6) AS gx, round(avg(j)*4 - 48, 6) AS gy, round(avg(k)*4 - 48, 6) AS gz, round((max(i) - min(i) + max(j) - min(j) + max(k) - min(k))/6.0::DOUBLE, 6) AS gr FROM parc WHERE label > 0 GROUP BY label),
q AS (SELECT * FROM shapes)
SELECT coalesce(p.roi_id, q.roi_id) AS roi_id, coalesce(cx, gx) AS cx, coalesce(cy, gy) AS cy, coalesce(cz, gz) AS cz, coalesce(r, gr) AS r FROM p FULL JOIN q ON p.roi_id = q.roi_id""")
def export_roi_summary(spark, d):
    rois = t.parcels(spark, d).where("label > 0").select(F.col("label").alias("roi_id"), "i", "j", "k", F.lit(1).alias("value"))
    out = export.roi_summary(rois, t.shapes(spark, d), t.GRID)
    return out.select("roi_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "r")])


_CELLS = "cl AS (SELECT a AS i, b AS j, c AS k, a*4.0::DOUBLE - 48 AS wx, b*4.0::DOUBLE - 48 AS wy, c*4.0::DOUBLE - 48 AS wz FROM range(25) t(a), range(25) u(b), range(25) v(c))"
_BALL = "(wx-cx)*(wx-cx) + (wy-cy)*(wy-cy) + (wz-cz)*(wz-cz) <= r*r"


@plan(f"WITH {_CELLS} SELECT roi_id, i, j, k FROM shapes, cl WHERE {_BALL}")
def rasterise_spheres(spark, d):
    return raster.rasterise_spheres(t.shapes(spark, d), t.GRID, t.DIMS)


@plan(f"""WITH {_CELLS}, q AS (SELECT roi_id, round_even((cx+48)/4, 0) AS a, round_even((cy+48)/4, 0) AS b, round_even((cz+48)/4, 0) AS c, r/4 AS vr FROM shapes)
SELECT roi_id, i, j, k FROM q, cl WHERE (i-a)*(i-a) + (j-b)*(j-b) + (k-c)*(k-c) <= vr*vr""")
def rasterise_spheres_cli(spark, d):
    return raster.rasterise_spheres_voxel(t.shapes(spark, d), t.GRID, t.DIMS)


def _boxes(spark, d):
    """Boxes in voxels about the suppliers' spheres; some are flat."""
    half = F.when(F.col("roi_id") % 3 == 0, 0.0).otherwise(F.col("r") / 4)
    at = {c: (F.col(f"c{a}") + 48) / 4 for a, c in zip(AXES, "ijk", strict=True)}
    return t.shapes(spark, d).select("roi_id", *[(v + (half if c == "k" else F.col("r") / 4)).alias(f"{c}0") for c, v in at.items()], *[(v - (half if c == "k" else F.col("r") / 4)).alias(f"{c}1") for c, v in at.items()])


@plan("""WITH b AS (SELECT roi_id, (cx+48)/4 AS x, (cy+48)/4 AS y, (cz+48)/4 AS z, r/4 AS q, CASE WHEN roi_id % 3 = 0 THEN 0 ELSE r/4 END AS h FROM shapes),
c AS (SELECT roi_id, greatest(0, trunc(x-q)::INT) AS i0, least(24, trunc(x+q)::INT) AS i1, greatest(0, trunc(y-q)::INT) AS j0, least(24, trunc(y+q)::INT) AS j1, greatest(0, trunc(z-h)::INT) AS k0, least(24, trunc(z+h)::INT) AS k1 FROM b),
f AS (SELECT * REPLACE (least(24, CASE WHEN k0 = k1 THEN k1 + 1 ELSE k1 END) AS k1) FROM c)
SELECT roi_id, i, j, k FROM f, range(25) t(i), range(25) u(j), range(25) v(k) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 AND k BETWEEN k0 AND k1""")
def rasterise_boxes(spark, d):
    return raster.rasterise_boxes(_boxes(spark, d), t.DIMS, "axial")


_STROKES = """sk AS (SELECT sid, pid, x/10 AS x, y, z%25 AS z FROM v),
sg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM sk WINDOW w AS (PARTITION BY sid ORDER BY pid)),
sn AS (SELECT *, ceil(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y) + (z2-z)*(z2-z))*10)::INT AS n FROM sg WHERE x2 IS NOT NULL),
ss AS (SELECT *, unnest(range(n + 1)) AS s FROM sn WHERE n BETWEEN 1 AND 100000),
sv AS (SELECT DISTINCT sid, round_even(CASE WHEN s = n THEN x2 ELSE x + s*((x2-x)/n) END, 0)::INT AS i, round_even(CASE WHEN s = n THEN y2 ELSE y + s*((y2-y)/n) END, 0)::INT AS j, round_even(CASE WHEN s = n THEN z2 ELSE z + s*((z2-z)/n) END, 0)::INT AS k FROM ss),
st AS (SELECT * FROM sv WHERE i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 24 AND k BETWEEN 0 AND 24)"""


@plan(f"WITH {_STROKES} SELECT sid, i, j, k FROM st")
def rasterise_strokes(spark, d):
    return raster.rasterise_strokes(t.strokes(spark, d), t.DIMS)


@plan("SELECT DISTINCT i + a AS i, j + b AS j, k FROM img, range(-1, 3) t(a), range(-1, 3) u(b) WHERE value > 5 AND i + a BETWEEN 0 AND 24 AND j + b BETWEEN 0 AND 24")
def expand_brush(spark, d):
    return raster.expand_brush(t.image(spark, d).where("value > 5").select("i", "j", "k"), t.DIMS, "axial", 4)


def _corners(spark, d):
    """A pentagram-like polygon in voxels for each supplier."""
    turn = F.col("pid") * (4 * math.pi / 5)
    s = t.shapes(spark, d).withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return s.select("roi_id", "pid", ((F.col("cx") + 48) / 4 + F.col("r") * F.cos(turn)).alias("x"), ((F.col("cy") + 48) / 4 + F.col("r") * F.sin(turn)).alias("y"), ((F.col("cz") + 48) / 4).alias("z"))


@plan("""WITH c AS (SELECT roi_id, p AS pid, (cx+48)/4 + r*cos(p*(4*pi()/5)) AS x, (cy+48)/4 + r*sin(p*(4*pi()/5)) AS y, (cz+48)/4 AS z FROM shapes, range(5) t(p)),
g AS (SELECT a.roi_id, a.x AS ui, a.y AS vi, b.x AS uj, b.y AS vj FROM c a JOIN c b ON a.roi_id = b.roi_id AND b.pid = (a.pid + 4) % 5),
bb AS (SELECT roi_id, round_even(avg(z), 0)::INT AS k, greatest(0, floor(min(x))::INT) AS a, least(24, ceil(max(x))::INT) AS b, greatest(0, floor(min(y))::INT) AS p, least(24, ceil(max(y))::INT) AS q FROM c GROUP BY roi_id),
cl AS (SELECT roi_id, i, j, k FROM bb, range(25) t(i), range(25) u(j) WHERE i BETWEEN a AND b AND j BETWEEN p AND q AND k BETWEEN 0 AND 24)
SELECT cl.roi_id, i, j, k FROM cl JOIN g ON g.roi_id = cl.roi_id GROUP BY ALL HAVING sum(((vi > j) <> (vj > j) AND i < (uj-ui)*(j-vi)/(vj-vi+1e-10::DOUBLE) + ui)::INT) % 2 = 1""")
def fill_polygon(spark, d):
    return raster.fill_polygon(_corners(spark, d), t.DIMS)


@plan(f"WITH {_STROKES} SELECT i, j, k, value FROM img WHERE (i, j, k) NOT IN (SELECT (i, j, k) FROM st)")
def erase_voxels(spark, d):
    return raster.erase_voxels(t.image(spark, d), raster.rasterise_strokes(t.strokes(spark, d), t.DIMS))


@plan(f"""WITH {_CELLS}, q AS (SELECT roi_id, cx + CASE WHEN roi_id % 2 = 0 THEN 4 ELSE 0 END AS cx, cy, cz, CASE WHEN roi_id % 2 = 0 THEN greatest(0.5, r - 4) ELSE r END AS r FROM shapes) SELECT roi_id, i, j, k FROM q, cl WHERE {_BALL}""")
def move_resize_shape(spark, d):
    shapes = t.shapes(spark, d)
    zero = F.lit(0.0)
    changes = shapes.where("roi_id % 2 = 0").select("roi_id", F.lit(4.0).alias("dx"), zero.alias("dy"), zero.alias("dz"), F.lit(-4.0).alias("dr"))
    return raster.rasterise_spheres(raster.move_resize(shapes, changes), t.GRID, t.DIMS)


@plan("""WITH b AS (SELECT *, CASE roi_id % 3 WHEN 0 THEN 'axial' WHEN 1 THEN 'coronal' ELSE 'sagittal' END AS view FROM shapes)
SELECT roi_id, CASE WHEN view = 'sagittal' THEN cx - r - 0.5 ELSE -(cx + r) END AS minx, cy - r - CASE WHEN view = 'coronal' THEN 0.5 ELSE 0 END AS miny, cz - r - CASE WHEN view = 'axial' THEN 0.5 ELSE 0 END AS minz,
CASE WHEN view = 'sagittal' THEN cx + r + 0.5 ELSE -(cx - r) END AS maxx, cy + r + CASE WHEN view = 'coronal' THEN 0.5 ELSE 0 END AS maxy, cz + r + CASE WHEN view = 'axial' THEN 0.5 ELSE 0 END AS maxz FROM b""")
def view_to_world_shape(spark, d):
    view = F.when(F.col("roi_id") % 3 == 0, "axial").when(F.col("roi_id") % 3 == 1, "coronal").otherwise("sagittal")
    s = t.shapes(spark, d)
    return raster.view_to_world_boxes(s.select("roi_id", view.alias("view"), *[(F.col(f"c{a}") + F.col("r")).alias(f"{a}0") for a in AXES], *[(F.col(f"c{a}") - F.col("r")).alias(f"{a}1") for a in AXES]))


@plan("""WITH c AS (SELECT s_suppkey AS roi_id, s_name AS name, 'img' AS volume_id, s_suppkey % 10 AS palette_index FROM supplier)
SELECT * FROM c UNION ALL SELECT max(roi_id) + 1, 'ROI_' || (count(*) + 1), 'img', count(*) % 10 FROM c""")
def new_roi_like(spark, d):
    catalog = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("roi_id"), F.col("s_name").alias("name"), F.lit("img").alias("volume_id"), (F.col("s_suppkey") % 10).alias("palette_index"))
    return raster.new_roi_like(catalog, "img")
