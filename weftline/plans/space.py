"""Queries of spatial selection, set logic, aggregation and statistics (J, F, A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.affine import AXES
from ..operators import aggregate, filters, geometry, layout, spatial, stats
from ..sources import tables as t
from .base import Plans

plan = Plans()
BALL = (5.0, -3.0, 4.0)


def _nested(spark, d):
    return layout.to_nested(t.lines_e(spark, d))


def _labelled(spark, d):
    return spatial.label_endpoints(t.lines_e(spark, d), t.parcels(spark, d), t.GRID)


def _hits(spark, d, *ids):
    """Hits of all shapes, or of those of ``ids`` only: no other shape is tested."""
    shapes = t.shapes(spark, d)
    return spatial.sphere_hits(_nested(spark, d), shapes.where(F.col("roi_id").isin(*ids)) if ids else shapes)


def _hits_with_mode(spark, d, modes):
    """Hits of the shapes that have a mode: others take no part in a filter."""
    return spatial.sphere_hits(_nested(spark, d), t.shapes(spark, d).join(modes.select("roi_id"), "roi_id", "left_semi"))


def _sids(spark, d):
    return t.read(spark, d, "embeddings").select(F.col("vec_id").alias("sid"))


_SEG = "(SELECT e.*, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM e WINDOW w AS (PARTITION BY sid ORDER BY pid))"


@plan("SELECT sid FROM e GROUP BY sid HAVING max(x) >= 10 AND min(x) <= 20 AND max(y) >= -40 AND min(y) <= -20 AND max(z) >= 0 AND min(z) <= 30")
def bbox_overlap(spark, d):
    return spatial.bbox_overlap(_nested(spark, d), (10, -40, 0), (20, -20, 30)).select("sid")


@plan("""WITH b AS (SELECT sid, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz FROM l GROUP BY sid)
SELECT roi_id, sid FROM b JOIN shapes ON maxx >= cx - r AND minx <= cx + r AND maxy >= cy - r AND miny <= cy + r AND maxz >= cz - r AND minz <= cz + r""")
def bbox_range_join(spark, d):
    s = t.shapes(spark, d)
    boxes = s.select("roi_id", *[(F.col(f"c{a}") - F.col("r")).alias(f"low{a}") for a in AXES], *[(F.col(f"c{a}") + F.col("r")).alias(f"high{a}") for a in AXES])
    return spatial.range_join(layout.streamline_bbox(t.lines_l(spark, d)), boxes, ["roi_id", "sid"])


@plan(f"""WITH q AS (SELECT 5.0::DOUBLE AS cx, -3.0::DOUBLE AS cy, 4.0::DOUBLE AS cz, 6.0::DOUBLE AS r)
SELECT DISTINCT sid FROM {_SEG} g, q WHERE (x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz) < r*r OR (x2 IS NOT NULL AND (x2-x)*(x2-x) + (y2-y)*(y2-y) + (z2-z)*(z2-z) > 0 AND ({t.SEGMENT}) < r*r)""")
def select_in_sphere(spark, d):
    return spatial.select_in_sphere(_nested(spark, d), BALL, 6.0)


@plan("SELECT roi_id, sid FROM hits")
def sphere_hits(spark, d):
    return _hits(spark, d)


@plan("SELECT DISTINCT sid FROM l WHERE x BETWEEN -5 AND 5 AND y BETWEEN 0 AND 10 AND z BETWEEN -10 AND 0")
def select_in_box(spark, d):
    return spatial.select_in_box(layout.to_nested(t.lines_l(spark, d)), (-5, 0, -10), (5, 10, 0))


@plan("SELECT DISTINCT sid FROM ev JOIN (SELECT i, j, k FROM img WHERE value > 5) m ON ev.i = m.i AND ev.j = m.j AND ev.k = m.k")
def roi_intersection(spark, d):
    return spatial.roi_intersection(t.lines_e(spark, d), t.image(spark, d).withColumn("value", F.col("value") - 5), t.GRID, t.DIMS)


@plan("SELECT roi_id, sid FROM hits")
def update_shape_hits(spark, d):
    old = spatial.sphere_hits(_nested(spark, d), t.shapes(spark, d).withColumn("r", F.when(F.col("roi_id") == 3, F.lit(1.0)).otherwise(F.col("r"))))
    return spatial.update_shape_hits(old, _nested(spark, d), t.shapes(spark, d).where("roi_id = 3"))


@plan("SELECT sid, label_a, label_b FROM lab")
def label_endpoints(spark, d):
    return _labelled(spark, d)


@plan("SELECT sid FROM lab WHERE label_a = 63 OR label_b = 63")
def region_hits(spark, d):
    return spatial.region_hits(_labelled(spark, d), 63)


@plan("SELECT sid FROM hits WHERE roi_id = 2 AND sid % 2 = 0")
def visible_candidates(spark, d):
    return spatial.visible_candidates(_hits(spark, d, 2).select("sid"), _sids(spark, d).where("sid % 2 = 0"))


@plan("SELECT sid, label_a, label_b FROM lab WHERE sid % 2 = 0")
def stale_region_refresh(spark, d):
    return _refreshed(spark, d)[0]


def _refreshed(spark, d):
    """The refresh with lines of even ids visible and, beside the regions' own modes, one region excluded."""
    kinds = t.modes(spark, d).select(F.lit("shape").alias("kind"), "roi_id", "mode", "seq")
    region = kinds.limit(1).select(F.lit("region").alias("kind"), F.lit(63).alias("roi_id"), F.lit("exclude").alias("mode"), "seq")
    return spatial.stale_region_refresh(t.lines_e(spark, d), _sids(spark, d).where("sid % 2 = 0"), t.parcels(spark, d), t.GRID, kinds.unionByName(region))


@plan("""SELECT vec_id AS sid FROM embeddings WHERE vec_id IN (SELECT sid FROM hits WHERE roi_id = 2) AND vec_id IN (SELECT sid FROM hits WHERE roi_id = 8)
AND vec_id NOT IN (SELECT sid FROM hits WHERE roi_id = 1)""")
def stale_region_filters(spark, d):
    """Lines that the filters leave after a refresh: those of shapes hold, those of regions are reset."""
    labels, modes = _refreshed(spark, d)
    regions = labels.select(F.explode(F.array_distinct(F.array("label_a", "label_b"))).alias("label"), "sid")
    shapes = filters.set_logic_mode(modes.where("kind = 'shape'").drop("kind"))
    region_modes = filters.set_logic_mode(modes.where("kind = 'region'").drop("kind")).select(F.col("roi_id").alias("label"), "mode")
    return filters.apply_logic_filters(_sids(spark, d), _hits_with_mode(spark, d, shapes), shapes, regions, region_modes)


@plan("""SELECT vec_id AS sid FROM embeddings WHERE vec_id IN (SELECT sid FROM hits WHERE roi_id = 2) AND vec_id IN (SELECT sid FROM hits WHERE roi_id = 8)
AND vec_id NOT IN (SELECT sid FROM hits WHERE roi_id = 1) AND vec_id NOT IN (SELECT sid FROM lab WHERE label_a = 63 OR label_b = 63)""")
def apply_logic_filters(spark, d):
    ends = _labelled(spark, d)
    regions = ends.select(F.explode(F.array_distinct(F.array("label_a", "label_b"))).alias("label"), "sid")
    excluded = t.names(spark, d).limit(1).select(F.lit(63).alias("label"), F.lit("exclude").alias("mode"))
    modes = filters.set_logic_mode(t.modes(spark, d))
    return filters.apply_logic_filters(_sids(spark, d), _hits_with_mode(spark, d, modes), modes, regions, excluded)


@plan("SELECT roi_id, mode FROM modes WHERE mode <> 'none'")
def set_logic_mode(spark, d):
    return filters.set_logic_mode(t.modes(spark, d))


@plan("SELECT DISTINCT sid FROM hits WHERE roi_id = 3")
def roi_highlight(spark, d):
    modes = filters.set_logic_mode(t.modes(spark, d)).where("mode = 'select'")
    return filters.roi_highlight(_hits_with_mode(spark, d, modes), modes)


@plan("SELECT sid FROM hits WHERE roi_id = 2 UNION SELECT sid FROM hits WHERE roi_id = 3")
def selection_add(spark, d):
    return filters.selection_add(_hits(spark, d, 2), _hits(spark, d, 3))


@plan("SELECT sid FROM hits WHERE roi_id = 2 EXCEPT SELECT sid FROM hits WHERE roi_id = 3")
def selection_remove(spark, d):
    return filters.selection_remove(_hits(spark, d, 2), _hits(spark, d, 3))


@plan("SELECT vec_id AS sid FROM embeddings EXCEPT SELECT sid FROM hits WHERE roi_id = 2")
def selection_invert(spark, d):
    return filters.selection_invert(_sids(spark, d), _hits(spark, d, 2))


@plan("SELECT vec_id AS sid FROM embeddings WHERE vec_id NOT IN (SELECT sid FROM hits WHERE roi_id = 8)")
def delete_selected(spark, d):
    return filters.delete_selected(_sids(spark, d), _hits(spark, d, 8))


@plan("SELECT roi_id, CASE WHEN s_name = 'Supplier#000000003' THEN 'third' ELSE s_name END AS name FROM (SELECT s_suppkey AS roi_id, s_name FROM supplier) WHERE roi_id <> 5")
def roi_catalog_ops(spark, d):
    catalog = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("roi_id"), F.col("s_name").alias("name"))
    return filters.remove_roi(filters.rename_roi(catalog, "Supplier#000000003", "third"), 5)


@plan("SELECT i, j, k, value::BIGINT AS n FROM img")
def density_map(spark, d):
    return aggregate.density_map(t.points_l(spark, d), t.GRID, t.DIMS)


@plan("""SELECT min(x) - 5 AS origin_x, min(y) - 5 AS origin_y, min(z) - 5 AS origin_z, ceil((max(x) + 5) - (min(x) - 5))::INT AS nx, ceil((max(y) + 5) - (min(y) - 5))::INT AS ny, ceil((max(z) + 5) - (min(z) - 5))::INT AS nz FROM e""")
def density_grid(spark, d):
    return aggregate.grid_of_bounds(t.lines_e(spark, d))


@plan("SELECT count(*) AS voxels, sum(n)::BIGINT AS points, max(n) AS most FROM (SELECT count(*) AS n FROM ev GROUP BY i, j, k)")
def density_summary(spark, d):
    return aggregate.density_summary(aggregate.density_map(t.lines_e(spark, d), t.GRID, t.DIMS))


_EDGES = """SELECT label_a, label_b, count(*) AS n FROM (SELECT label_a, label_b FROM lab WHERE label_a > 0 AND label_b > 0
UNION ALL SELECT label_b, label_a FROM lab WHERE label_a > 0 AND label_b > 0 AND label_a <> label_b) GROUP BY label_a, label_b"""
_AXIS = "SELECT label_a AS label FROM lab WHERE label_a > 0 UNION SELECT label_b FROM lab WHERE label_b > 0"


@plan(_EDGES)
def connectivity_edges(spark, d):
    return aggregate.connectivity_edges(_labelled(spark, d))


@plan(f"""WITH ed AS ({_EDGES}), ax AS ({_AXIS})
SELECT p.label AS label_a, q.label AS label_b, coalesce(n, 0) AS n, coalesce(u.name, 'Region_' || p.label) AS name_a, coalesce(w.name, 'Region_' || q.label) AS name_b
FROM ax p CROSS JOIN ax q LEFT JOIN ed ON ed.label_a = p.label AND ed.label_b = q.label LEFT JOIN lut u ON u.label = p.label LEFT JOIN lut w ON w.label = q.label""")
def connectivity_matrix(spark, d):
    return aggregate.connectivity_matrix(_labelled(spark, d), t.names(spark, d))


@plan(f"WITH ed AS ({_EDGES}), ax AS ({_AXIS}) SELECT label, coalesce(sum(n), 0)::BIGINT AS degree FROM ax LEFT JOIN ed ON label_a = label GROUP BY label")
def region_degree(spark, d):
    return aggregate.region_degree(_labelled(spark, d))


@plan(_AXIS)
def connected_labels(spark, d):
    return aggregate.connected_labels(_labelled(spark, d))


_D = "avg(sqrt(power(p.x-m.x, 2) + power(p.y-m.y, 2) + power(p.z-m.z, 2)))"


@plan(f"""WITH m AS (SELECT * FROM res WHERE sid = (SELECT min(sid) FROM res)),
dd AS (SELECT p.sid, {_D} AS d FROM res p JOIN m ON p.k = m.k GROUP BY p.sid), tt AS (SELECT p.sid, {_D} AS d FROM res p JOIN m ON 11 - p.k = m.k GROUP BY p.sid),
f AS (SELECT res.sid, CASE WHEN tt.d < dd.d THEN 11 - k ELSE k END AS k, x, y, z FROM res JOIN dd ON dd.sid = res.sid JOIN tt ON tt.sid = res.sid)
SELECT k, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM f GROUP BY k""")
def centroid(spark, d):
    return stats.centroid(geometry.resample(t.lines_e(spark, d), 12)).select("k", *[F.round(a, 6).alias(a) for a in AXES])


_PAIR = """pr AS (SELECT p.sid AS a, m.sid AS b, least(avg(sqrt(power(p.x-m.x, 2) + power(p.y-m.y, 2) + power(p.z-m.z, 2))), avg(sqrt(power(p.x-t.x, 2) + power(p.y-t.y, 2) + power(p.z-t.z, 2)))) AS mdf
FROM res p JOIN res m ON p.k = m.k {on} JOIN res t ON t.sid = m.sid AND t.k = 11 - p.k GROUP BY p.sid, m.sid)"""


def _lines(spark, d):
    return stats.as_arrays(geometry.resample(t.lines_e(spark, d), 12))


@plan(f"WITH {_PAIR.format(on='AND p.sid < m.sid')} SELECT a, b, round(mdf, 6) AS mdf FROM pr WHERE mdf < 14")
def mdf_pairs(spark, d):
    return stats.mdf_pairs(_lines(spark, d), 14.0).withColumn("mdf", F.round("mdf", 6))


_SAMPLE = "sm AS (SELECT vec_id AS sid FROM embeddings ORDER BY (vec_id*2654435761 + 42) % 4294967296, vec_id LIMIT 40)"


@plan(f"WITH {_SAMPLE}, {_PAIR.format(on='AND m.sid IN (SELECT sid FROM sm)')} SELECT a AS sid, b AS sample, CASE WHEN a = b THEN 0 ELSE round(mdf, 6) END AS mdf FROM pr")
def mdf_to_samples(spark, d):
    lines = _lines(spark, d)
    return stats.mdf_to_samples(lines, stats.hash_sample(lines, 40)).withColumn("mdf", F.round("mdf", 6))


@plan(f"WITH {_PAIR.format(on='')} SELECT a AS sid, round(sum(CASE WHEN a = b THEN 0 ELSE mdf END), 6) AS total FROM pr GROUP BY a ORDER BY total, sid LIMIT 1")
def medoid_exact(spark, d):
    return stats.medoid_exact(_lines(spark, d))


@plan(f"WITH {_SAMPLE}, {_PAIR.format(on='AND m.sid IN (SELECT sid FROM sm)')} SELECT a AS sid, round(sum(CASE WHEN a = b THEN 0 ELSE mdf END), 6) AS total FROM pr GROUP BY a ORDER BY total, sid LIMIT 1")
def medoid_sampled(spark, d):
    return stats.medoid_sampled(_lines(spark, d), 40)


_MASK = """st AS (SELECT * FROM (VALUES (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) t(di, dj, dk)),
mk AS (SELECT DISTINCT i + di AS i, j + dj AS j, k + dk AS k FROM ev, st WHERE i + di BETWEEN 0 AND 24 AND j + dj BETWEEN 0 AND 24 AND k + dk BETWEEN 0 AND 24)"""


@plan(f"WITH {_MASK} SELECT i, j, k FROM mk")
def tunnel_mask(spark, d):
    return aggregate.tunnel_mask(t.lines_e(spark, d), t.GRID, t.DIMS)


@plan(f"WITH {_MASK} SELECT min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j, min(k) AS min_k, max(k) AS max_k FROM mk")
def mask_extent(spark, d):
    return aggregate.mask_extent(aggregate.tunnel_mask(t.lines_e(spark, d), t.GRID, t.DIMS))


@plan("""WITH n AS (SELECT p_size AS n, (sqrt(8*p_size + 1) - 3)/2 AS o, count(*) AS parts FROM part GROUP BY p_size) SELECT n, parts, CASE WHEN o = floor(o) THEN o::INT END AS sh_order FROM n""")
def sh_order(spark, d):
    sizes = t.read(spark, d, "part").groupBy(F.col("p_size").alias("n")).agg(F.count("*").alias("parts"))
    return aggregate.sh_order(sizes)


def _vertices(spark, d):
    """Directions from the suppliers' spheres."""
    return t.shapes(spark, d).where("cx <> 0 OR cy <> 0 OR cz <> 0").select(F.col("roi_id").alias("vertex"), *[F.col(f"c{a}").alias(a) for a in AXES])


_BASIS = """vx AS (SELECT roi_id AS vertex, cx/sqrt(cx*cx+cy*cy+cz*cz) AS x, cy/sqrt(cx*cx+cy*cy+cz*cz) AS y, cz/sqrt(cx*cx+cy*cy+cz*cz) AS z FROM shapes WHERE cx <> 0 OR cy <> 0 OR cz <> 0),
b AS (SELECT vertex, unnest([sqrt(1/(4*pi())), -sqrt(15/(4*pi()))*x*y, -sqrt(15/(4*pi()))*y*z, sqrt(5/(16*pi()))*(3*z*z - 1), -sqrt(15/(4*pi()))*x*z, sqrt(15/(16*pi()))*(x*x - y*y),
-0.75::DOUBLE*sqrt(35/pi())*x*y*(x*x - y*y), -0.75::DOUBLE*sqrt(35/(2*pi()))*y*z*(3*x*x - y*y), -0.75::DOUBLE*sqrt(5/pi())*x*y*(7*z*z - 1), -0.75::DOUBLE*sqrt(5/(2*pi()))*y*z*(7*z*z - 3),
3/16.0::DOUBLE*sqrt(1/pi())*(35*z*z*z*z - 30*z*z + 3),
-0.75::DOUBLE*sqrt(5/(2*pi()))*x*z*(7*z*z - 3), 0.375::DOUBLE*sqrt(5/pi())*(x*x - y*y)*(7*z*z - 1), -0.75::DOUBLE*sqrt(35/(2*pi()))*x*z*(x*x - 3*y*y), 3/16.0::DOUBLE*sqrt(35/pi())*(x*x*(x*x - 3*y*y) - y*y*(3*x*x - y*y))]) AS b, unnest(range(15))::INT AS idx FROM vx)"""


@plan(f"WITH {_BASIS} SELECT vertex, idx, CASE WHEN abs(b) < 1e-9 THEN 0 ELSE round(b, 6) END::DOUBLE AS b FROM b")
def sh_basis(spark, d):
    return aggregate.sh_basis(_vertices(spark, d), 4).withColumn("b", F.when(F.abs("b") < 1e-9, 0.0).otherwise(F.round("b", 6)))


@plan(f"""WITH {_BASIS}, m AS (SELECT DISTINCT i, j, k FROM ev)
SELECT i, j, k, vertex, round(sum(coeffs[idx + 1] * b), 6) AS amplitude FROM coef JOIN m USING (i, j, k), b GROUP BY i, j, k, vertex""")
def masked_odf_amplitudes(spark, d):
    mask = aggregate.tunnel_mask(t.lines_e(spark, d), t.GRID, t.DIMS, 0)
    out = aggregate.masked_odf_amplitudes(t.coefficients(spark, d), mask, aggregate.sh_basis(_vertices(spark, d), 4))
    return out.withColumn("amplitude", F.round("amplitude", 6))
