"""Hand-computed cases: rounding, edges of shapes, undo and redo, bases."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import affine
from weftline.operators import aggregate, edits, export, filters, geometry, headers, layout, raster, sampling, spatial, stats, volume

POINTS = "sid long, pid int, x double, y double, z double"
LINES = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 1.0, 1.0), (0, 2, 2.0, 2.0, 2.0), (1, 0, 5.0, 5.0, 5.0), (1, 1, 6.0, 6.0, 6.0), (2, 0, 10.0, 0.0, 0.0), (2, 1, 10.0, 1.0, 0.0), (2, 2, 10.0, 2.0, 0.0), (2, 3, 10.0, 3.0, 0.0)]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(LINES, POINTS)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def ids(df):
    return sorted(r.sid for r in df.collect())


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0, 0, 0.5, 1.5, 2.5)], POINTS)
    assert got(geometry.nearest_voxel(df, affine.IDENTITY, (9, 9, 9)), "i", "j", "k") == [(0, 2, 2)]


def test_scaled_affine(spark):
    df = spark.createDataFrame([(0, 0, 4.0, 4.0, 4.0)], POINTS)
    assert got(geometry.nearest_voxel(df, affine.diagonal((2, 2, 2), (0, 0, 0)), (9, 9, 9)), "i", "j", "k") == [(2, 2, 2)]
    with pytest.raises(ValueError):
        affine.inverse([0.0] * 16)


def test_boxes_and_layouts(lines):
    nested = layout.to_nested(lines)
    assert got(nested, "sid", "n_points", "minx", "maxy") == [(0, 3, 0.0, 2.0), (1, 2, 5.0, 6.0), (2, 4, 10.0, 3.0)]
    assert got(layout.to_long(nested), "sid", "pid", "x", "y", "z") == sorted(LINES)
    flat, rows = layout.to_csr(lines)
    assert got(rows, "sid", "start", "n_points") == [(0, 0, 3), (1, 3, 2), (2, 5, 4)]
    assert got(flat, "point_id", "x") == [(k, x) for k, x in enumerate([0.0, 1.0, 2.0, 5.0, 6.0, 10.0, 10.0, 10.0, 10.0])]


@pytest.mark.parametrize(
    "line, n, expected",
    [
        ([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0)], 11, [(float(k), 0.0, 0.0) for k in range(11)]),
        ([(0.0, 0.0, 0.0), (3.0, 4.0, 0.0)], 6, [(0.6 * k, 0.8 * k, 0.0) for k in range(6)]),
        ([(1.0, 2.0, 3.0)], 4, [(1.0, 2.0, 3.0)] * 4),
        ([(1.0, 2.0, 3.0)] * 3, 3, [(1.0, 2.0, 3.0)] * 3),
        ([(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 0.0, 0.0)], 3, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]),
    ],
)
def test_resample(spark, line, n, expected):
    df = spark.createDataFrame([(7, k, *p) for k, p in enumerate(line)], POINTS)
    out = got(geometry.resample(df, n), "k", "x", "y", "z")
    assert [r[0] for r in out] == list(range(n))
    assert all(math.isclose(a, b, abs_tol=1e-9) for r, e in zip(out, expected, strict=True) for a, b in zip(r[1:], e, strict=True))


def test_resampled_arc_is_even(spark):
    arc = [(0, k, math.cos(k / 999 * math.pi / 2), math.sin(k / 999 * math.pi / 2), 0.0) for k in range(1000)]
    out = got(geometry.resample(spark.createDataFrame(arc, POINTS), 100), "k", "x", "y")
    steps = [math.dist(a[1:], b[1:]) for a, b in zip(out, out[1:], strict=False)]
    mean = sum(steps) / 99
    assert math.sqrt(sum((s - mean) ** 2 for s in steps) / 99) / mean < 0.02


def test_sphere_is_open_and_sees_segments(spark):
    df = layout.to_nested(spark.createDataFrame([(0, 0, -5.0, 1.0, 0.0), (0, 1, 5.0, 1.0, 0.0), (1, 0, 2.0, 0.0, 0.0), (1, 1, 9.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)], POINTS))
    assert ids(spatial.select_in_sphere(df, (0, 0, 0), 2.0)) == [0, 2]  # line 1 touches the surface only
    assert ids(spatial.select_in_sphere(df, (2, 0, 0), 0.1)) == [1]  # the radius is raised to 0.5


def test_box_sees_vertices_only(spark):
    df = layout.to_nested(spark.createDataFrame([(0, 0, -5.0, 0.0, 0.0), (0, 1, 5.0, 0.0, 0.0), (1, 0, 1.0, 1.0, 1.0)], POINTS))
    assert ids(spatial.select_in_box(df, (-1, -1, -1), (1, 1, 1))) == [1]


def test_range_join_is_all_pairs_that_meet(spark):
    import random

    random.seed(3)
    rows = lambda n: [(k, *(lo := [random.uniform(-60, 60) for _ in range(3)]), *(v + random.uniform(0, 50) for v in lo)) for k in range(n)]
    a, b = rows(60), rows(60)
    lines = spark.createDataFrame(a, "sid long, minx double, miny double, minz double, maxx double, maxy double, maxz double")
    boxes = spark.createDataFrame(b, "roi_id long, lowx double, lowy double, lowz double, highx double, highy double, highz double")
    meet = sorted((q[0], p[0]) for p in a for q in b if all(p[4 + k] >= q[1 + k] and p[1 + k] <= q[4 + k] for k in range(3)))
    assert got(spatial.range_join(lines, boxes), "roi_id", "sid") == meet


def test_filters(spark):
    sets = lambda name, rows: spark.createDataFrame(rows, name)
    manual = sets("sid long", [(i,) for i in range(10)])
    hits = sets("roi_id long, sid long", [(1, i) for i in range(6)] + [(2, 4), (2, 5)])
    modes = sets("roi_id long, mode string", [(1, "include"), (2, "exclude")])
    assert ids(filters.apply_logic_filters(manual, hits, modes)) == [0, 1, 2, 3]
    two = sets("roi_id long, sid long", [(1, i) for i in range(4)] + [(2, i) for i in range(2, 6)])
    assert ids(filters.apply_logic_filters(manual, two, sets("roi_id long, mode string", [(1, "include"), (2, "include")]))) == [2, 3]
    assert ids(filters.apply_logic_filters(manual, two, sets("roi_id long, mode string", [(9, "include")]))) == []
    assert ids(filters.apply_logic_filters(manual, two, sets("roi_id long, mode string", [(1, "select")]))) == list(range(10))


def test_connectivity_is_symmetric(spark):
    labelled = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 3, 3), (3, 4, 0)], "sid long, label_a int, label_b int")
    assert got(aggregate.connectivity_edges(labelled), "label_a", "label_b", "n") == [(1, 2, 2), (2, 1, 2), (3, 3, 1)]
    assert got(aggregate.region_degree(labelled), "label", "degree") == [(1, 2), (2, 2), (3, 1), (4, 0)]
    assert aggregate.connectivity_matrix(labelled).count() == 16


def test_density_counts_points_inside(lines):
    d = aggregate.density_map(lines, affine.IDENTITY, (8, 8, 8))
    assert d.agg(F.sum("n")).first()[0] == 5


def test_medoid_and_centroid_ignore_direction(spark):
    rows = [(s, k, float(k), float(s), 0.0) for s in range(5) for k in range(4)]
    turned = [(s, 3 - k if s == 3 else k, x, y, z) for s, k, x, y, z in rows]
    for data in (rows, turned):
        r = spark.createDataFrame(data, "sid long, k int, x double, y double, z double")
        assert stats.medoid_exact(stats.as_arrays(r)).first().sid == 2
        assert got(stats.centroid(r), "k", "x", "y") == [(k, float(k), 2.0) for k in range(4)]


def test_sh_basis_golden(spark):
    s = 1 / math.sqrt(3)
    v = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0), (2, s, s, s)], "vertex long, x double, y double, z double")
    b = {(r.vertex, r.idx): r.b for r in aggregate.sh_basis(v, 4).collect()}
    assert len(b) == 45
    # fixed values: the basis at +z, at +x and on the diagonal
    expected = {
        (0, 0): 0.28209479177387814, (0, 3): 0.63078313050504, (0, 10): 0.8462843753216345, (1, 3): -0.31539156525252, (1, 5): 0.5462742152960396,
        (1, 10): 0.3173566407456129, (1, 12): -0.47308734787878, (1, 14): 0.6258357354491761, (2, 1): -0.36418281019735976, (2, 2): -0.3641828101973598,
        (2, 4): -0.3641828101973598, (2, 7): -0.3933623932844291, (2, 8): -0.42052208700336025, (2, 9): 0.1486770096793974, (2, 13): 0.3933623932844291,
        (2, 14): -0.27814921575518947, (2, 12): 0.0, (0, 5): 0.0,
    }
    assert all(abs(b[k] - e) < 1e-10 for k, e in expected.items())


def test_sh_order(spark):
    assert got(aggregate.sh_order(spark.createDataFrame([(1,), (6,), (15,), (7,)], "n int")).fillna(-1), "n", "sh_order") == [(1, 0), (6, 2), (7, -1), (15, 4)]


def test_tunnel_mask(spark):
    one = spark.createDataFrame([(0, 0, 10.0, 10.0, 10.0)], POINTS)
    assert aggregate.tunnel_mask(one, affine.IDENTITY, (20, 20, 20), 0).count() == 1
    assert aggregate.tunnel_mask(one, affine.IDENTITY, (20, 20, 20), 1).count() == 7
    assert aggregate.tunnel_mask(one, affine.IDENTITY, (5, 5, 5), 0).count() == 0


def test_polygon(spark):
    square = [(1, 0, 2.0, 2.0, 5.0), (1, 1, 7.0, 2.0, 5.0), (1, 2, 7.0, 7.0, 5.0), (1, 3, 2.0, 7.0, 5.0)]
    filled = set(got(raster.fill_polygon(spark.createDataFrame(square, "roi_id long, pid int, x double, y double, z double"), (10, 10, 10)), "i", "j", "k"))
    assert {(5, 5, 5), (2, 2, 5)} <= filled and (8, 8, 5) not in filled


def test_anisotropic_sphere(spark):
    ball = spark.createDataFrame([(0, 5.0, 7.5, 20.0, 2.0)], "roi_id long, cx double, cy double, cz double, r double")
    hit = set(got(raster.rasterise_spheres(ball, affine.diagonal((0.5, 0.75, 2.0), (0, 0, 0)), (25, 25, 25)), "i", "j", "k"))
    assert {(6, 10, 10), (14, 10, 10), (10, 10, 9), (10, 10, 11)} <= hit
    assert not {(10, 10, 8), (10, 10, 12)} & hit


def test_brush_is_lopsided_when_even(spark):
    one = spark.createDataFrame([(5, 5, 5)], "i int, j int, k int")
    assert got(raster.expand_brush(one, (9, 9, 9), "axial", 2), "i", "j", "k") == [(i, j, 5) for i in (5, 6) for j in (5, 6)]


def test_numbers_from_text(spark):
    rows = [("(1, 2, 3)", "int", [1, 2, 3]), ("[1 2 3]", "int", [1, 2, 3]), ("1,2 3", "int", [1, 2, 3]), ("1.9 2 3", "int", [1, 2, 3]), ("", "int", None), ("1 2", "int", None), ("a b c", "float", None)]
    for text, kind, expected in rows:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(headers.parse_numeric_tuple(F.col("t"), kind, 3)).first()[0] == expected


def test_undo_keeps_twenty(spark):
    s = edits.Session()
    for k in range(25):
        s.apply("add", k)
        s.apply("delete")
    assert len(s.undo) == 20
    for _ in range(30):
        s.apply("undo")
    assert s.deleted == (False, frozenset(range(5)))
    for _ in range(30):
        s.apply("redo")
    assert s.deleted == (False, frozenset(range(25)))
    s.apply("undo")
    s.apply("add", 99)
    s.apply("delete")
    assert not s.redo


def test_one_stack_for_deletions_and_regions():
    s = edits.History()
    s.apply("modify", None, 1, 10)
    s.apply("add", 5)
    s.apply("delete")
    s.apply("modify", None, 1, 11)
    assert s.end() == [(False, 5, None, None), (None, None, 1, 11)]
    s.apply("undo")
    assert s.end() == [(False, 5, None, None), (None, None, 1, 10)]
    s.apply("undo")
    assert s.end() == [(None, None, 1, 10)]
    s.apply("undo")
    assert s.end() == []
    for _ in range(3):
        s.apply("redo")
    assert s.end() == [(False, 5, None, None), (None, None, 1, 11)]
    s.apply("undo")
    s.apply("add", 6)
    s.apply("delete")
    assert not s.redo and s.end() == [(False, 5, None, None), (False, 6, None, None), (None, None, 1, 10)]


def test_selection_after_inversion():
    s = edits.Session()
    s.apply("add", 1)
    s.apply("invert")
    s.apply("add", 1)
    s.apply("remove", 2)
    assert s.selected == (True, {2}) and s.keeper is None


def test_export_of_lines_left_with_one_point(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 2.0, 0.0, 0.0), (2, 0, 1.0, 1.0, 1.0)], POINTS)
    sample = sampling.export_sample(df, 10)
    assert got(sample, "sid", "pid", "r", "g", "b") == [(0, 0, 200, 200, 200), (1, 0, 255, 0, 0), (1, 2, 255, 0, 0)]
    assert got(sampling.sample_counts(df, sample), "num_streamlines", "total_streamlines") == [(2, 3)]


def test_small_grids_are_not_downsampled(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0)], "i int, j int, k int, value double")
    assert volume.downsample(df, affine.IDENTITY, (9, 9, 9)) == (df, affine.IDENTITY, (9, 9, 9))
    assert volume.shifted_affine(affine.diagonal((2, 2, 2), (1, 1, 1)), (1, 2, 3))[3::4] == (3.0, 5.0, 7.0, 1.0)


def test_inversion_toggles(spark):
    s = edits.Session()
    s.apply("add", 1)
    s.apply("invert")
    assert s.selected == (True, frozenset({1}))
    s.apply("invert")
    assert s.selected == (False, frozenset({1}))
    s.apply("invert")
    s.apply("delete")
    assert s.deleted == (True, frozenset({1}))
    s.apply("undo")
    assert s.deleted == edits.NONE


def test_set_algebra():
    universe = frozenset(range(6))
    real = lambda a: universe - a[1] if a[0] else a[1]
    some = [(n, frozenset(x)) for n in (False, True) for x in ((), (1,), (1, 2), (2, 3, 4))]
    for a in some:
        for b in some:
            assert real(edits.union(a, b)) == real(a) | real(b)
            assert real(edits.without(a, b)) == real(a) - real(b)


def test_rank_and_samples(spark):
    ids_ = spark.createDataFrame([(i * i,) for i in range(100)], "sid long")
    assert got(sampling.global_rank(ids_), "sid", "rank") == [(i * i, i) for i in range(100)]
    assert ids(sampling.linspace_sample(ids_, 4)) == [0, 33 * 33, 66 * 66, 99 * 99]
    assert sampling.linspace_sample(ids_, 1000).count() == 100
    assert sampling.global_rank(ids_.limit(0)).count() == 0


def test_empty_lines(spark):
    none = spark.createDataFrame([], POINTS)
    assert layout.to_nested(none).count() == 0
    assert geometry.resample(none, 5).count() == 0
    assert aggregate.density_map(none, affine.IDENTITY, (4, 4, 4)).count() == 0


def test_mask_of_no_voxel_is_an_error(spark):
    with pytest.raises(ValueError):
        export.region_mask(spark.createDataFrame([(0, 0, 0, 1)], "i int, j int, k int, label int"), 5)


def test_smoothing_keeps_the_sum_away_from_edges(spark):
    one = spark.createDataFrame([(8, 8, 8, 1.0)], "i int, j int, k int, value double")
    assert math.isclose(volume.gaussian_smooth(one, (17, 17, 17)).agg(F.sum("value")).first()[0], 1.0, abs_tol=1e-9)


def test_same_rows_with_one_partition(spark, lines):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = got(geometry.resample(lines, 7), "sid", "k", "x")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == got(geometry.resample(lines, 7), "sid", "k", "x")
