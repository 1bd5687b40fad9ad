"""What keeps plans small: rows dealt, pairs compared, lines summed, rows a task, rows a batch."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import aggregate, labels, raster, sampling, spatial, stats, volume
from weftline.plans import registry
from weftline.streaming import jobs

BOX = "roi_id long, " + ", ".join(f"{e}{a} double" for e in ("low", "high") for a in "xyz")
LINE_BOX = "sid long, " + ", ".join(f"{e}{a} double" for e in ("min", "max") for a in "xyz")


def test_range_join_deals_huge_boxes_a_few_times(spark):
    rng = random.Random(3)
    corners = lambda: [rng.uniform(-500, 500) for _ in range(3)]
    sized = lambda w: (c := corners()) + [v + w for v in c]
    lines = [(k, *sized(rng.choice([0, 0.01, 1, 7, 300]))) for k in range(300)] + [(900, *([-1e6] * 3), *([1e6] * 3)), (901, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    boxes = [(k, *sized(rng.choice([0, 2, 40]))) for k in range(60)] + [(99, *([-5e5] * 3), *([5e5] * 3)), (98, -8.0, -8.0, -8.0, -8.0, -8.0, -8.0)]
    joined = spatial.range_join(spark.createDataFrame(lines, LINE_BOX), spark.createDataFrame(boxes, BOX))
    got = [(r.sid, r.roi_id) for r in joined.collect()]
    meets = lambda p, q: None not in p and all(p[4 + k] >= q[1 + k] and p[1 + k] <= q[4 + k] for k in range(3))
    assert len(got) == len(set(got)) and set(got) == {(p[0], q[0]) for p in lines for q in boxes if meets(p, q)}
    # a box of 10 ** 18 cells of one unit beside small ones: eight rows for each level in use at most
    small = spark.createDataFrame(boxes[:1] + [(98, *([-8.0] * 6))], BOX)
    huge = spark.createDataFrame([lines[300]], LINE_BOX)
    pairs = spatial.range_join(huge, small)
    plan = pairs._jdf.queryExecution()
    assert pairs.count() == 2
    assert _generated(plan) <= 8 * 3 * 3


def _generated(plan) -> int:
    """The largest number of rows out of a generator of a plan that ran."""
    plan.executedPlan().execute().count()
    found, todo = [0], [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName() == "Generate":
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return max(found)


def _bundles(n: int, groups: int, spread: float, seed: int = 1):
    rng = np.random.default_rng(seed)
    model = np.cumsum(rng.normal(0, 3, (groups, 12, 3)), axis=1) + rng.normal(0, spread, (groups, 1, 3))
    lines = model[np.arange(n) % groups] + rng.normal(0, 0.3, (n, 12, 3))
    turned = rng.random(n) < 0.5
    lines[turned] = lines[turned, ::-1]
    return lines


def _mdf(lines):
    d = np.sqrt(((lines[:, None] - lines[None]) ** 2).sum(axis=3)).mean(axis=2)
    t = np.sqrt(((lines[:, None] - lines[None, :, ::-1]) ** 2).sum(axis=3)).mean(axis=2)
    return np.minimum(d, t)


def _frame(spark, lines):
    return spark.createDataFrame([(k, line.ravel().tolist()) for k, line in enumerate(lines)], "sid long, xyz array<double>")


@pytest.mark.parametrize("block", [256, 20])
def test_pairs_within_a_limit_compare_few(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "BLOCK", block)
    lines = _bundles(240, 12, 60.0)
    d = _mdf(lines)
    found = stats.mdf_compared(_frame(spark, lines), 4.0).collect()
    got = {(r.a, r.b): r.mdf for r in found if r.a is not None}
    want = {(a, b): d[a, b] for a, b in itertools.combinations(range(len(lines)), 2) if d[a, b] < 4.0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert sum(r.compared for r in found) < 0.15 * len(lines) * (len(lines) - 1) / 2
    every = {(r.a, r.b) for r in stats.mdf_pairs(_frame(spark, lines[:30])).collect()}
    assert every == set(itertools.combinations(range(30), 2))


def test_no_pair_is_lost_at_a_border_or_beside_a_line_of_no_numbers(spark):
    e = 2.0**-49
    a = np.array([14 - 3 * e, 14 - 4 * e, 14, 14 - 2 * e, 14 - e, 14 - 2 * e, 14, 14 - 4 * e, 14, 14 - e, 14 - e, 14])
    b = np.array([28 - 2 * e, 28 - 4 * e, 28 - 2 * e, 28 - 4 * e, 28 - 4 * e, 28 - 2 * e, 28 - 4 * e, 28 - 4 * e, 28 - 2 * e, 28, 28 - 2 * e, 28 - 2 * e])
    border = np.zeros((2, 12, 3))
    border[0, :, 0], border[1, :, 0] = a, b  # nearer than 14, yet their means fall in the first and the third cell of 14
    assert np.cumsum(a)[-1] / 12 < 14 and np.cumsum(b)[-1] / 12 == 28 and np.abs(a - b).mean() < 14
    assert [(r.a, r.b) for r in stats.mdf_pairs(_frame(spark, border), 14.0).collect()] == [(0, 1)]
    odd = np.concatenate([_bundles(40, 1, 0.0), np.full((3, 12, 3), 1.0)])
    odd[40, 5, 1], odd[41, 2, 0], odd[42, 1, 2] = np.nan, np.inf, 1e200
    d = _mdf(odd[:40])
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if d[i, j] < 4.0}
    assert {(r.a, r.b) for r in stats.mdf_pairs(_frame(spark, odd), 4.0).collect()} == want and len(want) > 100


def test_bounds_in_single_precision_keep_every_near_pair():
    lines = _bundles(600, 2, 8.0)
    lines[300:] += 1e4  # two groups far from each other, and one line far from both
    lines[599], lines[7], lines[9], lines[11] = 1e9, lines[8], lines[8, ::-1], lines[8] + 1e-7
    d, ids = _mdf(lines), np.arange(600)
    for limit in (1e-6, 4.0, 11.5):
        found = list(stats._near(lines, ids, lines, ids, limit, True))
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(d < limit, 1)), strict=True)}
        assert {(a, b) for one, two, _, _ in found for a, b in zip(one, two, strict=True)} == want
        assert sum(len(one) for one, *_ in found) == len(want)
    bounds = stats._at_least(lines[:300], lines[:300], np.full(12, 1 / 12))
    assert bounds.dtype == np.float32 and (bounds <= d[:300, :300]).all() and (bounds >= d[:300, :300] * (1 - 1e-3) - 0.1).all()


def test_medoid_sums_few_lines(spark):
    lines = np.concatenate([_bundles(200, 1, 0.0, seed=2), _bundles(100, 5, 80.0, seed=3)])
    total = _mdf(lines).sum(axis=1)
    best, summed = stats.medoid_search(_frame(spark, lines), pivots=8, first=16)
    row = best.collect()
    assert [(r.sid, round(r.total, 4)) for r in row] == [(int(total.argmin()), round(float(total.min()), 4))]
    assert summed < 0.7 * len(lines)
    assert stats.medoid_exact(_frame(spark, lines[:0])).count() == 0


def test_medoid_without_prunable_lines_sums_few(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 100)
    lines = np.random.default_rng(4).normal(0, 10, (700, 12, 3))  # distances lie so close together that no pivot bounds one
    lines[650] = lines[600, ::-1]
    total = _mdf(lines).sum(axis=1)
    least = {r.sid: r.least for r in stats._least_totals(_frame(spark, lines)).collect()}
    assert len(least) == 700 and all(total[k] * (1 - 1e-3) <= v <= total[k] for k, v in least.items())
    best, summed = stats.medoid_search(_frame(spark, lines), pivots=8, first=16)
    assert [(r.sid, round(r.total, 4)) for r in best.collect()] == [(int(total.argmin()), round(float(total.min()), 4))]
    assert summed < 40


def test_ranks_of_one_far_id_are_dealt_evenly(spark):
    ids = spark.range(40_000).select((F.col("id") * 3).alias("sid")).unionAll(spark.range(1).select(F.lit(10**15).alias("sid"))).repartition(8)
    ranked = sampling.global_rank(ids)
    assert {r.sid: r["rank"] for r in ranked.collect()} == {s: k for k, s in enumerate([*range(0, 120_000, 3), 10**15])}
    sizes = [r["count"] for r in sampling.ranged(ids, "sid", 64).groupBy("__bucket").count().collect()]
    assert max(sizes) < 2 * 40_001 / 64 and sampling.global_rank(ids.limit(0)).count() == 0


def test_polygons_by_scan_lines(spark):
    rng = random.Random(8)
    polygons = {k: [(rng.choice([rng.uniform(-3, 14), float(rng.randrange(0, 10))]), rng.choice([rng.uniform(-3, 14), float(rng.randrange(0, 10))])) for _ in range(rng.randrange(2, 9))] for k in range(40)}
    rows = [(k, n, x, y, 4.4) for k, p in polygons.items() for n, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "roi_id long, pid int, x double, y double, z double")
    got = [(r.roi_id, r.i, r.j, r.k) for r in raster.fill_polygon(df, (10, 11, 6)).collect()]
    want = set()
    for k, p in polygons.items():
        if len(p) < 3:
            continue
        for i, j in itertools.product(range(10), range(11)):
            inside = False
            for n, (xi, yi) in enumerate(p):
                xj, yj = p[n - 1]
                if (yi > j) != (yj > j) and i < (xj - xi) * (j - yi) / (yj - yi + 1e-10) + xi:
                    inside = not inside
            if inside and math.floor(min(x for x, _ in p)) <= i <= math.ceil(max(x for x, _ in p)):
                want.add((k, i, j, 4))
    assert len(got) == len(set(got)) and set(got) == want and want
    tall = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 9e5, 2.0, 0.0), (1, 2, 9e5, 3.0, 0.0)], "roi_id long, pid int, x double, y double, z double")
    assert raster.fill_polygon(tall, (10**6, 10**6, 1)).groupBy("j").count().count() == 2  # rows 1 and 2; no row a cell of its box


def test_exact_quantiles_in_passes(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.gauss(0, 1), 7.0, 10 ** rng.uniform(-200, 200), -3.5]) for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    ordered, ranks = sorted(values), [0, 1, 149, 1500, 2969, 2999]
    assert volume.order_statistics(df, "v", ranks, bins=4, few=5) == [ordered[r] for r in ranks]
    assert volume.quantiles(df, "v", (0.05, 0.99)) == pytest.approx(np.quantile(values, [0.05, 0.99]).tolist())
    assert volume.quantiles(df.limit(0), "v", (0.5,)) == [None]


@pytest.mark.parametrize("tile", [32, 3, 5])
def test_smoothing_by_tiles(spark, tile):
    rng = np.random.default_rng(2)
    dims, sigma = (7, 9, 4), 0.8
    voxels = [(i, j, k, float(rng.normal())) for i in range(7) for j in range(9) for k in range(4) if rng.random() < 0.15]
    block, there = np.zeros(dims), np.zeros(dims)
    for i, j, k, v in voxels:
        block[i, j, k], there[i, j, k] = v, 1
    w = volume.kernel(sigma)
    for axis, n in enumerate(dims):
        taken = [np.clip(np.arange(n) + o - len(w) // 2, 0, n - 1) for o in range(len(w))]
        block, there = (sum(x * np.take(b, t, axis=axis) for x, t in zip(w, taken)) for b in (block, there))
    df = spark.createDataFrame(voxels, "i int, j int, k int, value double")
    got = {(r.i, r.j, r.k): r.value for r in volume.gaussian_smooth(df, dims, sigma, tile=tile).collect()}
    assert got.keys() == set(zip(*np.nonzero(there))) and all(math.isclose(v, block[p], abs_tol=1e-12) for p, v in got.items())


def test_running_density_writes_touched_cells(spark, tmp_path):
    first, then = [(float(k), 0.0, 0.0) for k in range(20)], [(3.0, 0.0, 0.0), (3.0, 0.0, 0.0), (25.0, 0.0, 0.0)]
    for n, rows in enumerate((first, then)):
        spark.createDataFrame(rows, "x double, y double, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f={n}"))
    stream = jobs.files_as_stream(spark, str(tmp_path / "in" / "*" / "*.parquet"), spark.read.parquet(str(tmp_path / "in" / "f=0")).schema)
    from weftline.functions.affine import IDENTITY
    from weftline.operators.aggregate import density_map

    counts = density_map(stream, IDENTITY, (40, 2, 2))
    out = jobs._run(counts, "update", "density", jobs._changed)
    written = sorted(r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect())
    assert written == [2, 20]
    table = jobs.upserted(spark, out, counts.schema, ["i", "j", "k"])
    want = {k: 1 for k in range(20)} | {3: 3, 25: 1}
    assert {r.i: r.n for r in table.collect()} == want
    last = spark.createDataFrame(spark.read.parquet(out).where("batch = 1").drop("batch").collect(), counts.schema)
    jobs._changed(last, 1, out)  # a batch that is run again
    assert {r.i: r.n for r in jobs.upserted(spark, out, counts.schema, ["i", "j", "k"]).collect()} == want


def test_label_file_or_given_table(spark, tmp_path):
    builtin = spark.createDataFrame([(1, "Usual", 0)], "label int, name string, extra int")
    (tmp_path / "lut.txt").write_text("# comment\n\n2 Left-Two 1 2 3 0\nx3 bad\n2 Again 0 0 0 0\n")
    (tmp_path / "none.txt").write_text("# only a comment\n")
    found = lambda p: {r.label: r["name"] for r in labels.lut_or_builtin(spark, p, builtin).collect()}
    assert found(str(tmp_path / "lut.txt")) == {2: "Again"}
    assert found(str(tmp_path / "none.txt")) == found(str(tmp_path / "missing.txt")) == found(None) == {1: "Usual"}


def test_matrix_of_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "BROADCAST_LABELS", 2)
    ends = spark.createDataFrame([(0, 1, 2), (1, 2, 2)], "sid long, label_a int, label_b int")
    assert {(r.label_a, r.label_b): r.n for r in aggregate.connectivity_matrix(ends).collect()} == {(1, 1): 0, (1, 2): 1, (2, 1): 1, (2, 2): 1}
    assert aggregate.connectivity_matrix(ends.limit(0)).count() == 0
    with pytest.raises(ValueError, match="connectivity_edges"):
        aggregate.connectivity_matrix(ends.unionByName(spark.createDataFrame([(2, 3, 3)], ends.schema)))


def test_equal_spheres_are_tested_once(spark):
    lines = spark.createDataFrame([(k, [(float(k), 0.0, 0.0), (k + 0.5, 0.0, 0.0)]) for k in range(4)], "sid long, points array<struct<x: double, y: double, z: double>>")
    balls = [(n, float(n % 2) + 0.1, 0.0, 0.0, 0.3) for n in range(40)] + [(0, 3.0, 0.0, 0.0, 0.3), (0, 0.1, 0.0, 0.0, 0.3), (0, 3.2, 0.0, -0.0, 0.3), (41, None, 0.0, 0.0, 1.0)]
    spheres = spark.createDataFrame(balls, "roi_id long, cx double, cy double, cz double, r double")
    assert spatial._classes(spheres.dropna())[0].num_rows == 4
    got = [(r.roi_id, r.sid) for r in spatial.sphere_hits(lines, spheres).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, n % 2) for n in range(40)} | {(0, 3)}


def test_amplitudes_of_equal_vertices_are_taken_once(spark):
    voxels = [(0, 0, 0, [1.0, 2.0, 4.0]), (0, 0, 0, [1.0, None]), (0, 1, 0, [3.0]), (0, 2, 0, []), (9, 9, 9, [1.0])]
    coefficients = spark.createDataFrame(voxels, "i int, j int, k int, coeffs array<double>")
    mask = spark.createDataFrame([(0, j, 0) for j in range(3)], "i int, j int, k int")
    rows = [(v, k, float(v % 2 + k)) for v in range(6) for k in (0, 2)] + [(6, 1, 5.0), (7, 0, None)]
    out = aggregate.masked_odf_amplitudes(coefficients, mask, spark.createDataFrame(rows, "vertex long, idx int, b double"))
    got = {(r.j, r.vertex): r.amplitude for r in out.collect()}
    expected = {(0, v): 2.0 * (v % 2) + 4.0 * (v % 2 + 2) for v in range(6)} | {(1, v): 3.0 * (v % 2) for v in range(6)} | {(0, 6): 10.0, (0, 7): None, (1, 7): None}
    assert got == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" in plan  # classes times voxels, not a grouping of all terms of all vertices


def test_lines_of_a_full_cell_are_copied_a_few_times(spark):
    lines = spark.createDataFrame([(k, [0.0] * 6) for k in range(3_000)], "sid long, xyz array<double>").select(F.lit(0).alias("cell"), "*")
    dealt = stats._dealt(lines)
    assert dealt.count() <= (stats.BLOCKS + 1) * 3_000
    assert dealt.where("p > q").isEmpty() and dealt.select("p", "q").distinct().count() == stats.BLOCKS * (stats.BLOCKS + 1) // 2


def test_sums_of_distances_keep_their_digits():
    lines = _bundles(60, 3, 40.0)
    lines[7], lines[9], lines[11] = lines[8], lines[8, ::-1], lines[8] + 1e-7
    assert np.allclose(stats._sums(lines, lines[5:40], 16), _mdf(lines)[:, 5:40].sum(axis=0), rtol=1e-12, atol=1e-9)
    assert (stats._at_least(*(stats._means(lines)[0],) * 2, stats._means(lines)[1]) <= _mdf(lines)).all()


def test_equal_boxes_are_joined_once_without_a_shuffle_of_lines(spark):
    lines = spark.createDataFrame([(k, *[float(k)] * 3, *[k + 2.5] * 3) for k in range(50)], LINE_BOX)
    boxes = [(n, *[float(n % 3)] * 3, *[n % 3 + 1.0] * 3) for n in range(300)]
    joined = spatial.range_join(lines, spark.createDataFrame([*boxes, (300, None, *[0.0] * 5)], BOX))
    got = [(r.roi_id, r.sid) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, k) for n in range(300) for k in range(50) if k <= n % 3 + 1 and k + 2.5 >= n % 3}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_hits_of_equal_spheres_stand_in_runs_and_take_little_space(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    lines = [(k * 7919, [(rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3)]) for k in range(600)]
    spheres = [(n * 31, 0.5 * (n % 40), 10.0, 10.0, 6.0) for n in range(20_000)]
    frame = spark.createDataFrame(lines, "sid long, points array<struct<x: double, y: double, z: double>>")
    shapes = lambda some: spark.createDataFrame([*some, some[0]], "roi_id long, cx double, cy double, cz double, r double")
    spatial.sphere_hits(frame, shapes(spheres)).write.parquet(f"{tmp_path}/runs")
    rows = spark.read.parquet(f"{tmp_path}/runs").count()
    assert rows > 2_000_000 and sum(f.stat().st_size for f in (tmp_path / "runs").glob("*.parquet")) < 0.8 * rows
    hits = spatial.sphere_hits(frame, shapes(spheres[:200])).collect()
    monkeypatch.setattr(spatial, "BROADCAST_MEMBERS", 10)
    joined = spatial.sphere_hits(frame, shapes(spheres[:200])).collect()
    assert len(hits) == len(set(hits)) == len(joined) > 10_000 and set(hits) == set(joined)


def test_pairs_of_equal_boxes_stand_in_runs_and_take_little_space(spark, monkeypatch, tmp_path):
    given = "/root/testdata/sf0.001"
    supplier = spark.read.parquet(f"{given}/supplier.parquet").limit(1).drop("s_suppkey").crossJoin(spark.range(20_000).withColumnRenamed("id", "s_suppkey"))
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{given}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    registry.queries()["bbox_range_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/runs")
    rows = spark.read.parquet(f"{tmp_path}/runs").count()
    assert rows > 10_000_000 and sum(f.stat().st_size for f in (tmp_path / "runs").glob("*.parquet")) < 0.8 * rows
    found = registry.queries()["bbox_range_join"](spark, given).collect()
    monkeypatch.setattr(spatial, "BROADCAST_MEMBERS", 1)
    joined = registry.queries()["bbox_range_join"](spark, given).collect()
    monkeypatch.setattr(spatial, "BROADCAST_BOXES", 1)
    grid = registry.queries()["bbox_range_join"](spark, given).collect()
    assert len(found) == len(set(found)) == len(joined) == len(grid) > 1_000 and set(found) == set(joined) == set(grid)


def test_strokes_stream_through_a_task(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rng = random.Random(5)
    rows = [(s, p, *[rng.uniform(-2, 26) for _ in "xyz"]) for s in range(6) for p in range(1 + 4 * s)]
    rows += [(None, 0, 1.0, 1.0, 1.0), (None, 1, 3.5, 1.0, 1.0), (9, 0, 2.5, 2.5, 3.5), (10, 0, 1.0, None, 1.0), (10, 1, 1.0, 1.0, 1.0), (11, 0, 4.0, 4.0, 4.0), (11, 1, 4.0, 4.0, 4.0), (12, 0, 0.0, 0.0, 0.0), (12, 1, 1e6, 0.0, 0.0)]
    try:
        out = raster.rasterise_strokes(spark.createDataFrame(rows, "sid long, pid int, x double, y double, z double"), (25, 25, 25))
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {(9, 2, 2, 4), *[(None, x, 1, 1) for x in (1, 2, 3, 4)]}
    for s in range(6):
        line = [r[2:] for r in rows if r[0] == s]
        for p, q in itertools.pairwise(line):
            n = math.ceil(math.sqrt(sum((b - a) * (b - a) for a, b in zip(p, q, strict=True))) * 10)
            for k in range(n + 1):
                voxel = [round(b if k == n else a + k * ((b - a) / n)) for a, b in zip(p, q, strict=True)]
                expected |= {(s, *voxel)} if all(0 <= c <= 24 for c in voxel) else set()
        if len(line) == 1 and all(0 <= round(c) <= 24 for c in line[0]):
            expected.add((s, *[round(c) for c in line[0]]))
    assert len(got) == len(set(got)) and set(got) == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan  # no task gathers a line or its voxels


def test_edits_of_a_batch_touch_an_entry_of_the_state_once():
    class Counted(dict):
        calls = 0

        def __getattr__(self, name):
            Counted.calls += 1
            return {"containsKey": self.__contains__, "getValue": self.__getitem__, "updateValue": self.__setitem__, "removeKey": self.pop}[name]

        def keys(self):
            Counted.calls += 1
            return iter(list(dict.keys(self)))

    state = Counted({(7,): (True,), (8,): (True,)})
    held = jobs._Held(state, False)
    for _ in range(50):
        held.updateValue((1,), (True,))
        held.removeKey((7,))
        assert held.containsKey((8,)) and not held.containsKey((7,))
    assert sorted(held.keys()) == [(1,), (8,)]
    held.write(False)
    assert dict(state.items()) == {(1,): (True,), (8,): (True,)} and Counted.calls <= 6
    held.clear()
    held.updateValue((3,), (True,))
    assert list(held.keys()) == [(3,)]
