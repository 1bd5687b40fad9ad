"""Near-duplicates of texts and vectors, and components, against brute force."""

import random

import numpy as np
import pytest

from weftline.llm import grid_join, minhash
from weftline.llm.components import connected_components


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    random.seed(4)
    links = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 40)] + [(7, 7)],
        "random": [(random.randrange(90), random.randrange(90)) for _ in range(60)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in union_find(ids, links).items()}


def words_of(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = [i for i, _ in rows]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, union_find(ids, links)


def corpus():
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(30, 120))] for _ in range(25)]
    rows = [(None), ("")] + [" \n "] + ["One two"] * 2 + ["one TWO", "ONE", "É É", "é é"]
    for words in base:
        for _ in range(8):
            own = list(words)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append(" ".join(own))
    chain = [f"c{k}" for k in range(80)]  # neighbours are alike, ends aren't
    for k in range(30):
        rows.append(" ".join(chain))
        chain[(k * 7) % 80] = f"x{k}"
    rows += [" ".join(base[0])] * 30
    return list(enumerate(rows))


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_minhash(spark, n, percent):
    rows = corpus()
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, words=n, percent=percent).collect()}
    sets, components = brute(rows, n, percent)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == components
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_minhash_of_nothing_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(3, text), (3, "other words that are alone here"), (None, text), (8, "other words that are alone here"), (5, text)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(3, 3, True), (3, 3, True), (None, None, False), (8, 3, False), (5, 3, False)], key=str)


def test_block_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, 30)).astype(np.uint64) for _ in range(12)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert minhash._overlaps(sets[:5], sets[5:]).tolist() == expected


def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    rows = [c + rng.normal(size=16) * 0.12 for c in centres for _ in range(12)]
    rows += [rows[0]] * 25 + [rows[0] * 3.5] + list(rng.normal(size=(60, 16)))
    out = [[float(x) for x in v] for v in rows]
    return out + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.01], [1e200] * 16, [1e200] * 16]


@pytest.mark.parametrize("leaf", [4096, 64])
def test_grid_join(spark, monkeypatch, leaf):
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    monkeypatch.setattr(grid_join, "STEP", 16)
    rows = list(enumerate(vectors()))
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in grid_join.near_duplicates(df).collect()}
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.sqrt(x @ x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    counts = {i: sum(i in p for p in links) for i, _ in rows}
    assert {i: r.n_links for i, r in got.items()} == counts
    assert {i: r.component_id for i, r in got.items()} == union_find([i for i, _ in rows], links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_grid_join_of_nothing(spark):
    assert grid_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [tuple(r) for r in grid_join.near_duplicates(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()] == [(4, 0, 4, True)]


def test_grid_join_of_one_class(spark):
    """One vector, equal ones, and two lengths of one class each."""
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for some, expected in (
        (df.where("vec_id = 9"), {(9, 0, 9, True)}),
        (df.where("vec_id IN (1, 3)"), {(1, 1, 1, True), (3, 1, 1, False)}),
        (df, {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True), (None, 0, None, False)}),
    ):
        assert {tuple(r) for r in grid_join.near_duplicates(some).collect()} == expected


def join_all(x, size=16):
    """Links by intervals, and the share of pairs that reached the exact cosine."""
    x = grid_join._unit(x)
    _, _, axes = np.linalg.svd(np.cov(x.T))
    p = x @ axes[: grid_join.DIMS].T
    order = np.lexsort(np.floor(p[:, : grid_join.CELLS] / 0.08).T[::-1])
    found = grid_join._Found(order.astype(np.int64), np.ones(len(x), np.int64))
    grid_join._join(x[order], x[order], p[order], p[order], 0, 0, True, 0.95, float(np.sqrt(0.1)) + 1e-6, found)
    brute = np.triu(x @ x.T >= 0.95, 1)
    links = np.zeros(len(x), np.int64)
    links[order] = found.links
    assert links.tolist() == (brute.sum(axis=0) + brute.sum(axis=1)).tolist()
    return found.full / (len(x) * (len(x) - 1) / 2)


def test_grid_join_skips_distant_vectors(spark):
    rng = np.random.default_rng(5)
    assert join_all(rng.normal(size=(3000, 64))) < 0.01
    centres = rng.normal(size=(40, 64))
    assert join_all(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 64)) * 0.3) < 0.05


def test_grid_join_drops_distant_leaves(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "LEAF", 64)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(80, 24)), 50, axis=0) + rng.normal(size=(4000, 24)) * 0.05
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, weight long")
    epsilon = float(np.sqrt(0.1)) + 1e-6
    axes = grid_join.directions(df, 24, 20_000)
    leaves = grid_join.materialise(grid_join._numbered(grid_join.materialise(grid_join._leaves(df, axes, epsilon))))
    n = leaves.count()
    assert grid_join._leaf_pairs(leaves, epsilon).count() < 0.2 * n * (n + 1) / 2


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (0, [-1.0, 0.0])]
    made = grid_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in made.collect()) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    apart = grid_join.near_duplicates(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links) for r in apart.collect()) == [(1, 0), (1, 1), (2, 1)]
