"""Queries over whole tables, without the id subsets that some SQL has."""

import numpy as np
import pytest

from weftline.operators import spatial
from weftline.plans import registry
from weftline.sources import tables as t

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most", [100_000, 10])
def test_all_spheres_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "BROADCAST_SHAPES", most)
    points = t.lines_e(spark, LARGER).select("sid", "pid", "x", "y", "z").orderBy("sid", "pid").collect()
    lines = {}
    for r in points:
        lines.setdefault(r.sid, []).append((r.x, r.y, r.z))
    sids, lines = list(lines), np.array(list(lines.values()))
    p, step = lines[:, :-1], np.diff(lines, axis=1)
    length = (step**2).sum(2)
    expected = set()
    for s in t.shapes(spark, LARGER).collect():
        c = np.array([s.cx, s.cy, s.cz])
        at = np.clip(((c - p) * step).sum(2) / np.where(length > 0, length, 1), 0, 1)
        near = np.minimum(((lines - c) ** 2).sum(2).min(1), ((p + at[..., None] * step - c) ** 2).sum(2).min(1))
        expected |= {(s.roi_id, sids[k]) for k in np.flatnonzero(near < s.r**2)}
    got = [(r.roi_id, r.sid) for r in registry.queries()["sphere_hits"](spark, LARGER).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert len({r for r, _ in got}) > 9
