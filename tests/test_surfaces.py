import itertools
import math
import random

import numpy as np
import pytest

from lattica.operators import surfaces as U
from lattica.operators.proximity import nearest_on


def cloud(spark, rows, mesh="m"):
    return spark.createDataFrame([(mesh, k, *map(float, p)) for k, p in enumerate(rows)], "mesh_id string, point_id bigint, x double, y double, z double")


def scattered(n, seed):
    rng = random.Random(seed)
    return [(rng.random(), rng.random(), rng.random()) for _ in range(n)]


def test_delaunay_circles_are_empty(spark):
    rows = [(x, y, 0) for x, y, _ in scattered(60, 1)]
    p = np.array(rows)[:, :2]
    got = [(r.a, r.b, r.c) for r in U.delaunay_2d(cloud(spark, rows)).collect()]
    for t in got:
        m = p[list(t)]
        assert np.cross(np.r_[m[1] - m[0], 0], np.r_[m[2] - m[0], 0])[2] > 0
        for k in set(range(60)) - set(t):
            d = m - p[k]
            assert np.linalg.det(np.c_[d, (d * d).sum(1)]) <= 1e-12
    assert len(got) >= 90


def test_hull_holds_every_point(spark):
    rows = scattered(80, 2)
    p = np.array(rows)
    faces = [(r.a, r.b, r.c) for r in U.convex_hull(cloud(spark, rows)).collect()]
    corners = {v for f in faces for v in f}
    assert len(corners) - len(faces) * 3 // 2 + len(faces) == 2
    for a, b, c in faces:
        n = np.cross(p[b] - p[a], p[c] - p[a])
        assert ((p - p[a]) @ n).max() < 1e-9


def test_flat_and_few_points_have_no_hull(spark):
    assert U.convex_hull(cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)])).count() == 0
    assert U.convex_hull(cloud(spark, scattered(3, 1))).count() == 0 and U.delaunay_2d(cloud(spark, scattered(2, 1))).count() == 0


def test_closest_points_against_a_dense_sample():
    rng = np.random.default_rng(0)
    t = rng.random((5, 3, 3))
    p = rng.random((20, 3)) * 2 - 0.5
    each = [nearest_on(np.repeat(p[k : k + 1], len(t), 0), t) for k in range(len(p))]
    first = [int(e[1].argmin()) for e in each]
    q, d = (np.array([e[i][k] for e, k in zip(each, first, strict=True)]) for i in (0, 1))
    w = np.array([(i, j, 60 - i - j) for i, j in itertools.product(range(61), repeat=2) if i + j <= 60]) / 60
    dense = np.einsum("wk,tkc->twc", w, t).reshape(-1, 3)
    want = np.linalg.norm(p[:, None] - dense[None], axis=2).min(1)
    assert np.allclose(d, np.linalg.norm(p - q, axis=1)) and (d <= want + 1e-9).all() and (want - d < 0.05).all()


def test_metric_limits_and_not_finite(spark):
    keys = [f"h_{a}{b}" for a in "xyz" for b in "xyz"]
    rows = [("m", 0, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("m", 1, math.nan, *[0.0] * 8)]
    df = spark.createDataFrame(rows, "mesh_id string, cell_id bigint, " + ", ".join(f"{k} double" for k in keys))
    got = {r.cell_id: r for r in U.metric_from_hessian(df, 0.1, 0.1, 1.0).collect()}
    assert (got[0].m_xx, got[0].m_yy, got[0].m_zz) == pytest.approx((100, 1, 10)) and math.isnan(got[1].m_xx)


def test_many_points_are_triangulated_in_time(spark):
    import time

    rows = scattered(20_000, 8)
    began = time.perf_counter()
    assert U.delaunay_2d(cloud(spark, rows)).count() > 39_000
    assert time.perf_counter() - began < 60


def test_triangulation_of_a_grid_and_copies(spark):
    rows = [(x, y, 0) for x in range(7) for y in range(6)] * 2 + [(float("nan"), 0, 0), (1e9, 2.5, 0)]
    got = [(r.a, r.b, r.c) for r in U.delaunay_2d(cloud(spark, rows)).collect()]
    at = lambda k: rows[k][:2]
    twice = [(at(b)[0] - at(a)[0]) * (at(c)[1] - at(a)[1]) - (at(b)[1] - at(a)[1]) * (at(c)[0] - at(a)[0]) for a, b, c in got]
    assert min(twice) > 0 and {k for t in got for k in t} == {*range(42), 85}
    assert sum(v for v in twice if v == 1) == 60 and len(got) == 2 * 43 - 2 - 19
