"""Conformity, repair, refinement, cotangent operators, measuring, lattices and steps on small meshes with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import options
from lattica.mesh import MeshFrame
from lattica.operators import conformity as K
from lattica.operators import cotangent as L
from lattica.operators import datasets as E
from lattica.operators import geometry as G
from lattica.operators import grids as X
from lattica.operators import measuring as M
from lattica.operators import refinement as R
from lattica.operators import sequences as Q
from lattica.operators import shapes as A
from lattica.operators import spatial as S
from lattica.operators import topology as Y
from lattica.operators.proximity import nearest_triangles
from lattica.plans.pipeline import apply_step, parse_pipeline
from lattica.plans.reports import report


def mesh(spark, points, cells):
    p = spark.createDataFrame([("m", k, *map(float, x)) for k, x in enumerate(points)], "mesh_id string, point_id bigint, x double, y double, z double")
    c = spark.createDataFrame([("m", k, t, list(n)) for k, (t, n) in enumerate(cells)], "mesh_id string, cell_id bigint, cell_type string, nodes array<bigint>")
    return MeshFrame(p, c)


def soup(spark, triangles):
    """Triangles as rows with their corners."""
    rows = [("m", k, [tuple(map(float, c)) for c in t]) for k, t in enumerate(triangles)]
    return spark.createDataFrame(rows, "mesh_id string, cell_id bigint, corners array<struct<x: double, y: double, z: double>>")


def test_every_primitive_is_closed_or_open_as_it_should(spark):
    for kind in ("cylinder", "cone", "sphere", "torus"):
        row = Y.watertight_check(A.generate(spark, kind).cells).first()
        assert (row["open"], row["non_manifold"], row["inconsistent"]) == (0, 0, 0), kind
    assert Y.watertight_check(A.generate(spark, "disk", around=7).cells).first()["open"] == 7
    assert A.generate(spark, "helix", segments=5).cells.count() == 5
    with pytest.raises(ValueError):
        A.generate(spark, "teapot")


def test_refinement_keeps_the_measure(spark):
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    cells = [("tetra", [0, 1, 3, 4]), ("hexahedron", range(8)), ("wedge", [0, 1, 3, 4, 5, 7]), ("line", [0, 6]), ("quad", [0, 1, 2, 3])]
    m = mesh(spark, cube, cells)
    before = {r["cell_id"]: r["measure"] for r in G.with_measure(m).collect()}
    parts = {}
    for r in G.with_measure(R.refine(m)).collect():
        parts.setdefault(r["parent"], []).append(r["measure"])
    assert {k: len(v) for k, v in parts.items()} == {0: 8, 1: 8, 2: 8, 3: 2, 4: 4}
    for k, own in parts.items():
        assert sum(own) == pytest.approx(before[k]) and all(p * before[k] > 0 for p in own)


def test_tessellated_arcs_come_closer(spark):
    s = math.sqrt(0.5)
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.5, 0, 0), (s, s, 0), (0, 0.5, 0)], [("triangle6", range(6))])
    rows = [r["corners"] for r in R.tessellate(m, 8).collect()]
    area = sum(abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 for a, b, c in rows)
    assert len(rows) == 64 and area == pytest.approx(math.pi / 4, abs=0.02)


def test_orientation_of_a_strip_that_has_none(spark):
    # a Moebius strip of five quads as triangles
    ring = [(math.cos(a) * (1 + w * math.cos(a / 2)), math.sin(a) * (1 + w * math.cos(a / 2)), w * math.sin(a / 2)) for a in np.linspace(0, 2 * math.pi, 6)[:-1] for w in (-0.3, 0.3)]
    cells = []
    for k in range(5):
        a, b = 2 * k, 2 * k + 1
        c, d = (2 * k + 2, 2 * k + 3) if k < 4 else (1, 0)
        cells += [("triangle", (a, b, d)), ("triangle", (a, d, c))]
    m = mesh(spark, ring, cells)
    assert sorted(map(str, K.orient(m.cells).collect())) == sorted(map(str, m.cells.collect()))


def test_repair_of_a_torn_box(spark):
    box = Y.surface_mesh(A.box(spark, divisions=(2, 2, 2)))
    mixed = box.cells.where("cell_id <> 5").withColumn("nodes", F.when(F.col("cell_id") % 2 == 0, F.reverse("nodes")).otherwise(F.col("nodes")))
    whole = K.repair(box.with_(cells=mixed.select("mesh_id", "cell_id", "cell_type", "nodes")))
    row = Y.watertight_check(whole.cells).first()
    assert (row["open"], row["non_manifold"], row["inconsistent"]) == (0, 0, 0)
    c = F.col("corners")
    six = whole.with_corners().agg(F.sum(G.dot(G.corner(c, 0), G.cross(G.corner(c, 1), G.corner(c, 2))))).first()[0]
    assert six / 6 == pytest.approx(1)


def test_hanging_points_and_unwelded_facets(spark):
    # one big quad beside two small ones that share its side in halves
    m = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 2, 0), (0, 2, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0)], [("quad", (0, 1, 2, 3)), ("quad", (1, 5, 6, 4)), ("quad", (4, 6, 7, 2))])
    assert [(r["lo"], r["hi"], r["point_id"]) for r in K.hanging_points(m).collect()] == [(1, 2, 4)]
    double = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (1, 1, 0)], [("quad", (0, 1, 2, 3)), ("quad", (4, 5, 6, 7))])
    row = K.check_conformity(double).first()
    assert (row["unwelded"], row["boundary"], row["hanging_points"]) == (2, 8, 0)


def test_interface_whose_rim_hangs_together(spark):
    # four quads about a middle; cut one of the four inner edges: no point comes apart
    m = A.plane(spark, divisions=(2, 2))
    side = spark.createDataFrame([("plane", 0, 1)], "mesh_id string, cell_id bigint, facet int")
    assert K.split_interface(m, side).points.count() == 10
    both = spark.createDataFrame([("plane", 0, 1), ("plane", 2, 1)], "mesh_id string, cell_id bigint, facet int")
    assert K.split_interface(m, both).points.count() == 12


def test_crossing_triangles_of_one_mesh(spark):
    m = mesh(spark, [(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.5, 0.5, -1), (0.5, 0.5, 1), (3, 3, 1), (2, 2, 5)], [("triangle", (0, 1, 2)), ("triangle", (3, 4, 5)), ("triangle", (4, 5, 6))])
    assert [(r["cell_a"], r["cell_b"]) for r in K.find_intersections(m).collect()] == [(0, 1)]


def test_nearest_triangles_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    t = rng.random((60, 3, 3)) * 0.3 + rng.random((60, 1, 3))
    p = np.concatenate([rng.random((40, 3)), rng.random((10, 3)) * 80 - 40])
    points = spark.createDataFrame([("m", k, *map(float, x)) for k, x in enumerate(p)], "mesh_id string, point_id bigint, x double, y double, z double")
    got = {r["point_id"]: r["distance"] for r in nearest_triangles(points, soup(spark, t.tolist())).collect()}
    from lattica.operators.proximity import nearest_on

    for k, x in enumerate(p):
        assert got[k] == pytest.approx(nearest_on(np.repeat(x[None], len(t), 0), t)[1].min())


def test_signs_at_edges_and_corners_of_a_box(spark):
    box = Y.surface_mesh(A.box(spark))
    flat = box.with_(cells=K.triangulated(box.cells))
    where = [(1.5, 1.5, 1.5), (0.5, 0.5, 0.6), (-1, -1, 0.5), (0.9, 0.9, 0.9), (30, 0.2, 0.3)]
    points = spark.createDataFrame([("box", k, *x) for k, x in enumerate(map(lambda v: tuple(map(float, v)), where))], "mesh_id string, point_id bigint, x double, y double, z double")
    rows = sorted(nearest_triangles(points, flat.with_corners()).collect(), key=lambda r: r["point_id"])
    assert [r["side"] for r in rows] == [1, -1, 1, -1, 1]
    assert [r["distance"] for r in rows] == pytest.approx([math.sqrt(0.75), 0.4, math.sqrt(2), 0.1, 29])


def test_far_queries_meet_their_nearest(spark):
    points = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 1.0, 0.0, 0.0)], "mesh_id string, point_id bigint, x double, y double, z double")
    far = spark.createDataFrame([("m", 7, 50.0, 0.0, 0.0), ("m", 8, -3.0, 4.0, 0.0)], points.schema)
    got = sorted((r["point_id"], r["other_id"], r["d2"]) for r in S.nearest(far, points).collect())
    assert got == [(7, 1, 2401.0), (8, 0, 25.0)]


def test_heat_and_spectrum_and_solves(spark):
    ball = A.sphere(spark, 1.0, 24, 16)
    m = ball.with_(cells=K.triangulated(ball.cells))
    curved = L.mean_curvature(m).join(m.points, ["mesh_id", "point_id"]).where("abs(z) < 0.7")
    low, high = curved.agg(F.min("mean"), F.max("mean")).first()
    assert 0.95 < low <= high < 1.05
    moved = L.sobolev_deform(m.with_(points=m.points.withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(-2.0)})), ("a", "b", "c"), 0.5)
    shift = moved.join(m.points.select("point_id", F.col("x").alias("x0"), F.col("z").alias("z0")), "point_id").agg(F.max(F.abs(F.col("x") - F.col("x0") - 1)), F.max(F.abs(F.col("z") - F.col("z0") + 2))).first()
    assert max(shift) < 1e-6
    strip = A.plane(spark, (4.0, 1.0), (8, 2))
    flat = strip.with_(cells=K.triangulated(strip.cells))
    ends = flat.points.where("x in (0.0, 4.0)").select("mesh_id", "point_id", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.col("x").alias("uz"))
    off = L.morph(flat, ends).agg(F.max(F.abs(F.col("z") - F.col("x")))).first()[0]
    assert off < 1e-6


def test_measured_elements_and_datums(spark):
    rows = [("m", k, float(x), float(y), 2.0, "top") for k, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (3, 2)])]
    rows += [("m", 10 + k, 0.5 + 2 * math.sin(t) * math.cos(f), 2 * math.sin(t) * math.sin(f), 2 * math.cos(t), "ball") for k, (t, f) in enumerate((t, f) for t in (0.3, 1.1, 2.2) for f in (0, 1.5, 3, 4.5))]
    points = spark.createDataFrame(rows, "mesh_id string, point_id bigint, x double, y double, z double, element string")
    got = {r["element"]: r for r in M.fit_elements(points, kinds={"ball": "sphere"}).collect()}
    assert (got["top"]["dz"], got["top"]["rms"]) == pytest.approx((1, 0)) and (got["ball"]["radius"], got["ball"]["cx"], got["ball"]["rms"]) == pytest.approx((2, 0.5, 0), abs=1e-6)
    spec = spark.createDataFrame([("bore", "diameter", "ball", None, 4.0, -0.1, 0.1), ("height", "distance", "ball", "top", 2.5, -0.1, 0.1)], "name string, kind string, a string, b string, nominal double, low double, high double")
    verdicts = {r["name"]: (r["value"], r["verdict"]) for r in M.dimensions(M.fit_elements(points, kinds={"ball": "sphere"}), spec).collect()}
    assert verdicts["bore"] == (pytest.approx(4), "PASS") and verdicts["height"] == (pytest.approx(2), "FAIL")
    m = np.array(M.align_datums((0, 0, 2), (1, 1, 5), (3, 4, 5)))
    assert np.allclose(m @ [3, 4, 5, 1], [0, 0, 0, 1]) and np.allclose(m[:3, :3] @ [1, 1, 0], [math.sqrt(2), 0, 0])
    with pytest.raises(ValueError):
        M.align_datums((0, 0, 1), (0, 0, 3))


def test_alignment_and_symmetry(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(60, 3)) * [5, 2, 0.7] + [1, 0, 0]
    p = np.concatenate([p, p * [1, 1, -1]])
    r = np.array(G.rotation((1, 2, 3), 100.0))
    frame = lambda x: spark.createDataFrame([("m", k, *map(float, v)) for k, v in enumerate(x)], "mesh_id string, point_id bigint, x double, y double, z double")
    matrix, rms = M.auto_align(frame(p), frame(p @ r[:3, :3].T + [9, 8, 7]))
    assert rms < 1e-6 and np.allclose(matrix[:3, :3] @ r[:3, :3].T, np.eye(3), atol=1e-6)
    _, normal, score = M.find_symmetry_plane(frame(p))
    assert score < 1e-9 and abs(normal[2]) == pytest.approx(1)


def test_pieces_out_of_tolerance(spark):
    m = A.plane(spark, divisions=(6, 1))
    d = m.cells.select("mesh_id", "cell_id", F.when(F.col("cell_id") < 2, 0.5).when(F.col("cell_id") == 4, -0.7).otherwise(0.0).alias("distance"))
    got = sorted((r["kind"], r["cells"], r["worst"]) for r in M.deviation_regions(m, d, 0.1).collect())
    assert got == [("excess", 2, 0.5), ("missing", 1, 0.7)]


def test_islands_by_every_criterion(spark):
    quads = [("quad", (4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3)) for k in range(3)]
    points = [(10 * k + s * x, s * y, 0) for k, s in enumerate((1, 2, 3)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    m = mesh(spark, points, quads)
    left = lambda **o: sorted(r["cell_id"] for r in Y.remove_islands(m, **o).cells.collect())
    assert left(min_area=3.9) == [1, 2] and left(min_diagonal=4.0) == [2] and left(min_share=0.5) == [0, 1, 2] and left(min_cells=2) == []
    touching = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (2, 1, 0), (2, 2, 0), (1, 2, 0)], [("quad", (0, 1, 2, 3)), ("quad", (2, 4, 5, 6))])
    assert Y.remove_islands(touching, 2).cells.count() == 2 and Y.remove_islands(touching, 2, connectivity="edge").cells.count() == 0


def test_spectrum_of_one_wave(spark):
    n = 16
    rows = [("m", i, 0, 0, math.sin(2 * math.pi * 4 * i / n)) for i in range(n)]
    lattice = spark.createDataFrame(rows, "mesh_id string, i bigint, j bigint, k bigint, u double")
    got = {r["bin"]: r["power"] for r in X.grid_spectrum(lattice, "u", (n, 1, 1), 8).collect()}
    assert got[4] == pytest.approx(n / 2) and sum(v for b, v in got.items() if b != 4) == pytest.approx(0, abs=1e-9)


def test_lattices_agree_with_linear_fields(spark):
    nodes = X.lattice_points(spark.createDataFrame([("m",)], "mesh_id string"), (4, 3, 2), (0.0, 0.0, 0.0), (1.0, 2.0, 0.5)).withColumn("u", F.col("x") + 10 * F.col("y") - 4 * F.col("z"))
    fine = X.resample_grid(nodes.select("mesh_id", "i", "j", "k", "u"), ["u"], (0.0, 0.0, 0.0), (1.0, 2.0, 0.5), (7, 5, 2), (0.0, 0.0, 0.0), (0.5, 0.9, 0.5))
    off = fine.agg(F.max(F.abs(F.col("u") - (F.col("x") + 10 * F.col("y") - 4 * F.col("z")))), F.count("u")).first()
    assert off[0] < 1e-9 and off[1] == 70


def test_rings_of_a_walk(spark):
    m = A.plane(spark, divisions=(3, 2))
    start = spark.createDataFrame([("plane", 0)], "mesh_id string, point_id bigint")
    got = {r["point_id"]: (r["ring"], r["kept"]) for r in E.bistride(Y.adjacency(m.cells), start).collect()}
    assert got == {x + 4 * y: (x + y, (x + y) % 2 == 0) for x in range(4) for y in range(3)}


def test_times_come_from_the_best_source(spark):
    files = spark.createDataFrame([("d/out_10.vtu", [0.1, 0.2]), ("d/out_2.vtu", []), ("d/final.vtu", None), ("d/out_1.vtu", None)], "path string, held array<double>")
    got = [(r["path"][2:], r["time"], r["time_source"]) for r in Q.expand_steps(files, times="held", explicit={"d/out_1.vtu": 7.0}).orderBy("step").collect()]
    assert got == [("final.vtu", 0.0, "index"), ("out_1.vtu", 7.0, "explicit"), ("out_2.vtu", 2.0, "filename"), ("out_10.vtu", 0.1, "file"), ("out_10.vtu", 0.2, "file")]


def test_windows_that_ask_for_later_states(spark):
    rows = [("a", k, float(k * k)) for k in range(5)] + [("b", 0, 1.0)]
    states = spark.createDataFrame(rows, "key string, step int, v double")
    got = sorted((r["key"], r["states"], r["later"], r["target"]) for r in Q.state_windows(states, "key", ["step"], "v", 3, "time_conditional").collect())
    assert got == [("a", [0, 1, 4], 1, 9), ("a", [0, 1, 4], 2, 16)]
    with pytest.raises(ValueError):
        Q.state_windows(states, "key", ["step"], "v", 3, "other")


def test_names_of_options():
    for option, names in options.OPTIONS.items():
        for k, n in enumerate(names):
            assert options.parse(option, n) == n and options.name_of(option, options.place(option, n)) == n and options.place(option, n) == k
        with pytest.raises(ValueError, match=names[0]):
            options.parse(option, "no such name")
    assert options.region_op_from_name("intersect") == "intersection" and options.sdf_location_from_name("center") == "cell"
    assert options.tensor_invariant_from_name("von_mises, principal") == ["von_mises", "principal"]
    assert options.profile_features_from_text("extrude:5:symmetric;fillet:0.5") == [("extrude", ["5", "symmetric"]), ("fillet", ["0.5"])]


def test_steps_and_reports_are_checked(spark):
    m = A.plane(spark, divisions=(3, 2))
    fine = apply_step(m, {"op": "refine"})
    assert fine.cells.count() == 24 and report(fine, "watertight").first()["open"] == 20
    assert report(m, "partition", {"parts": 2}).groupBy("part").count().count() == 2
    for bad in ({"op": "mirror", "origin": [0, 0, 0]}, {"op": "nothing"}, {"op": "refine", "levels": 2}):
        with pytest.raises(ValueError):
            parse_pipeline({"version": 1, "steps": [bad]})
    for name, given in (("slice", {"origin": [0, 0, 0]}), ("nothing", {}), ("stats", {"more": 1})):
        with pytest.raises(ValueError):
            report(m, name, given)
