"""Rules that the SQL comparison does not show."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.expression import compiled
from lattica.mesh import MeshFrame
from lattica.operators import data as D
from lattica.operators import filters as C
from lattica.operators import generate as N
from lattica.operators import geometry as G
from lattica.operators import kernels as K
from lattica.operators import ordering as O
from lattica.operators import regions as R
from lattica.operators import spatial as S
from lattica.operators import temporal as P
from lattica.operators import topology as Y
from lattica.plans.pipeline import parse_pipeline, run_pipeline


def cloud(spark, rows, mesh="m"):
    return spark.createDataFrame([(mesh, k, *map(float, p)) for k, p in enumerate(rows)], "mesh_id string, point_id bigint, x double, y double, z double")


def scattered(n, seed, size=1.0):
    rng = random.Random(seed)
    return [(rng.random() * size, rng.random() * size, rng.random() * size) for _ in range(n)]


class TestExpressions:
    def value(self, spark, text, **row):
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {'array<double>' if isinstance(v, list) else 'double'}" for k, v in row.items()))
        return df.select(compiled(text, df, {k: len(v) for k, v in row.items() if isinstance(v, list)}).alias("v")).first()[0]

    def test_arithmetic(self, spark):
        assert self.value(spark, "-a + 2 * (b - 1) / 4", a=1.0, b=3.0) == 0.0
        assert self.value(spark, "max(abs(a), sqrt(b))", a=-5.0, b=9.0) == 5.0
        assert self.value(spark, "`odd name` * 2", **{"odd name": 4.0}) == 8.0

    def test_ieee_division_and_nan(self, spark):
        assert self.value(spark, "a / b", a=1.0, b=0.0) == math.inf
        assert self.value(spark, "a / b", a=-1.0, b=0.0) == -math.inf
        assert math.isnan(self.value(spark, "a / b", a=0.0, b=0.0))
        assert math.isnan(self.value(spark, "min(a, b)", a=math.nan, b=1.0))
        assert math.isnan(self.value(spark, "sqrt(a)", a=-1.0))

    def test_components(self, spark):
        assert self.value(spark, "v * a", v=[1.0, 2.0], a=3.0) == [3.0, 6.0]
        assert self.value(spark, "norm(v)", v=[3.0, 4.0]) == 5.0
        with pytest.raises(ValueError):
            self.value(spark, "v + w", v=[1.0, 2.0], w=[1.0, 2.0, 3.0])

    @pytest.mark.parametrize("text", ["1 +", "(1", "min(1)", "1 $ 2", "(" * 70 + "1" + ")" * 70])
    def test_errors(self, spark, text):
        with pytest.raises(ValueError):
            self.value(spark, text, a=1.0)

    def test_unknown_name(self, spark):
        with pytest.raises(KeyError):
            self.value(spark, "b", a=1.0)


def test_arrays_are_checked_by_name(spark):
    df = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0, 5, 6)], "mesh_id string, point_id bigint, x double, y double, z double, a int, b int")
    with pytest.raises(KeyError):
        D.data_keep(df, ["c"])
    assert D.arrays_of(D.data_keep(df, ["c"], True)) == []
    with pytest.raises(ValueError):
        D.data_rename(df, {"a": "b"})
    swapped = D.data_rename(df, {"a": "b", "b": "a"}).first()
    assert (swapped["a"], swapped["b"]) == (6, 5)


def test_constant_and_not_finite_values(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (math.nan,)], "v double")
    lo = [r.v for r in D.data_condition(df, "v", "normalize", 3, 4).collect()]
    assert lo[:2] == [3.0, 3.0] and math.isnan(lo[2])
    zero = [r.v for r in D.data_condition(df, "v", "standardize").collect()]
    assert zero[:2] == [0.0, 0.0] and math.isnan(zero[2])
    assert math.isnan(D.data_condition(df, "v", "clamp", 0, 1).collect()[2].v)
    with pytest.raises(Exception):
        D.nan_policy(df, "v", "fail").collect()


def test_comparison_never_passes_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "v double")
    for op in ("<", "<=", ">", ">=", "==", "!="):
        assert all(r.v == 1.0 for r in df.where(C.comparison("v", op, 0)).collect())


def test_averages_skip_what_is_not_finite(spark):
    points = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)]).withColumn("v", F.when(F.col("point_id") == 0, float("nan")).otherwise(F.col("point_id").cast("double")))
    cells = spark.createDataFrame([("m", 0, "triangle", [0, 1, 2]), ("m", 1, "line", [0, 0])], "mesh_id string, cell_id bigint, cell_type string, nodes array<bigint>")
    got = {r.cell_id: r.v for r in D.point_data_to_cell_data(MeshFrame(points, cells), ["v"]).collect()}
    assert got[0] == 1.5 and math.isnan(got[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_radius_and_nearest_against_all_pairs(spark, seed):
    rows = scattered(150, seed)
    df = cloud(spark, rows)
    p = np.array(rows)
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.15**2}
    assert {(r.a, r.b) for r in S.bucketed_pairs(df, 0.15).collect()} == want
    near = {(r.point_id, r.rank): r.other_id for r in S.k_nearest(df, df, 5).collect()}
    for i in range(150):
        order = sorted((d[i, j], j) for j in range(150) if j != i)[:5]
        assert [near[i, k + 1] for k in range(5)] == [j for _, j in order]


@pytest.mark.parametrize("radius", [0.05, 0.3, 0.5])
def test_periodic_pairs_of_points_outside_the_box(spark, radius):
    rows = [(3 * x - 1.5, 3 * y - 1.5, 3 * z - 1.5) for x, y, z in scattered(60, 5)] + [(1.2, 0, 0), (0.21, 1, -1), (-0.8, 0, 0)]
    lesser = lambda d: min(d, 1 - d) ** 2
    want = {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i < j and sum(lesser(abs(a - b)) for a, b in zip(p, q, strict=True)) <= radius * radius}
    got = [(r.a, r.b) for r in S.periodic_pairs(cloud(spark, rows), radius, (1.0, 1.0, 1.0)).collect()]
    assert (60, 61) in want and len(got) == len(set(got)) and set(got) == want


def test_few_points_have_few_neighbours(spark):
    df = cloud(spark, [(0, 0, 0), (9, 9, 9)])
    assert [(r.point_id, r.other_id) for r in S.k_nearest(df, df, 4).orderBy("point_id").collect()] == [(0, 1), (1, 0)]


def test_weld_is_greedy(spark):
    df = cloud(spark, [(0, 0, 0), (0.6, 0, 0), (1.2, 0, 0), (1.8, 0, 0), (5, 5, 5)])
    assert [r.target for r in C.weld_map(df, 1.0).orderBy("point_id").collect()] == [0, 0, 2, 2, 4]


def test_weld_against_one_by_one(spark):
    rows = scattered(120, 5)
    reps, want = [], []
    for k, p in enumerate(rows):
        hit = next((r for r in reps if math.dist(rows[r], p) <= 0.2), None)
        want.append(k if hit is None else hit)
        if hit is None:
            reps.append(k)
    assert [r.target for r in C.weld_map(cloud(spark, rows), 0.2).orderBy("point_id").collect()] == want


def test_volume_and_area_are_kept(spark):
    mesh = N.grid(spark, (3, 2, 2), spacing=(0.5, 1.5, 2.0))
    volume = lambda m: G.with_measure(m).agg(F.sum("measure")).first()[0]
    assert volume(mesh) == pytest.approx(12 * 1.5)
    assert volume(mesh.with_(cells=N.simplexify(mesh.cells))) == pytest.approx(18)
    turned = mesh.with_(points=G.transform(mesh.points, G.composed(G.translation(4, 5, 6), G.rotation((1, 2, 3), 33))))
    assert volume(turned) == pytest.approx(18)
    assert volume(mesh.with_(cells=C.flip_normals(mesh.cells))) == pytest.approx(-18)
    mirrored = mesh.with_(points=G.mirror(mesh.points, (1, 1, 1), (1, 2, 3)))
    assert volume(mirrored) == pytest.approx(-18)
    skin = Y.surface_mesh(mesh)
    assert volume(skin) == pytest.approx(2 * (1.5 * 3 + 1.5 * 4 + 3 * 4))


def test_gradient_is_exact_for_linear_fields(spark):
    mesh = N.grid(spark, (2, 2, 2), spacing=(1.0, 0.5, 2.0))
    field = mesh.with_(points=G.transform(mesh.points, G.rotation((1, 1, 0), 20)).withColumn("u", 2 * F.col("x") - 3 * F.col("y") + 0.5 * F.col("z")))
    for r in G.gradient(field, "u").collect():
        assert (r.gx, r.gy, r.gz) == pytest.approx((2, -3, 0.5))


def test_wedge_pyramid_and_revolved_volume(spark):
    tri = MeshFrame(cloud(spark, [(1, 0, 0), (2, 0, 0), (1, 1, 0)]), spark.createDataFrame([("m", 0, "triangle", [0, 1, 2])], "mesh_id string, cell_id bigint, cell_type string, nodes array<bigint>"))
    wedge = N.extrude(tri, (0, 0, 3), 2)
    assert G.with_measure(wedge).agg(F.sum("measure")).first()[0] == pytest.approx(1.5)
    ring = N.revolve(tri, 360, 180)
    total = abs(G.with_measure(ring).agg(F.sum("measure")).first()[0])
    assert total == pytest.approx(2 * math.pi * (4 / 3) * 0.5, rel=1e-2)


def test_total_angle_defect_of_a_sphere_like_surface(spark):
    skin = Y.surface_mesh(N.grid(spark, (3, 3, 3)))
    flat = skin.with_(cells=N.simplexify(skin.cells.select("mesh_id", "cell_id", "cell_type", "nodes")))
    assert G.angle_defect(flat).agg(F.sum("defect")).first()[0] == pytest.approx(4 * math.pi)


def test_hilbert_curve_moves_one_step_at_a_time(spark):
    n = 8
    pts = [(i, j, k) for i in range(n) for j in range(n) for k in range(n)]
    df = spark.createDataFrame([("m", a, x, y, z) for a, (x, y, z) in enumerate(pts)], "mesh_id string, point_id bigint, qx bigint, qy bigint, qz bigint")
    order = [(r.qx, r.qy, r.qz) for r in O.with_hilbert(df).orderBy("hilbert").collect()]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))


def test_numbers_across_partitions(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    rows = [(f"m{rng.randrange(3)}", k, rng.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "mesh_id string, point_id bigint, v int").repartition(7)
    got = {(r.mesh_id, r.point_id): (r.n, r.n_of) for r in O.numbered(df, ["v", "point_id"], "n").collect()}
    w = Window.partitionBy("mesh_id")
    want = df.select("mesh_id", "point_id", F.row_number().over(w.orderBy("v", "point_id")) - 1, F.count(F.lit(1)).over(w)).collect()
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in want}
    assert O.numbered(df.limit(0), ["v"], "n").count() == 0


def test_farthest_points_are_greedy(spark):
    rows = scattered(60, 3)
    got = [r.point_id for r in O.farthest_points(cloud(spark, rows), 6, 0).orderBy("step").collect()]
    p, want = np.array(rows), [0]
    d = ((p - p[0]) ** 2).sum(1)
    for _ in range(5):
        k = int(np.argmax(d))
        want.append(k)
        d = np.minimum(d, ((p - p[k]) ** 2).sum(1))
    assert got == want


def test_region_algebra(spark):
    rows = [("m", "cell", n, 2, 0, e) for n, es in (("a", [1, 2, 3]), ("b", [2, 3, 4])) for e in es]
    regions = spark.createDataFrame(rows, "mesh_id string, kind string, name string, dim int, tag bigint, entity bigint")
    entries = lambda op, names: sorted(r.entity for r in R.region(R.combine(regions, op, "cell", names, "c"), "cell", "c").collect())
    assert entries("union", ["a", "b"]) == [1, 2, 3, 4]
    assert entries("intersection", ["a", "b"]) == [2, 3]
    assert entries("difference", ["a", "b"]) == [1] and entries("difference", ["b", "a"]) == [4]
    with pytest.raises(Exception):
        R.find_region(regions, "cell").collect()


def test_resample_at_and_beyond_the_ends(spark):
    steps = spark.createDataFrame([("k", 0, 0.0, 1.0, 10), ("k", 1, 2.0, 3.0, 20)], "key string, step bigint, time double, v double, n int")
    targets = spark.createDataFrame([("k", t) for t in (-1.0, 0.0, 0.5, 1.5, 2.0, 9.0)], "key string, target double")
    got = [(r.v, r.n) for r in P.resample(steps, ["v", "n"], targets, ["key"]).orderBy("target").collect()]
    assert got == [(1.0, 10), (1.0, 10), (1.5, 10), (2.5, 20), (3.0, 20), (3.0, 20)]
    with pytest.raises(Exception):
        P.resample(steps, ["v"], targets, ["key"], outside="error").collect()


def test_components_of_a_long_chain(spark):
    from lattica.operators.components import connected_components

    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 900} and got[200] == 0


def test_sphere_and_plane_are_recognised(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=(200, 3))
    s = 2 * s / np.linalg.norm(s, axis=1, keepdims=True) + [1, 2, 3]
    flat = np.c_[rng.random((200, 2)), np.full(200, 0.25)]
    df = cloud(spark, [*s, *flat]).withColumn("patch", (F.col("point_id") >= 200).cast("int"))
    got = {r.patch: r for r in K.fit_primitives(df).collect()}
    assert got[0].kind == "sphere" and got[0].params == pytest.approx([1, 2, 3, 2], abs=1e-6)
    assert got[1].kind == "plane" and abs(got[1].params[5]) == pytest.approx(1)


def test_hull_against_every_direction(spark):
    rows = [(x, y, 0) for x, y, _ in scattered(200, 8)]
    hull = {r.point_id for r in K.convex_hull_2d(cloud(spark, rows)).collect()}
    p = np.array(rows)[:, :2]
    for a in np.linspace(0, 2 * np.pi, 720):
        assert int(np.argmax(p @ [math.cos(a), math.sin(a)])) in hull


def test_normals_of_a_plane(spark):
    rows = [(x, y, 0.5) for x, y, _ in scattered(80, 2)]
    got = K.estimate_normals(cloud(spark, rows), 8, viewpoint=(0, 0, 9)).collect()
    assert all((r.nx, r.ny, r.nz) == pytest.approx((0, 0, 1), abs=1e-9) for r in got)


def test_pipeline_settings_are_checked_first(spark):
    for bad in ({"version": 2, "steps": []}, {"steps": [{"op": "none"}]}, {"steps": [{"op": "crop"}]}, {"steps": [{"op": "prune", "x": 1}]}):
        with pytest.raises(ValueError):
            parse_pipeline(bad)
    steps = '{"steps": [{"op": "simplexify"}, {"op": "surface"}, {"op": "data_calc", "location": "point", "output": "r", "expression": "sqrt(x)"}]}'
    with pytest.raises(KeyError):
        run_pipeline(N.grid(spark, (2, 2, 2)), steps.replace("sqrt(x)", "nothing"))
    assert run_pipeline(N.grid(spark, (2, 2, 2)), steps.split(', {"op": "data_calc"')[0] + "]}").cells.count() == 48


def test_stream_of_windows(spark, small, tmp_path):
    from lattica.streaming.windows import windowed

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.event_type, str(r.start), r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("w")) == key(windowed(events, "1 day"))


def test_world_edges_send_no_table_to_the_driver(spark):
    from lattica.operators.datasets import world_edges

    grid = N.grid(spark, (5, 4))
    points = grid.points.withColumn("z", F.pmod(F.col("point_id") * 7, F.lit(4)) * 0.2)
    out = world_edges(grid.with_(points=points), 1.5)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    at = {r.point_id: (r.x, r.y, r.z) for r in points.collect()}
    joined = {(r.src, r.dst) for r in Y.adjacency(grid.cells).collect()}
    want = {(i, j) for i, p in at.items() for j, q in at.items() if i != j and sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= 2.25 and (i, j) not in joined}
    got = [(r.src, r.dst) for r in out.collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
