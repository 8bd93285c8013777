"""Queries over a surface that the part table makes: its size, its heights and its values come from ``sf_dir``.

Parts in the order of their keys are the points of a square lattice, their
sizes the heights and their prices a field; cells are quads, or two triangles
for each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import MeshFrame
from ..operators import conformity as K
from ..operators import cotangent as L
from ..operators import datasets as E
from ..operators import derivatives as V
from ..operators import geometry as G
from ..operators import grids as X
from ..operators import measuring as M
from ..operators import refinement as R
from ..operators import sequences as Q
from ..operators import shapes as A
from ..operators import spatial as S
from ..operators import surfaces as U
from ..operators import topology as Y
from ..operators.generate import elevate, extrude
from ..sources.files import graph_lines
from .catalog import HEX, DIMS, query, rounded
from .meshes import cloud, lattice, table


def terrain(spark: SparkSession, sf_dir: str, triangles: bool = True) -> MeshFrame:
    """Heights p_size / 10 over a lattice of the largest square number of parts, with the arrays u (price) and w (size)."""
    part = table(spark, sf_dir, "part")
    n = math.isqrt(part.count())
    k = F.col("p_partkey")
    mesh = F.lit("terrain").alias("mesh_id")
    points = part.where(k < n * n).select(
        mesh, k.alias("point_id"), (k % n).cast("double").alias("x"), F.floor(k / n).cast("double").alias("y"), (F.col("p_size") / 10.0).alias("z"), F.col("p_retailprice").alias("u"), F.col("p_size").cast("double").alias("w")
    )
    c, m = F.col("id"), max(n - 1, 1)
    v = F.floor(c / m) * n + c % m
    ring = [v, v + 1, v + n + 1, v + n]
    quads = spark.range((n - 1) * (n - 1))
    node = lambda *at: F.array(*[ring[k].cast("bigint") for k in at])
    if triangles:
        halves = F.posexplode(F.array(node(0, 1, 2), node(0, 2, 3))).alias("k", "nodes")
        cells = quads.select(mesh, c.alias("c"), halves).select("mesh_id", (2 * F.col("c") + F.col("k")).alias("cell_id"), F.lit("triangle").alias("cell_type"), "nodes")
    else:
        cells = quads.select(mesh, c.alias("cell_id"), F.lit("quad").alias("cell_type"), node(0, 1, 2, 3).alias("nodes"))
    return MeshFrame(points, cells)


LAND = """
WITH n AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM part),
pts AS (SELECT p_partkey AS point_id, (p_partkey % n)::DOUBLE AS x, (p_partkey // n)::DOUBLE AS y, p_size / 10.0::DOUBLE AS z, p_retailprice AS u, p_size::DOUBLE AS w FROM part, n WHERE p_partkey < n * n),
quads AS (SELECT c AS cell_id, (c // (n - 1)) * n + c % (n - 1) AS v, n FROM (SELECT n, unnest(range((n - 1) * (n - 1))) AS c FROM n)),
rings AS (SELECT cell_id, [v, v + 1, v + n + 1, v + n] AS nodes FROM quads),
tris AS (SELECT 2 * cell_id + k AS cell_id, CASE WHEN k = 0 THEN [v, v + 1, v + n + 1] ELSE [v, v + n + 1, v + n] END AS nodes FROM quads, (SELECT unnest([0, 1]) AS k)),
tc AS (SELECT t.cell_id, t.nodes, a.x ax, a.y ay, a.z az, a.u au, a.w aw, b.x bx, b.y by_, b.z bz, b.u bu, b.w bw, c.x cx, c.y cy, c.z cz, c.u cu, c.w cw
  FROM tris t JOIN pts a ON t.nodes[1] = a.point_id JOIN pts b ON t.nodes[2] = b.point_id JOIN pts c ON t.nodes[3] = c.point_id),
normals AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM tc),
areas AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) / 2 AS area FROM normals)
"""
EDGES = """, sides AS (SELECT cell_id, nodes[k + 1] AS a, nodes[(k + 1) % 4 + 1] AS b FROM rings, (SELECT unnest(range(4)) AS k)),
links AS (SELECT DISTINCT a AS src, b AS dst FROM sides UNION SELECT b, a FROM sides)
"""


# Refinement


@query(LAND + """
SELECT 4 * cell_id + k AS cell_id, round(area / 4, 6) AS measure,
  round(CASE k WHEN 0 THEN 4*ax+bx+cx WHEN 1 THEN ax+4*bx+cx WHEN 2 THEN ax+bx+4*cx ELSE 2*(ax+bx+cx) END / 6, 6) AS cx,
  round(CASE k WHEN 0 THEN 4*ay+by_+cy WHEN 1 THEN ay+4*by_+cy WHEN 2 THEN ay+by_+4*cy ELSE 2*(ay+by_+cy) END / 6, 6) AS cy,
  round(CASE k WHEN 0 THEN 4*az+bz+cz WHEN 1 THEN az+4*bz+cz WHEN 2 THEN az+bz+4*cz ELSE 2*(az+bz+cz) END / 6, 6) AS cz
FROM areas, (SELECT unnest(range(4)) AS k)""")
def refine(spark, d):
    mesh = R.refine(terrain(spark, d))
    return rounded(G.with_measure(mesh).select("mesh_id", "cell_id", "measure").join(G.centroids(mesh), ["mesh_id", "cell_id"]).select("cell_id", "measure", "cx", "cy", "cz"))


@query(LAND + """SELECT (SELECT count(*) FROM pts) + (SELECT count(DISTINCT (least(a, b), greatest(a, b))) FROM
  (SELECT nodes[k + 1] AS a, nodes[(k + 1) % 3 + 1] AS b FROM tris, (SELECT unnest(range(3)) AS k))) AS points, round((SELECT sum(u) FROM pts), 2) + 0 AS old_u""")
def refine_points(spark, d):
    mesh = terrain(spark, d)
    fine = R.refine(mesh)
    old = mesh.points.agg(F.round(F.sum("u"), 2).alias("old_u"))
    return fine.points.agg(F.count(F.lit(1)).alias("points")).join(old)


@query(LAND + EDGES + """, used AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, sum((cell_id % 3 = 0)::INT) AS fine FROM sides GROUP BY 1, 2)
SELECT sum(CASE WHEN n = 1 THEN 1 + fine WHEN fine = 1 THEN 3 ELSE 0 END)::BIGINT AS boundary, 0::BIGINT AS non_manifold,
  sum((n = 2 AND fine = 1)::INT)::BIGINT AS hanging_points, sum((n = 2 AND fine = 1)::INT)::BIGINT AS hanging_edges, 0::BIGINT AS unwelded FROM used""")
def check_conformity(spark, d):
    mesh = R.refine(terrain(spark, d, False), F.col("cell_id") % 3 == 0)
    return K.check_conformity(mesh).drop("mesh_id").select(*[F.col(c).cast("bigint").alias(c) for c in ("boundary", "non_manifold", "hanging_points", "hanging_edges", "unwelded")])


@query(LAND + "SELECT point_id AS original_id, 1::BIGINT AS copies FROM pts, n WHERE x = n // 2 AND n > 2")
def split_interface(spark, d):
    mesh = terrain(spark, d, False)
    n = math.isqrt(table(spark, d, "part").count())
    side = mesh.cells.where(F.col("cell_id") % (n - 1) == n // 2 - 1).select("mesh_id", "cell_id", F.lit(1).alias("facet"))
    cut = K.split_interface(mesh, side)
    return cut.points.where("point_id <> original_id").groupBy("original_id").agg(F.count(F.lit(1)).alias("copies"))


@query(LAND + "SELECT cell_id, nodes[1] AS a, nodes[3] AS b, nodes[2] AS c FROM tris")
def orient(spark, d):
    cells = terrain(spark, d).cells
    n = F.col("nodes")
    mixed = cells.withColumn("nodes", F.when(F.col("cell_id") % 3 == 0, F.array(n.getItem(0), n.getItem(2), n.getItem(1))).otherwise(n))
    return K.orient(mixed).select("cell_id", *[n.getItem(k).alias(c) for k, c in enumerate("abc")])


@query(LAND + EDGES + """, kept AS (SELECT * FROM sides, n WHERE NOT (cell_id % (n - 1) = 1 AND cell_id // (n - 1) = 1)),
rim AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM kept GROUP BY 1, 2 HAVING count(*) = 1)
SELECT 2 * ((n - 1) * (n - 1) - 1) + 4 AS cells, n * n + 1 AS points, (SELECT count(*) FROM rim) - 4 AS open FROM n""")
def fill_holes(spark, d):
    mesh = terrain(spark, d, False)
    n = math.isqrt(table(spark, d, "part").count())
    hole = (F.col("cell_id") % (n - 1) == 1) & (F.floor(F.col("cell_id") / (n - 1)) == 1)
    torn = mesh.with_(cells=mesh.cells.where(~hole))
    whole = K.fill_holes(torn.with_(cells=K.triangulated(torn.cells)), 4)
    open_ = Y.watertight_check(whole.cells).select("open")
    counts = whole.cells.agg(F.count(F.lit(1)).alias("cells")).join(whole.points.agg(F.count(F.lit(1)).alias("points")))
    return counts.join(open_)


SHEET = 2.53


def _pierce(p: str, t: str) -> str:
    """SQL: whether an edge of triangle p passes through the inside of t; corners are a, b, c with x, y, z."""
    v = lambda s, k, c: f"{s}{k}{c}"
    e = {c: (f"({v(t, 'b', c)}-{v(t, 'a', c)})", f"({v(t, 'c', c)}-{v(t, 'a', c)})") for c in "xyz"}
    n = {"x": f"({e['y'][0]}*{e['z'][1]}-{e['z'][0]}*{e['y'][1]})", "y": f"({e['z'][0]}*{e['x'][1]}-{e['x'][0]}*{e['z'][1]})", "z": f"({e['x'][0]}*{e['y'][1]}-{e['y'][0]}*{e['x'][1]})"}
    tests = []
    for i, j in (("a", "b"), ("b", "c"), ("c", "a")):
        along = "(" + "+".join(f"{n[c]}*({v(p, j, c)}-{v(p, i, c)})" for c in "xyz") + ")"
        start = "(" + "+".join(f"{n[c]}*({v(p, i, c)}-{v(t, 'a', c)})" for c in "xyz") + ")"
        w = f"(-{start}/nullif({along},0))"
        hit = {c: f"({v(p, i, c)}+{w}*({v(p, j, c)}-{v(p, i, c)}))" for c in "xyz"}
        inside = []
        for q, r in (("a", "b"), ("b", "c"), ("c", "a")):
            f = {c: f"({v(t, r, c)}-{v(t, q, c)})" for c in "xyz"}
            g = {c: f"({hit[c]}-{v(t, q, c)})" for c in "xyz"}
            inside.append(f"({f['y']}*{g['z']}-{f['z']}*{g['y']})*{n['x']}+({f['z']}*{g['x']}-{f['x']}*{g['z']})*{n['y']}+({f['x']}*{g['y']}-{f['y']}*{g['x']})*{n['z']} > 0")
        tests.append(f"({along} <> 0 AND {w} > 0 AND {w} < 1 AND {' AND '.join(inside)})")
    return "coalesce(" + " OR ".join(tests) + ", false)"


@query(LAND + f""", land AS (SELECT cell_id AS cell_a, ax AS pax, ay AS pay, az AS paz, bx AS pbx, by_ AS pby, bz AS pbz, cx AS pcx, cy AS pcy, cz AS pcz FROM tc),
sheet AS (SELECT cell_id AS cell_b, ax + 0.37 AS qax, ay + 0.21 AS qay, {SHEET}::DOUBLE AS qaz, bx + 0.37 AS qbx, by_ + 0.21 AS qby, {SHEET}::DOUBLE AS qbz, cx + 0.37 AS qcx, cy + 0.21 AS qcy, {SHEET}::DOUBLE AS qcz FROM tc)
SELECT cell_a, cell_b FROM land JOIN sheet ON greatest(qax, qbx, qcx) >= least(pax, pbx, pcx) AND greatest(pax, pbx, pcx) >= least(qax, qbx, qcx)
  AND greatest(qay, qby, qcy) >= least(pay, pby, pcy) AND greatest(pay, pby, pcy) >= least(qay, qby, qcy)
WHERE least(paz, pbz, pcz) <= {SHEET} AND greatest(paz, pbz, pcz) >= {SHEET} AND ({_pierce('p', 'q')} OR {_pierce('q', 'p')})""")
def find_intersections(spark, d):
    mesh = terrain(spark, d)
    sheet = mesh.with_(points=mesh.points.withColumns({"x": F.col("x") + 0.37, "y": F.col("y") + 0.21, "z": F.lit(SHEET)}))
    return K.find_intersections(mesh, sheet).drop("mesh_id")


@query(LAND + "SELECT cell_id AS parent, 9::BIGINT AS pieces, round(area, 6) AS area FROM areas")
def tessellate(spark, d):
    pieces = R.tessellate(elevate(terrain(spark, d)), 3)
    c = F.col("corners")
    area = G.length(G.cross(G.minus(G.corner(c, 1), G.corner(c, 0)), G.minus(G.corner(c, 2), G.corner(c, 0)))) / 2
    return rounded(pieces.groupBy("parent").agg(F.count(F.lit(1)).alias("pieces"), F.sum(area).alias("area")))


@query(LAND + "SELECT cell_id AS parent, 36::BIGINT AS tets, 3.0::DOUBLE AS volume FROM rings")
def poly_to_tet(spark, d):
    """Hexahedra under the terrain, as polyhedra, as tetrahedra: the volume is that of the column."""
    solid = extrude(terrain(spark, d, False), (0.0, 0.0, 3.0))
    middles = G.centroids(solid).select("mesh_id", (-1 - F.col("cell_id")).alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    polyhedra = U.subdivide(solid)
    tets = R.poly_to_tet(polyhedra)
    numbered = tets.withColumn("cell_id", F.monotonically_increasing_id()).withColumn("cell_type", F.lit("tetra"))
    mesh = MeshFrame(solid.points.select("mesh_id", "point_id", "x", "y", "z").unionByName(middles), numbered)
    sized = G.with_measure(mesh)
    return rounded(sized.groupBy("parent").agg(F.count(F.lit(1)).alias("tets"), F.abs(F.sum("measure")).alias("volume")))


# Derivatives and curvature

GRADS = """, g AS (SELECT cell_id,
  (ny*(cz-bz)-nz*(cy-by_))/(4*area*area) AS px, (nz*(cx-bx)-nx*(cz-bz))/(4*area*area) AS py, (nx*(cy-by_)-ny*(cx-bx))/(4*area*area) AS pz,
  (ny*(az-cz)-nz*(ay-cy))/(4*area*area) AS qx, (nz*(ax-cx)-nx*(az-cz))/(4*area*area) AS qy, (nx*(ay-cy)-ny*(ax-cx))/(4*area*area) AS qz,
  (ny*(bz-az)-nz*(by_-ay))/(4*area*area) AS rx, (nz*(bx-ax)-nx*(bz-az))/(4*area*area) AS ry, (nx*(by_-ay)-ny*(bx-ax))/(4*area*area) AS rz, au, bu, cu, aw, bw, cw FROM areas),
d AS (SELECT cell_id, au*px+bu*qx+cu*rx AS ux, au*py+bu*qy+cu*ry AS uy, au*pz+bu*qz+cu*rz AS uz, aw*px+bw*qx+cw*rx AS wx, aw*py+bw*qy+cw*ry AS wy, aw*pz+bw*qz+cw*rz AS wz FROM g)
"""


@query(LAND + GRADS + "SELECT cell_id, round(ux, 6) AS gx, round(uy, 6) AS gy, round(uz, 6) AS gz FROM d")
def gradient_green_gauss(spark, d):
    return rounded(V.gradient_green_gauss(terrain(spark, d), "u").drop("mesh_id"))


@query(LAND + GRADS + "SELECT cell_id, round(ux + wy + uz, 6) AS divergence FROM d")
def divergence(spark, d):
    return rounded(V.divergence(terrain(spark, d), ("u", "w", "u")).drop("mesh_id"))


@query(LAND + GRADS + "SELECT cell_id, round(uy - wz, 6) AS rx, round(uz - ux, 6) AS ry, round(wx - uy, 6) AS rz FROM d")
def curl(spark, d):
    return rounded(V.curl(terrain(spark, d), ("u", "w", "u")).drop("mesh_id"))


@query(HEX + "SELECT c.cell_id, (2.25 + 1.5)::DOUBLE AS divergence FROM cells c")
def divergence_solid(spark, d):
    mesh = lattice(spark, DIMS)
    field = mesh.points.withColumns({"a": 2.25 * F.col("x"), "b": F.col("z") * 0.5, "c": 1.5 * F.col("z")})
    return rounded(V.divergence(mesh.with_(points=field), ("a", "b", "c")).drop("mesh_id"))


CORNERS = """, corners AS (
  SELECT nodes[1] AS p, ax px, ay py, az pz, bx qx, by_ qy, bz qz, cx rx, cy ry, cz rz, area FROM areas UNION ALL
  SELECT nodes[2], bx, by_, bz, cx, cy, cz, ax, ay, az, area FROM areas UNION ALL
  SELECT nodes[3], cx, cy, cz, ax, ay, az, bx, by_, bz, area FROM areas),
cots AS (SELECT *, ((qx-px)*(rx-px)+(qy-py)*(ry-py)+(qz-pz)*(rz-pz))/(2*area) AS cp, ((px-qx)*(rx-qx)+(py-qy)*(ry-qy)+(pz-qz)*(rz-qz))/(2*area) AS cq,
  ((px-rx)*(qx-rx)+(py-ry)*(qy-ry)+(pz-rz)*(qz-rz))/(2*area) AS cr, (qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz) AS pq2, (rx-px)*(rx-px)+(ry-py)*(ry-py)+(rz-pz)*(rz-pz) AS pr2 FROM corners)
"""


@query(LAND + CORNERS + """, s AS (SELECT p AS point_id, sum(CASE WHEN cp >= 0 AND cq >= 0 AND cr >= 0 THEN (pq2*cr + pr2*cq)/8 WHEN cp < 0 THEN area/2 ELSE area/4 END) AS area,
  sum(((qx-px)*cr+(rx-px)*cq)/2) AS lx, sum(((qy-py)*cr+(ry-py)*cq)/2) AS ly, sum(((qz-pz)*cr+(rz-pz)*cq)/2) AS lz FROM cots GROUP BY 1)
SELECT point_id, round(area, 6) AS area, round(sqrt(lx*lx+ly*ly+lz*lz)/(2*area), 6) AS mean FROM s""")
def mean_curvature(spark, d):
    return rounded(L.mean_curvature(terrain(spark, d)).select("point_id", "area", F.abs("mean").alias("mean")))


@query(LAND + EDGES + """, m1 AS (SELECT src, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM links JOIN pts ON dst = point_id GROUP BY src),
p1 AS (SELECT point_id, p.x + 0.5 * (m.x - p.x) AS x, p.y + 0.5 * (m.y - p.y) AS y, p.z + 0.5 * (m.z - p.z) AS z FROM pts p JOIN m1 m ON src = point_id),
m2 AS (SELECT src, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM links JOIN p1 ON dst = point_id GROUP BY src)
SELECT point_id, round(p.x - 0.53 * (m.x - p.x), 9) AS x, round(p.y - 0.53 * (m.y - p.y), 9) AS y, round(p.z - 0.53 * (m.z - p.z), 9) AS z FROM p1 p JOIN m2 m ON src = point_id""")
def smooth_taubin(spark, d):
    return rounded(Y.smooth(terrain(spark, d, False), 1, 0.5, back=-0.53).select("point_id", "x", "y", "z"), 9)


@query("SELECT mode, (floor(sqrt(mode)) * (floor(sqrt(mode)) + 1))::BIGINT AS level FROM (SELECT unnest(range(9)) AS mode)")
def laplacian_eigenmodes(spark, d):
    """The sphere's spectrum is l (l + 1), 2 l + 1 times each."""
    ball = A.sphere(spark, 1.0, 24, 16)
    mesh = ball.with_(cells=K.triangulated(ball.cells))
    found = L.laplacian_eigenmodes(mesh, 9)
    return found.groupBy("mode").agg(F.round(F.first("value")).cast("bigint").alias("level"))


@query("SELECT 24 * 15 + 2 AS points, true AS near_the_arc")
def geodesic_distance(spark, d):
    """From a pole of a sphere, against the arc."""
    ball = A.sphere(spark, 1.0, 24, 16)
    mesh = ball.with_(cells=K.triangulated(ball.cells))
    start = mesh.points.orderBy("z").limit(1).select("mesh_id", "point_id")
    found = L.geodesic_distance(mesh, start).join(mesh.points, ["mesh_id", "point_id"])
    arc = F.acos(F.least(F.greatest(-F.col("z"), F.lit(-1.0)), F.lit(1.0)))
    return found.agg(F.count(F.lit(1)).alias("points"), (F.max(F.abs(F.col("distance") - arc)) < 0.12).alias("near_the_arc"))


@query(HEX + f"""SELECT point_id, x + CASE x WHEN 0 THEN -0.25 WHEN {DIMS[0]} THEN 0.25 ELSE 0 END AS x, y + CASE y WHEN 0 THEN -0.25 WHEN {DIMS[1]} THEN 0.25 ELSE 0 END AS y, z + CASE z WHEN 0 THEN -0.25 WHEN {DIMS[2]} THEN 0.25 ELSE 0 END AS z
FROM pts WHERE x IN (0, {DIMS[0]}) OR y IN (0, {DIMS[1]}) OR z IN (0, {DIMS[2]})""")
def offset_surface_box(spark, d):
    """All faces of a box move by the distance, so its corners move along all three axes."""
    return rounded(U.offset_points(Y.surface_mesh(lattice(spark, DIMS)), 0.25).points.select("point_id", "x", "y", "z"))


# Primitives


@query("""SELECT i AS point_id, round((3 + cos(2*pi()*(i//24)/12)) * cos(2*pi()*(i%24)/24), 6) + 0.0 AS x, round((3 + cos(2*pi()*(i//24)/12)) * sin(2*pi()*(i%24)/24), 6) + 0.0 AS y, round(sin(2*pi()*(i//24)/12), 6) + 0.0 AS z FROM (SELECT unnest(range(288)) AS i)""")
def generate_torus(spark, d):
    points = rounded(A.generate(spark, "torus", radius=3.0, tube_radius=1.0, around=24, across=12).points.select("point_id", "x", "y", "z"))
    return points.select("point_id", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


@query("""WITH s AS (SELECT 2 * sin(pi()/24) AS chord, 24 * sin(2*pi()/24) / 2 AS base)
SELECT 'cone' AS kind, 48::BIGINT AS cells, 0::BIGINT AS open, round(base * 2 / 3, 6) AS volume FROM s UNION ALL
SELECT 'cylinder', 24 * 3 + 48, 0, round(base * 2, 6) FROM s UNION ALL
SELECT 'sphere', 24 * 10 + 48, 0, round((SELECT sum((sin(t+pi()/12)*sin(t+pi()/12)+sin(t)*sin(t)+sin(t)*sin(t+pi()/12))/3*(cos(t)-cos(t+pi()/12))) FROM (SELECT pi()*unnest(range(12))/12 AS t)) * base, 6) FROM s""")
def generate_closed(spark, d):
    out = None
    for kind, options in (("cone", {"height": 2.0, "around": 24}), ("cylinder", {"height": 2.0, "around": 24, "along": 3}), ("sphere", {"around": 24, "along": 12})):
        mesh = A.generate(spark, kind, **options)
        cells = mesh.cells.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("cells"))
        flat = mesh.with_(cells=K.triangulated(mesh.cells))
        c = F.col("corners")
        volume = flat.with_corners().agg((F.sum(G.dot(G.corner(c, 0), G.cross(G.corner(c, 1), G.corner(c, 2)))) / 6).alias("volume"))
        row = cells.join(Y.watertight_check(mesh.cells).select("open")).join(volume)
        out = row if out is None else out.unionByName(row)
    return rounded(out)


# Lattices and trees


@query(LAND + """, targets AS (SELECT point_id, x + 0.25 AS x, y + 0.5 AS y FROM pts, n WHERE x < n - 1 AND y < n - 1)
SELECT t.point_id, round(sum(p.u * (1 - abs(p.x - t.x)) * (1 - abs(p.y - t.y))), 6) AS u FROM targets t JOIN pts p ON p.x IN (floor(t.x), floor(t.x) + 1) AND p.y IN (floor(t.y), floor(t.y) + 1) GROUP BY 1""")
def scatter_grid(spark, d):
    mesh = terrain(spark, d)
    n = math.isqrt(table(spark, d, "part").count())
    nodes = mesh.points.select("mesh_id", F.col("x").cast("bigint").alias("i"), F.col("y").cast("bigint").alias("j"), F.lit(0).cast("bigint").alias("k"), "u")
    targets = mesh.points.where((F.col("x") < n - 1) & (F.col("y") < n - 1)).select("mesh_id", "point_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), F.lit(0.0).alias("z"))
    return rounded(X.scatter_grid(targets, nodes, ["u"], (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)).drop("mesh_id"))


@query(LAND + """, t AS (SELECT unnest(range((n - 1) * (n - 1))) AS i, n FROM n),
q AS (SELECT i AS point_id, (i % (n - 1))::DOUBLE + 0.5 AS x, (i // (n - 1))::DOUBLE + 0.25 AS y, n FROM t),
v AS (SELECT q.*, (floor(q.y) * n + floor(q.x))::BIGINT AS c FROM q)
SELECT v.point_id, true AS inside, round(a.u + (b.u - a.u) * 0.5 + (e.u - b.u) * 0.25, 6) AS u FROM v JOIN pts a ON a.point_id = c JOIN pts b ON b.point_id = c + 1 JOIN pts e ON e.point_id = c + n + 1""")
def sample_grid(spark, d):
    """Lattice nodes in the lower triangle of every square, at half and a quarter."""
    mesh = terrain(spark, d)
    n = math.isqrt(table(spark, d, "part").count())
    flat = mesh.with_(points=mesh.points.withColumn("z", F.lit(0.0)))
    found = X.sample_grid(flat, ["u"], (n - 1, n - 1, 1), (0.5, 0.25, 0.0), (1.0, 1.0, 1.0))
    return rounded(found.select("point_id", "inside", "u"))


TREE = """, boxes AS (SELECT least(ax, bx, cx) lx, greatest(ax, bx, cx) hx, least(ay, by_, cy) ly, greatest(ay, by_, cy) hy, least(az, bz, cz) lz, greatest(az, bz, cz) hz FROM tc),
levels AS (SELECT unnest(range(4)) AS level),
ranges AS (SELECT DISTINCT level, unnest(range(greatest(floor(lx * (1 << level) / n), 0)::BIGINT, least(floor(hx * (1 << level) / n), (1 << level) - 1)::BIGINT + 1)) AS i, ly, hy, lz, hz, n FROM boxes, levels, n),
ranges2 AS (SELECT DISTINCT level, i, unnest(range(greatest(floor(ly * (1 << level) / n), 0)::BIGINT, least(floor(hy * (1 << level) / n), (1 << level) - 1)::BIGINT + 1)) AS j, lz, hz, n FROM ranges),
touched AS (SELECT DISTINCT level, i, j, unnest(range(greatest(floor(lz * (1 << level) / n), 0)::BIGINT, least(floor(hz * (1 << level) / n), (1 << level) - 1)::BIGINT + 1)) AS k FROM ranges2),
cubes AS (SELECT 0 AS level, 0 AS i, 0 AS j, 0 AS k UNION ALL SELECT level + 1, 2 * i + o % 2, 2 * j + (o // 2) % 2, 2 * k + o // 4 FROM touched, (SELECT unnest(range(8)) AS o) WHERE level < 3)
"""


@query(LAND + TREE + """SELECT c.level, c.i, c.j, c.k, (t.level IS NOT NULL)::INT AS cut FROM cubes c LEFT JOIN touched t ON c.level = t.level AND c.i = t.i AND c.j = t.j AND c.k = t.k WHERE t.level IS NULL OR c.level = 3""")
def octree(spark, d):
    mesh = terrain(spark, d)
    n = math.isqrt(table(spark, d, "part").count())
    return X.octree(mesh.with_corners(), ((0.0, 0.0, 0.0), float(n)), 0, 3).drop("mesh_id")


# Graphs and data sets


@query(LAND + EDGES + """SELECT src, dst, round(s.x - t.x, 6) AS dx, round(s.y - t.y, 6) AS dy, round(s.z - t.z, 6) AS dz, round(sqrt((s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z)), 6) AS length
FROM links JOIN pts s ON src = s.point_id JOIN pts t ON dst = t.point_id""")
def edge_vectors(spark, d):
    mesh = terrain(spark, d, False)
    return rounded(E.edge_vectors(Y.adjacency(mesh.cells), mesh.points).drop("mesh_id"))


@query(LAND + EDGES + """SELECT a.point_id AS src, b.point_id AS dst FROM pts a JOIN pts b ON b.x BETWEEN a.x - 1.5 AND a.x + 1.5 AND b.y BETWEEN a.y - 1.5 AND a.y + 1.5 AND a.point_id <> b.point_id
WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 2.25 AND (a.point_id, b.point_id) NOT IN (SELECT (src, dst) FROM links)""")
def world_edges(spark, d):
    return E.world_edges(terrain(spark, d, False), 1.5).drop("mesh_id")


@query(LAND + EDGES + """, near AS (SELECT point_id, coalesce(string_agg((dst + 1)::VARCHAR, ' ' ORDER BY dst), '') AS value FROM pts LEFT JOIN links ON src = point_id GROUP BY point_id)
SELECT point_id + 1 AS line, value FROM near UNION ALL SELECT 0, (SELECT count(*) FROM pts)::VARCHAR || ' ' || ((SELECT count(*) FROM links) // 2)::VARCHAR""")
def write_graph_metis(spark, d):
    n = math.isqrt(table(spark, d, "part").count())
    return graph_lines(Y.adjacency(terrain(spark, d, False).cells), n * n)


@query(LAND + EDGES + """, near AS (SELECT point_id, count(dst) AS degree, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS others FROM pts LEFT JOIN links ON src = point_id GROUP BY point_id)
SELECT point_id + 3 AS line, concat_ws(' ', degree::VARCHAR, others) AS value FROM near UNION ALL SELECT 0, '0' UNION ALL
SELECT 1, (SELECT count(*) FROM pts)::VARCHAR || ' ' || (SELECT count(*) FROM links)::VARCHAR UNION ALL SELECT 2, '0 000'""")
def write_graph_scotch(spark, d):
    n = math.isqrt(table(spark, d, "part").count())
    return graph_lines(Y.adjacency(terrain(spark, d, False).cells), n * n, "scotch")


@query(LAND + """SELECT (SELECT count(*) FROM pts) AS points, (SELECT count(*) FROM pts WHERE point_id % 17 = 0) AS nan_entries, (SELECT count(*) FROM pts WHERE point_id % 17 = 1) AS inf_entries,
  (SELECT count(*) FROM tris) AS cells, 0::BIGINT AS inverted, 0::BIGINT AS empty""")
def dataset_health(spark, d):
    mesh = terrain(spark, d)
    k = F.pmod("point_id", F.lit(17))
    u = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("u"))
    return E.dataset_health(mesh.with_(points=mesh.points.withColumn("u", u))).drop("mesh_id").select("points", F.col("nan_entries").cast("bigint"), F.col("inf_entries").cast("bigint"), "cells", "inverted", "empty")


_MAP = E.augmentation(5, translate=2.0, scale=(0.5, 2.0))


@query(LAND + "SELECT point_id, " + ", ".join(f"round({r[0]!r}::DOUBLE * x + {r[1]!r}::DOUBLE * y + {r[2]!r}::DOUBLE * z + {r[3]!r}::DOUBLE, 6) AS {c}" for c, r in zip("xyz", _MAP, strict=False)) + " FROM pts")
def augment(spark, d):
    return rounded(E.augment(terrain(spark, d).points, 5, translate=2.0, scale=(0.5, 2.0)).select("point_id", "x", "y", "z"))


@query(LAND + "SELECT point_id, point_id AS original_id, u FROM pts ORDER BY md5('3:terrain:' || point_id::VARCHAR), point_id LIMIT 50")
def subsample_points(spark, d):
    return E.subsample_points(terrain(spark, d).points, 50, seed=3).select("point_id", "original_id", "u")


@query(LAND + "SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def inverse_spherical(spark, d):
    return rounded(G.inverse_spherical(G.convert_coordinates(terrain(spark, d).points, "spherical").drop("x", "y", "z")).select("point_id", "x", "y", "z"))


@query(LAND + "SELECT t.cell_id, nodes[1] AS a, nodes[3] AS b, nodes[2] AS c, round(10 - p.x, 6) AS x FROM tris t JOIN pts p ON nodes[1] = point_id")
def mirror_mesh(spark, d):
    mesh = G.mirror_mesh(terrain(spark, d), (5.0, 0.0, 0.0), (1.0, 0.0, 0.0))
    n = F.col("nodes")
    first = mesh.points.select("mesh_id", F.col("point_id").alias("a"), "x")
    rows = mesh.cells.select("mesh_id", "cell_id", *[n.getItem(k).alias(c) for k, c in enumerate("abc")])
    return rounded(rows.join(first, ["mesh_id", "a"]).select("cell_id", "a", "b", "c", "x"))


# Measuring


@query(LAND + """, v AS (SELECT z - 2.5 AS d FROM pts)
SELECT count(*) AS n, round(min(d), 6) AS min, round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, round(stddev_pop(d), 6) AS sigma,
  round(quantile_cont(d, 0.01), 6) AS p1, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99,
  round(avg((abs(d) <= 1.05)::INT), 6) AS within FROM v""")
def deviation_stats(spark, d):
    distances = terrain(spark, d).points.select("mesh_id", (F.col("z") - 2.5).alias("distance"))
    return rounded(M.deviation_stats(distances, tolerance=1.05).drop("mesh_id"))


@query(LAND + "SELECT least(greatest(floor((z - 2.5 + 2) / 4 * 20), 0), 19)::INT AS bin, count(*) AS n FROM pts GROUP BY 1")
def deviation_histogram(spark, d):
    distances = terrain(spark, d).points.select("mesh_id", (F.col("z") - 2.5).alias("distance"))
    return M.deviation_histogram(distances, -2.0, 2.0).drop("mesh_id")


@query(LAND + """, m AS (SELECT point_id % 5 AS element, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY 1)
SELECT 'gap' || a.element::VARCHAR AS name, round(sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)), 6) AS value,
  CASE WHEN sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m a JOIN m b ON b.element = 0 WHERE a.element > 0""")
def measure(spark, d):
    points = terrain(spark, d).points.withColumn("element", F.col("point_id") % 5)
    elements = M.fit_elements(points, kinds={k: "sphere_centre" for k in range(5)})
    spec = spark.createDataFrame([(f"gap{k}", "distance", k, 0, 0.0, -0.5, 0.5) for k in range(1, 5)], "name string, kind string, a bigint, b bigint, nominal double, low double, high double")
    return rounded(M.dimensions(elements, spec).select("name", "value", "verdict"))


# Far from the points


@query("""WITH c AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
q AS (SELECT id, x + 50 AS x, y - 7 AS y, z AS z FROM c WHERE id % 10 = 0),
d AS (SELECT q.id AS point_id, c.id AS other_id, (q.x-c.x)*(q.x-c.x)+(q.y-c.y)*(q.y-c.y)+(q.z-c.z)*(q.z-c.z) AS d2 FROM q, c)
SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY d2, other_id) AS rank, round(d2, 6) AS d2 FROM d QUALIFY rank <= 3""")
def neighbor_pairs_far(spark, d):
    """Queries far outside the cloud: each has its three nearest all the same."""
    points = cloud(spark, d)
    far = points.where("point_id % 10 = 0").withColumns({"x": F.col("x") + 50, "y": F.col("y") - 7})
    return rounded(S.k_nearest(far, points, 3, same=False).select("point_id", F.col("rank").cast("bigint").alias("rank"), "d2"))


@query("""WITH c AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings),
q AS (SELECT id, x + 50 AS x, y - 7 AS y, z AS z FROM c),
d AS (SELECT q.id AS point_id, c.label, (q.x-c.x)*(q.x-c.x)+(q.y-c.y)*(q.y-c.y)+(q.z-c.z)*(q.z-c.z) AS d2, c.id AS other FROM q, c)
SELECT point_id, arg_min(label, (d2, other)) AS label FROM d GROUP BY point_id""")
def interpolate_nearest_far(spark, d):
    points = cloud(spark, d)
    far = points.withColumns({"x": F.col("x") + 50, "y": F.col("y") - 7}).drop("label")
    return S.interpolate_nearest(far, points, ["label"]).select("point_id", "label")


# Steps


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS rn, lag(value, 3) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 1) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, rn - 3 AS first, a, b, c, value AS target FROM s WHERE rn >= 3""")
def state_windows(spark, d):
    found = Q.state_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 3)
    s = F.col("states")
    return found.select("user_id", "first", *[s.getItem(k).alias(c) for k, c in enumerate("abc")], "target")


@query("""WITH s AS (SELECT value, row_number() OVER w - 1 AS rn, lag(value, 2) OVER w AS b, lag(value, 1) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT * FROM s WHERE rn >= 2), x AS (SELECT b AS v FROM v UNION ALL SELECT c FROM v)
SELECT count(x.v) AS entries, round(avg(x.v), 6) AS mean, round(stddev_pop(x.v), 6) AS std, round((SELECT avg(value - c) FROM v), 6) AS change_mean, round((SELECT stddev_pop(value - c) FROM v), 6) AS change_std FROM x""")
def window_stats(spark, d):
    windows = Q.state_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 2)
    return rounded(Q.window_stats(windows, target="target"))


@query("""WITH e AS (SELECT user_id, count(*) AS n, list(value ORDER BY ts, event_id) AS l FROM events GROUP BY user_id HAVING count(*) > 4)
SELECT user_id, round(list_sum(l[1:4]), 6) AS states, n - 4 AS later, round(list_sum(l[5:]), 6) AS targets FROM e""")
def state_windows_one_shot(spark, d):
    found = Q.state_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 4, "one_shot")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c)
    return rounded(found.select("user_id", total("states"), F.size("targets").cast("bigint").alias("later"), total("targets")))


@query("""SELECT step, CASE WHEN b IS NULL THEN 'no target' WHEN a IS NULL THEN 'no source' ELSE 'times differ' END AS problem FROM
  (SELECT n_nationkey AS step, n_nationkey * 0.5::DOUBLE AS a FROM nation WHERE n_nationkey % 6 <> 1) FULL JOIN
  (SELECT n_nationkey AS step, n_nationkey * 0.5::DOUBLE + CASE WHEN n_nationkey % 7 = 2 THEN 0.25 ELSE 0 END AS b FROM nation WHERE n_nationkey % 5 <> 0) USING (step) WHERE a IS NULL OR b IS NULL OR abs(a - b) > 1e-9""")
def paired_check(spark, d):
    k = F.col("n_nationkey")
    steps = table(spark, d, "nation").select(k.alias("step"), (k * 0.5).alias("time"))
    source = steps.where("step % 6 <> 1")
    target = steps.where("step % 5 <> 0").withColumn("time", F.col("time") + F.when(F.col("step") % 7 == 2, 0.25).otherwise(0.0))
    return Q.paired_check(source, target)


@query("""SELECT 'run/' || CASE n_nationkey % 3 WHEN 0 THEN 'out_' || n_nationkey::VARCHAR WHEN 1 THEN 'out_' || n_nationkey::VARCHAR ELSE 'out_' || n_nationkey::VARCHAR END || '.vtu' AS path,
  row_number() OVER (ORDER BY n_nationkey) - 1 AS step, CASE WHEN n_nationkey = 3 THEN 99.5::DOUBLE ELSE n_nationkey::DOUBLE END AS time, CASE WHEN n_nationkey = 3 THEN 'explicit' ELSE 'filename' END AS time_source FROM nation""")
def expand_steps(spark, d):
    files = table(spark, d, "nation").select(F.concat(F.lit("run/out_"), F.col("n_nationkey").cast("string"), F.lit(".vtu")).alias("path"))
    return Q.expand_steps(files, explicit={"run/out_3.vtu": 99.5})


