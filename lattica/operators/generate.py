"""Lattices, templates, extrusion, sections and level sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..celltypes import EDGES, ELEVATED, LINEAR, SIMPLEX_TYPE, SIMPLICES, by_type, corner_count, tuples
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .filters import pruned
from .ordering import numbered
from .topology import unique_edges

#: Cells up to which a lattice is made unless the caller raises it.
MAX_CELLS = 50_000_000


def grid(
    spark: SparkSession, dims: tuple[int, ...], origin: tuple[float, ...] = (0.0, 0.0, 0.0), spacing: tuple[float, ...] = (1.0, 1.0, 1.0), mesh_id: str = "grid", max_cells: int = MAX_CELLS
) -> MeshFrame:
    """A lattice of hexahedra (three dims) or quads (two): ids run along x, then y, then z."""
    nx, ny, nz = (*dims, 0)[:3]
    flat = len(dims) == 2
    n = nx * ny * (1 if flat else nz)
    if n > max_cells:
        raise ValueError(f"{n} cells are over {max_cells}")
    i, px, py = F.col("id"), nx + 1, ny + 1
    points = spark.range(px * py * (1 if flat else nz + 1)).select(
        F.lit(mesh_id).alias("mesh_id"),
        i.alias("point_id"),
        (origin[0] + spacing[0] * (i % px)).alias("x"),
        (origin[1] + spacing[1] * (F.floor(i / px) % py)).alias("y"),
        (origin[2] + spacing[2] * F.floor(i / (px * py))).cast("double").alias("z"),
    )
    ci, cj, ck = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    v = (ck * py + cj) * px + ci
    ring = [v, v + 1, v + px + 1, v + px]
    nodes = ring if flat else ring + [r + px * py for r in ring]
    cells = spark.range(n).select(
        F.lit(mesh_id).alias("mesh_id"), i.alias("cell_id"), F.lit("quad" if flat else "hexahedron").alias("cell_type"), F.array(*[c.cast("bigint") for c in nodes]).alias("nodes")
    )
    return MeshFrame(points, cells)


def linearize(mesh: MeshFrame) -> MeshFrame:
    """Cells on their corners alone; middle nodes that nothing else uses go."""
    t = F.col("cell_type")
    nodes = F.slice("nodes", 1, F.coalesce(corner_count(t), F.size("nodes")))
    cells = mesh.cells.withColumn("nodes", nodes).withColumn("cell_type", by_type(t, LINEAR, F.lit, t))
    return pruned(mesh.with_(cells=cells))


def simplexify(cells: DataFrame) -> DataFrame:
    """Every cell as simplices of its dimension, with ``parent`` and its data; numbered by parent and place."""
    t = F.col("cell_type")
    parts = cells.select("*", F.posexplode(tuples(t, F.col("nodes"), SIMPLICES)).alias("_k", "_nodes"))
    kind = F.when(F.size("_nodes") == 2, SIMPLEX_TYPE[1]).when(F.size("_nodes") == 3, SIMPLEX_TYPE[2]).otherwise(SIMPLEX_TYPE[3])
    out = parts.withColumn("parent", F.col("cell_id")).withColumn("cell_type", kind).withColumn("nodes", F.col("_nodes"))
    return numbered(out, ["parent", "_k"], "cell_id").drop("_k", "_nodes", "cell_id_of")


def elevate(mesh: MeshFrame) -> MeshFrame:
    """Quadratic cells: one new node in the middle of every distinct edge, numbered after the points by the edge's ends."""
    last = mesh.points.groupBy("mesh_id").agg(F.max("point_id").alias("_last"))
    rows = numbered(unique_edges(mesh.cells).select("mesh_id", "lo", "hi"), ["lo", "hi"], "_number")
    mids = rows.join(F.broadcast(last), "mesh_id").select("mesh_id", "lo", "hi", (F.col("_last") + 1 + F.col("_number")).alias("mid"))
    ends = mesh.points.select("mesh_id", "point_id", "x", "y", "z")
    a = ends.select("mesh_id", F.col("point_id").alias("lo"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = ends.select("mesh_id", F.col("point_id").alias("hi"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    new = mids.join(a, ["mesh_id", "lo"]).join(b, ["mesh_id", "hi"]).select("mesh_id", F.col("mid").alias("point_id"), *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])
    pairs = mesh.cells.select(*CELL_KEYS, F.posexplode(tuples(F.col("cell_type"), F.col("nodes"), EDGES)).alias("k", "e"))
    pairs = pairs.select(*CELL_KEYS, "k", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"))
    added = pairs.join(mids, ["mesh_id", "lo", "hi"]).groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("k", "mid"))).alias("_m"))
    t = F.col("cell_type")
    cells = mesh.cells.join(added, CELL_KEYS, "left").withColumn("nodes", F.when(F.col("_m").isNotNull(), F.concat("nodes", F.col("_m.mid"))).otherwise(F.col("nodes")))
    return mesh.with_(points=mesh.points.unionByName(new, allowMissingColumns=True), cells=cells.withColumn("cell_type", by_type(t, ELEVATED, F.lit, t)).drop("_m"))


def extrude(mesh: MeshFrame, direction: tuple[float, float, float], layers: int = 1, ratio: float = 1.0) -> MeshFrame:
    """Lines, triangles and quads swept along a direction: quads, wedges and hexahedra, layer by layer, steps growing by ``ratio``."""
    sizes = mesh.points.groupBy("mesh_id").agg((F.max("point_id") + 1).alias("_np"))
    counts = mesh.cells.groupBy("mesh_id").agg((F.max("cell_id") + 1).alias("_nc"))
    share = [k / layers if ratio == 1 else (ratio**k - 1) / (ratio**layers - 1) for k in range(layers + 1)]
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(share)])
    points = mesh.points.join(F.broadcast(sizes), "mesh_id").withColumn("_l", F.explode(levels))
    points = points.withColumn("point_id", F.col("point_id") + F.col("_l.k") * F.col("_np")).withColumns({c: F.col(c) + F.col("_l.t") * d for c, d in zip("xyz", direction, strict=True)}).drop("_l", "_np")
    cells = mesh.cells.join(F.broadcast(sizes), "mesh_id").join(F.broadcast(counts), "mesh_id").withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(layers)])))
    low = F.transform("nodes", lambda n: n + F.col("_k") * F.col("_np"))
    high = F.transform("nodes", lambda n: n + (F.col("_k") + 1) * F.col("_np"))
    t = F.col("cell_type")
    kind = F.when(t == "line", "quad").when(t == "triangle", "wedge").when(t == "quad", "hexahedron")
    nodes = F.when(t == "line", F.concat(low, F.reverse(high))).otherwise(F.concat(low, high))
    cells = cells.withColumn("nodes", nodes).withColumn("layer", F.col("_k")).withColumn("cell_id", F.col("cell_id") + F.col("_k") * F.col("_nc"))
    return MeshFrame(points, cells.withColumn("cell_type", kind).drop("_k", "_np", "_nc"))


def revolve(mesh: MeshFrame, angle: float = 360.0, layers: int = 16) -> MeshFrame:
    """Plane cells turned about the y axis in equal steps; a full turn closes on itself. Points must be off the axis."""
    sizes = mesh.points.groupBy("mesh_id").agg((F.max("point_id") + 1).alias("_np"))
    counts = mesh.cells.groupBy("mesh_id").agg((F.max("cell_id") + 1).alias("_nc"))
    closed = abs(angle) == 360
    turns = [math.radians(angle * k / layers) for k in range(layers if closed else layers + 1)]
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for k, a in enumerate(turns)])
    p = mesh.points.join(F.broadcast(sizes), "mesh_id").withColumn("_l", F.explode(levels))
    c, s = F.col("_l.c"), F.col("_l.s")
    x, z = F.col("x") * c + F.col("z") * s, F.col("z") * c - F.col("x") * s
    points = p.withColumns({"x": x, "z": z, "point_id": F.col("point_id") + F.col("_l.k") * F.col("_np")}).drop("_l", "_np")
    cells = mesh.cells.join(F.broadcast(sizes), "mesh_id").join(F.broadcast(counts), "mesh_id").withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(layers)])))
    after = (F.col("_k") + 1) % layers if closed else F.col("_k") + 1
    low = F.transform("nodes", lambda n: n + F.col("_k") * F.col("_np"))
    high = F.transform("nodes", lambda n: n + after * F.col("_np"))
    t = F.col("cell_type")
    kind = F.when(t == "line", "quad").when(t == "triangle", "wedge").when(t == "quad", "hexahedron")
    nodes = F.when(t == "line", F.concat(low, F.reverse(high))).otherwise(F.concat(low, high))
    cells = cells.withColumn("nodes", nodes).withColumn("layer", F.col("_k")).withColumn("cell_id", F.col("cell_id") + F.col("_k") * F.col("_nc"))
    return MeshFrame(points, cells.withColumn("cell_type", kind).drop("_k", "_np", "_nc"))


def subdivide_quads(mesh: MeshFrame) -> DataFrame:
    """Every quad as four triangles about its middle: mesh_id, parent, k, and the two ends of the edge under the middle."""
    t = F.col("cell_type")
    return mesh.cells.where("cell_type = 'quad'").select("mesh_id", F.col("cell_id").alias("parent"), F.posexplode(tuples(t, F.col("nodes"), EDGES)).alias("k", "ends"))


def level_crossings(mesh: MeshFrame, value: Column, level: float) -> DataFrame:
    """Points where ``value`` (over point columns) takes ``level`` on the distinct edges of the simplices.

    mesh_id, lo, hi, t (from lo to hi), x, y, z. A node with d < 0 is below, so
    an edge crosses when exactly one of its ends is.
    """
    d = mesh.points.select(*POINT_KEYS, "x", "y", "z", (value - F.lit(level)).alias("d"))
    e = unique_edges(simplexify(mesh.cells)).select("mesh_id", "lo", "hi")
    a = d.select("mesh_id", F.col("point_id").alias("lo"), *[F.col(c).alias(f"a{c}") for c in "xyzd"])
    b = d.select("mesh_id", F.col("point_id").alias("hi"), *[F.col(c).alias(f"b{c}") for c in "xyzd"])
    rows = e.join(a, ["mesh_id", "lo"]).join(b, ["mesh_id", "hi"]).where("(ad < 0) <> (bd < 0)")
    t = F.col("ad") / (F.col("ad") - F.col("bd"))
    return rows.withColumn("t", t).select("mesh_id", "lo", "hi", "t", *[(F.col(f"a{c}") + F.col("t") * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xyz"])


def isosurface(mesh: MeshFrame, value: Column, level: float) -> DataFrame:
    """Marching simplices: one row for each polygon, mesh_id, parent (simplex), and its crossed edges as an array of (lo, hi) in ring order.

    A triangle is cut in a segment, a tetrahedron in a triangle or a quad.
    """
    d = mesh.points.select(*POINT_KEYS, (value - F.lit(level)).alias("d"))
    simplices = simplexify(mesh.cells).withColumnRenamed("cell_id", "simplex")
    corners = simplices.select("mesh_id", "simplex", F.posexplode("nodes").alias("k", "point_id")).join(d, POINT_KEYS)
    sides = corners.groupBy("mesh_id", "simplex").agg(
        F.array_sort(F.collect_list(F.when(F.col("d") < 0, F.col("point_id")))).alias("below"), F.array_sort(F.collect_list(F.when(F.col("d") >= 0, F.col("point_id")))).alias("above")
    )
    cut = sides.where("size(below) > 0 and size(above) > 0")
    # rings: below x above, walked around (b0 a0, b0 a1, b1 a1, b1 a0)
    edge = lambda b, a: F.array(F.least(b, a), F.greatest(b, a))
    below, above = F.col("below"), F.col("above")
    one_b = F.transform(above, lambda a: edge(below.getItem(0), a))
    one_a = F.transform(below, lambda b: edge(b, above.getItem(0)))
    two = F.array(*[edge(below.getItem(i), above.getItem(j)) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0))])
    ring = F.when(F.size("below") == 1, one_b).when(F.size("above") == 1, one_a).otherwise(two)
    return cut.select("mesh_id", "simplex", ring.alias("ring"))


def plane_distance(origin: tuple[float, float, float], normal: tuple[float, float, float]) -> Column:
    n = math.sqrt(sum(a * a for a in normal))
    return sum(((F.col(c) - o) * (a / n) for c, o, a in zip("xyz", origin, normal, strict=True)), F.lit(0.0))


def slice_mesh(mesh: MeshFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """``isosurface`` of the distance to a plane."""
    return isosurface(mesh, plane_distance(origin, normal), 0.0)
