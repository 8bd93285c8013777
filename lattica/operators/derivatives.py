"""Gradient, divergence and curl on cells by the Green-Gauss rule, native: sums over facets or over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import divided, or_nan
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .geometry import with_measure
from .topology import facets

XYZ = ("x", "y", "z")


def _solid_terms(mesh: MeshFrame, names: list[str]) -> DataFrame:
    """One row for each triangle of a fan over each facet of a solid: its outward area vector (ax, ay, az) and the mean of each field on it.

    A facet of four nodes is four triangles about its middle, so warped facets
    count as both of their neighbours see them.
    """
    columns = [*XYZ, *names]
    rows = facets(mesh.cells).where(F.size("facet_nodes") >= 3).select(*CELL_KEYS, "facet", F.posexplode("facet_nodes").alias("k", "point_id"))
    placed = rows.join(mesh.points.select(*POINT_KEYS, *columns), POINT_KEYS)
    ring = placed.groupBy(*CELL_KEYS, "facet").agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("r"))
    n = F.size("r")
    mean = lambda c: F.aggregate("r", F.lit(0.0), lambda a, v: a + v[c]) / n
    ring = ring.withColumn("m", F.struct(*[mean(c).alias(c) for c in columns]))
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.col("r").getItem(k).alias("p"), F.col("r").getItem((k + 1) % n).alias("q")))
    fan = ring.select(*CELL_KEYS, "m", F.explode(sides).alias("s")).select(*CELL_KEYS, "m", "s.p", "s.q")
    u = {c: F.col(f"p.{c}") - F.col(f"m.{c}") for c in XYZ}
    v = {c: F.col(f"q.{c}") - F.col(f"m.{c}") for c in XYZ}
    area = {"x": (u["y"] * v["z"] - u["z"] * v["y"]) / 2, "y": (u["z"] * v["x"] - u["x"] * v["z"]) / 2, "z": (u["x"] * v["y"] - u["y"] * v["x"]) / 2}
    return fan.select(*CELL_KEYS, *[area[c].alias(f"a{c}") for c in XYZ], *[((F.col(f"p.{f}") + F.col(f"q.{f}") + F.col(f"m.{f}")) / 3).alias(f"f_{f}") for f in names])


def _plane_terms(mesh: MeshFrame, names: list[str]) -> DataFrame:
    """As ``_solid_terms`` for plane cells: one row for each edge, its outward normal in the cell's plane times its length."""
    columns = [*XYZ, *names]
    faces = mesh.with_corners(names).where(F.col("cell_type").isin("triangle", "quad"))
    c, n = F.col("corners"), F.size("corners")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(c.getItem(k).alias("p"), c.getItem((k + 1) % n).alias("q")))
    last = F.when(n == 4, c.getItem(3)).otherwise(c.getItem(2))
    first = F.when(n == 4, c.getItem(1)).otherwise(c.getItem(0))
    u = {a: c.getItem(2)[a] - c.getItem(0)[a] for a in XYZ}
    v = {a: last[a] - first[a] for a in XYZ}
    # triangle: (c2 - c0) x (c2 - c0) would vanish, so its second direction is c2 - c1
    v = {a: F.when(n == 4, v[a]).otherwise(c.getItem(2)[a] - c.getItem(1)[a]) for a in XYZ}
    u = {a: F.when(n == 4, u[a]).otherwise(c.getItem(1)[a] - c.getItem(0)[a]) for a in XYZ}
    normal = {"x": u["y"] * v["z"] - u["z"] * v["y"], "y": u["z"] * v["x"] - u["x"] * v["z"], "z": u["x"] * v["y"] - u["y"] * v["x"]}
    size = F.sqrt(sum((normal[a] ** 2 for a in XYZ), F.lit(0.0)))
    rows = faces.withColumn("n", F.struct(*[divided(normal[a], size).alias(a) for a in XYZ]))
    rows = rows.select(*CELL_KEYS, "n", F.explode(sides).alias("s")).select(*CELL_KEYS, "n", "s.p", "s.q")
    d = {a: F.col(f"q.{a}") - F.col(f"p.{a}") for a in XYZ}
    out = {"x": d["y"] * F.col("n.z") - d["z"] * F.col("n.y"), "y": d["z"] * F.col("n.x") - d["x"] * F.col("n.z"), "z": d["x"] * F.col("n.y") - d["y"] * F.col("n.x")}
    return rows.select(*CELL_KEYS, *[out[a].alias(f"a{a}") for a in XYZ], *[((F.col(f"p.{f}") + F.col(f"q.{f}")) / 2).alias(f"f_{f}") for f in names])


def _green_gauss(mesh: MeshFrame, names: list[str], parts: dict[str, Column]) -> DataFrame:
    terms = _solid_terms(mesh, names).unionByName(_plane_terms(mesh, names))
    sums = terms.groupBy(*CELL_KEYS).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    sized = sums.join(with_measure(mesh).select(*CELL_KEYS, F.abs("measure").alias("_w")), CELL_KEYS)
    return sized.select(*CELL_KEYS, *[or_nan(F.when(F.col("_w") > 0, F.col(k) / F.col("_w"))).alias(k) for k in parts])


def gradient_green_gauss(mesh: MeshFrame, name: str) -> DataFrame:
    """mesh_id, cell_id, gx, gy, gz: the sum over the facets of the mean of a point array times the outward area, over the measure; NaN on cells without extent."""
    return _green_gauss(mesh, [name], {f"g{c}": F.col(f"a{c}") * F.col(f"f_{name}") for c in XYZ})


def divergence(mesh: MeshFrame, vector: tuple[str, str, str]) -> DataFrame:
    """mesh_id, cell_id, divergence of three point arrays by the same rule."""
    return _green_gauss(mesh, list(dict.fromkeys(vector)), {"divergence": sum((F.col(f"a{c}") * F.col(f"f_{f}") for c, f in zip(XYZ, vector, strict=True)), F.lit(0.0))})


def curl(mesh: MeshFrame, vector: tuple[str, str, str]) -> DataFrame:
    """mesh_id, cell_id, rx, ry, rz: the curl of three point arrays by the same rule."""
    a = [F.col(f"a{c}") for c in XYZ]
    v = [F.col(f"f_{f}") for f in vector]
    return _green_gauss(mesh, list(dict.fromkeys(vector)), {"rx": a[1] * v[2] - a[2] * v[1], "ry": a[2] * v[0] - a[0] * v[2], "rz": a[0] * v[1] - a[1] * v[0]})
