"""Refinement: cells into smaller ones of the same kind, by templates over named new points.

A new point is named by the corners that it is the mean of, so cells that share
an edge or a face name it alike, and the refined mesh conforms without a search.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..celltypes import by_type
from ..mesh import CELL_COLUMNS, CELL_KEYS, POINT_KEYS, MeshFrame
from .ordering import numbered

Subset = tuple[int, ...]

#: Corners of the unit line, square and cube in node order.
_BOX = {
    "line": [(0,), (1,)],
    "quad": [(0, 0), (1, 0), (1, 1), (0, 1)],
    "hexahedron": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
}


def _of_box(corners: list[tuple[int, ...]]) -> list[list[Subset]]:
    """Children of a box halved along every axis: each node as the corners that it is the mean of."""

    def mean_of(place: tuple[int, ...]) -> Subset:
        return tuple(k for k, c in enumerate(corners) if all(p in (1, 2 * v) for p, v in zip(place, c, strict=True)))

    halves = itertools.product((0, 1), repeat=len(corners[0]))
    return [[mean_of(tuple(h + v for h, v in zip(half, c, strict=True))) for c in corners] for half in halves]


def _of_triangle(a: int = 0, b: int = 1, c: int = 2) -> list[list[Subset]]:
    pair = lambda *p: tuple(sorted(p))
    return [
        [(a,), pair(a, b), pair(a, c)],
        [pair(a, b), (b,), pair(b, c)],
        [pair(a, c), pair(b, c), (c,)],
        [pair(a, b), pair(b, c), pair(a, c)],
    ]


def _of_tetra() -> list[list[Subset]]:
    """Four corners, and the octahedron between them in four about the line from the middle of 02 to that of 13."""
    ends = [[tuple(sorted({k, j})) for j in range(4)] for k in range(4)]
    ring = [(0, 1), (1, 2), (2, 3), (0, 3)]
    inner = [[(0, 2), (1, 3), ring[k], ring[(k + 1) % 4]] for k in range(4)]
    return ends + inner


def _of_wedge() -> list[list[Subset]]:
    out = []
    for upper in (0, 1):
        for child in _of_triangle():
            low = [tuple(sorted({*s, *(k + 3 for k in s)})) for s in child]
            flat = [s if not upper else tuple(k + 3 for k in s) for s in child]
            out.append(flat + low if not upper else low + flat)
    return out


TEMPLATES: dict[str, list[list[Subset]]] = {**{t: _of_box(c) for t, c in _BOX.items()}, "triangle": _of_triangle(), "tetra": _of_tetra(), "wedge": _of_wedge()}


def _children(cell_type: Column, nodes: Column) -> Column:
    """array<array<array<bigint>>>: children, their nodes, and the sorted ids that each node is the mean of."""

    def make(template: list[list[Subset]]) -> Column:
        name = lambda s: F.array_sort(F.array(*[nodes.getItem(k) for k in s]))
        return F.array(*[F.array(*[name(s) for s in child]) for child in template])

    return by_type(cell_type, TEMPLATES, make, F.array(F.transform(nodes, lambda n: F.array(n))))


def refine(mesh: MeshFrame, where: Column | None = None) -> MeshFrame:
    """Every cell, or those for which ``where`` holds, halved along every axis, with ``parent`` and its data.

    Lines, triangles, quads, tetrahedra, wedges and hexahedra; cells of other
    types, and those that are not chosen, stay as they are. New points come
    after the old ones in the order of the corners that they are the mean of,
    with the mean of each numeric array. A partly refined mesh has hanging
    points, which ``conformity.check_conformity`` names.
    """
    whole = F.array(F.transform("nodes", lambda n: F.array(n)))
    halved = _children(F.col("cell_type"), F.col("nodes"))
    parts = mesh.cells.withColumn("_parts", halved if where is None else F.when(where, halved).otherwise(whole))
    parts = parts.select("*", F.posexplode("_parts").alias("_k", "_names")).drop("_parts").withColumn("parent", F.col("cell_id"))
    cells = numbered(parts, ["parent", "_k"], "cell_id").drop("cell_id_of", "_k")
    named = cells.select(*CELL_KEYS, F.posexplode("_names").alias("local", "name"))
    new = named.where(F.size("name") > 1).select("mesh_id", "name").distinct()
    last = mesh.points.groupBy("mesh_id").agg(F.max("point_id").alias("_last"))
    ids = numbered(new, ["name"], "_place").join(F.broadcast(last), "mesh_id").select("mesh_id", "name", (F.col("_last") + 1 + F.col("_place")).alias("id"))
    arrays = [c for c, k in mesh.points.dtypes if c not in ("mesh_id", "point_id") and k in ("double", "float")]
    corners = ids.select("mesh_id", "id", F.explode("name").alias("point_id")).join(mesh.points.select(*POINT_KEYS, *arrays), POINT_KEYS)
    made = corners.groupBy("mesh_id", F.col("id").alias("point_id")).agg(*[F.avg(c).alias(c) for c in arrays])
    placed = named.join(ids, ["mesh_id", "name"], "left").select(*CELL_KEYS, "local", F.coalesce("id", F.col("name").getItem(0)).alias("node"))
    nodes = placed.groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("local", "node"))).alias("_n"))
    others = [c for c in cells.columns if c not in (*CELL_COLUMNS, "_names")]
    cells = cells.drop("nodes", "_names").join(nodes, CELL_KEYS).select("mesh_id", "cell_id", "cell_type", F.col("_n.node").alias("nodes"), *others)
    return MeshFrame(mesh.points.unionByName(made, allowMissingColumns=True), cells)


def tessellate(mesh: MeshFrame, levels: int = 2) -> DataFrame:
    """Quadratic triangles and quads as flat ones on a lattice of ``levels`` divisions: mesh_id, parent, k and corners (structs x, y, z).

    The corners are the cell's shape functions at the lattice's places, so the
    pieces follow its curve. Other types are left out.
    """
    def triangle6(r: float, s: float) -> list[float]:
        q = 1 - r - s
        return [q * (2 * q - 1), r * (2 * r - 1), s * (2 * s - 1), 4 * q * r, 4 * r * s, 4 * s * q]

    def quad8(r: float, s: float) -> list[float]:
        r, s = 2 * r - 1, 2 * s - 1
        ends = [(1 + a * r) * (1 + b * s) * (a * r + b * s - 1) / 4 for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        return [*ends, (1 - r * r) * (1 - s) / 2, (1 + r) * (1 - s * s) / 2, (1 - r * r) * (1 + s) / 2, (1 - r) * (1 - s * s) / 2]

    n = levels
    small = []
    for j in range(n):
        for i in range(n - j):
            small.append([(i, j), (i + 1, j), (i, j + 1)])
            if i + j < n - 1:
                small.append([(i + 1, j), (i + 1, j + 1), (i, j + 1)])
    square = [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)] for j in range(n) for i in range(n)]
    templates = [(kind, k, [shape(i / n, j / n) for i, j in p]) for kind, shape, pieces in (("triangle6", triangle6, small), ("quad8", quad8, square)) for k, p in enumerate(pieces)]
    # at most 2 levels^2 rows of weights, whatever the mesh
    table = mesh.cells.sparkSession.createDataFrame(templates, "cell_type string, k int, weights array<array<double>>")
    rows = mesh.with_corners().join(F.broadcast(table), "cell_type")

    def place(w: Column, axis: str) -> Column:
        return F.aggregate(F.zip_with(w, F.col("corners"), lambda x, c: x * c[axis]), F.lit(0.0), lambda a, v: a + v)

    corners = F.transform("weights", lambda w: F.struct(*[place(w, axis).alias(axis) for axis in "xyz"]))
    return rows.select("mesh_id", F.col("cell_id").alias("parent"), "k", corners.alias("corners"))


def poly_to_tet(polyhedra: DataFrame) -> DataFrame:
    """mesh_id, parent, k, nodes: each polyhedron (mesh_id, parent, faces: arrays of point ids wound outwards) about a new middle.

    Every face is a fan from its first node; the middle has the id -1 - parent,
    as in ``surfaces.subdivide``. Native: one explode of faces and one of fans.
    """
    middle = (-1 - F.col("parent")).cast("bigint")
    face = polyhedra.select("mesh_id", "parent", F.posexplode("faces").alias("face", "f"))
    fan = F.transform(F.sequence(F.lit(2), F.size("f") - 1), lambda k: F.array(F.col("f").getItem(0), F.col("f").getItem(k), F.col("f").getItem(k - 1), middle))
    return face.where(F.size("f") >= 3).select("mesh_id", "parent", "face", F.posexplode(fan).alias("k", "nodes"))
