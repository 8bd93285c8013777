"""Parametric primitives as meshes: ids and places are arithmetic on ``spark.range``, so any size is made in parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import MeshFrame
from .generate import grid


def _rows(spark: SparkSession, n: int) -> tuple[DataFrame, Column]:
    return spark.range(n), F.col("id")


def _points(rows: DataFrame, mesh_id: str, point_id: Column, x: Column, y: Column, z: Column) -> DataFrame:
    return rows.select(F.lit(mesh_id).alias("mesh_id"), point_id.cast("bigint").alias("point_id"), *[c.cast("double").alias(n) for n, c in zip("xyz", (x, y, z), strict=True)])


def _cells(rows: DataFrame, mesh_id: str, cell_id: Column, kind: str, nodes: list[Column]) -> DataFrame:
    return rows.select(F.lit(mesh_id).alias("mesh_id"), cell_id.cast("bigint").alias("cell_id"), F.lit(kind).alias("cell_type"), F.array(*[n.cast("bigint") for n in nodes]).alias("nodes"))


def box(spark: SparkSession, size: tuple[float, float, float] = (1.0, 1.0, 1.0), divisions: tuple[int, int, int] = (1, 1, 1), mesh_id: str = "box") -> MeshFrame:
    """A solid box of hexahedra with a corner at the origin."""
    return grid(spark, divisions, spacing=tuple(s / d for s, d in zip(size, divisions, strict=True)), mesh_id=mesh_id)


def plane(spark: SparkSession, size: tuple[float, float] = (1.0, 1.0), divisions: tuple[int, int] = (1, 1), mesh_id: str = "plane") -> MeshFrame:
    """A rectangle of quads in z = 0 with a corner at the origin."""
    return grid(spark, divisions, spacing=(size[0] / divisions[0], size[1] / divisions[1], 1.0), mesh_id=mesh_id)


def tube(spark: SparkSession, radius: float = 1.0, height: float = 1.0, around: int = 32, along: int = 1, top: float | None = None, mesh_id: str = "tube") -> MeshFrame:
    """The open side of a cylinder, or of a cone frustum where ``top`` is another radius, about z: quads wound outwards."""
    end = radius if top is None else top
    rows, i = _rows(spark, around * (along + 1))
    turn, step = 2 * math.pi * (i % around) / around, F.floor(i / around) / along
    r = F.lit(radius) + (end - radius) * step
    points = _points(rows, mesh_id, i, r * F.cos(turn), r * F.sin(turn), height * step)
    quads, c = _rows(spark, around * along)
    a, row = c % around, F.floor(c / around) * around
    b = (a + 1) % around
    return MeshFrame(points, _cells(quads, mesh_id, c, "quad", [row + a, row + b, row + around + b, row + around + a]))


def _fan(spark: SparkSession, mesh_id: str, first_cell: int, around: int, ring: int, middle: int, up: bool) -> DataFrame:
    rows, i = _rows(spark, around)
    a, b = ring + i, ring + (i + 1) % around
    return _cells(rows, mesh_id, first_cell + i, "triangle", [F.lit(middle), a, b] if up else [F.lit(middle), b, a])


def cylinder(spark: SparkSession, radius: float = 1.0, height: float = 1.0, around: int = 32, along: int = 1, top: float | None = None, mesh_id: str = "cylinder") -> MeshFrame:
    """A closed cylinder or frustum: the side of ``tube`` and a fan of triangles at each end."""
    side = tube(spark, radius, height, around, along, top, mesh_id)
    n, cells = around * (along + 1), around * along
    rows, i = _rows(spark, 2)
    ends = _points(rows, mesh_id, n + i, F.lit(0.0), F.lit(0.0), height * i)
    low = _fan(spark, mesh_id, cells, around, 0, n, False)
    high = _fan(spark, mesh_id, cells + around, around, around * along, n + 1, True)
    return MeshFrame(side.points.unionAll(ends), side.cells.unionAll(low).unionAll(high))


def cone(spark: SparkSession, radius: float = 1.0, height: float = 1.0, around: int = 32, mesh_id: str = "cone") -> MeshFrame:
    """A closed cone: a fan up to the tip and one under it."""
    rows, i = _rows(spark, around)
    turn = 2 * math.pi * i / around
    ring = _points(rows, mesh_id, i, radius * F.cos(turn), radius * F.sin(turn), F.lit(0.0))
    two, k = _rows(spark, 2)
    ends = _points(two, mesh_id, around + k, F.lit(0.0), F.lit(0.0), height * k)
    return MeshFrame(ring.unionAll(ends), _fan(spark, mesh_id, 0, around, 0, around, False).unionAll(_fan(spark, mesh_id, around, around, 0, around + 1, True)))


def disk(spark: SparkSession, radius: float = 1.0, around: int = 32, mesh_id: str = "disk") -> MeshFrame:
    """A fan of triangles in z = 0."""
    rows, i = _rows(spark, around)
    turn = 2 * math.pi * i / around
    ring = _points(rows, mesh_id, i, radius * F.cos(turn), radius * F.sin(turn), F.lit(0.0))
    one, _ = _rows(spark, 1)
    return MeshFrame(ring.unionAll(_points(one, mesh_id, F.lit(around), *[F.lit(0.0)] * 3)), _fan(spark, mesh_id, 0, around, 0, around, True))


def sphere(spark: SparkSession, radius: float = 1.0, around: int = 32, along: int = 16, mesh_id: str = "sphere") -> MeshFrame:
    """A closed sphere of quads between circles of latitude, with a fan of triangles at each pole."""
    rows, i = _rows(spark, around * (along - 1))
    turn, tilt = 2 * math.pi * (i % around) / around, math.pi * (F.floor(i / around) + 1) / along
    flat = radius * F.sin(tilt)
    points = _points(rows, mesh_id, i, flat * F.cos(turn), flat * F.sin(turn), -radius * F.cos(tilt))
    n = around * (along - 1)
    two, k = _rows(spark, 2)
    poles = _points(two, mesh_id, n + k, F.lit(0.0), F.lit(0.0), radius * (2 * k - 1))
    quads, c = _rows(spark, around * (along - 2))
    a, row = c % around, F.floor(c / around) * around
    b = (a + 1) % around
    side = _cells(quads, mesh_id, c, "quad", [row + a, row + b, row + around + b, row + around + a])
    m = around * (along - 2)
    caps = _fan(spark, mesh_id, m, around, 0, n, False).unionAll(_fan(spark, mesh_id, m + around, around, around * (along - 2), n + 1, True))
    return MeshFrame(points.unionAll(poles), side.unionAll(caps))


def torus(spark: SparkSession, radius: float = 2.0, tube_radius: float = 0.5, around: int = 32, across: int = 16, mesh_id: str = "torus") -> MeshFrame:
    """A closed torus of quads about z."""
    n = around * across
    rows, i = _rows(spark, n)
    turn, roll = 2 * math.pi * (i % around) / around, 2 * math.pi * F.floor(i / around) / across
    flat = radius + tube_radius * F.cos(roll)
    points = _points(rows, mesh_id, i, flat * F.cos(turn), flat * F.sin(turn), tube_radius * F.sin(roll))
    quads, c = _rows(spark, n)
    a, row = c % around, F.floor(c / around)
    b, up = (a + 1) % around, (row + 1) % across
    return MeshFrame(points, _cells(quads, mesh_id, c, "quad", [row * around + a, row * around + b, up * around + b, up * around + a]))


def helix(spark: SparkSession, radius: float = 1.0, pitch: float = 1.0, turns: float = 2.0, segments: int = 64, mesh_id: str = "helix") -> MeshFrame:
    """A line of segments that climbs about z."""
    rows, i = _rows(spark, segments + 1)
    turn = 2 * math.pi * turns * i / segments
    points = _points(rows, mesh_id, i, radius * F.cos(turn), radius * F.sin(turn), pitch * turns * i / segments)
    lines, c = _rows(spark, segments)
    return MeshFrame(points, _cells(lines, mesh_id, c, "line", [c, c + 1]))


PRIMITIVES = {f.__name__: f for f in (box, plane, tube, cylinder, cone, disk, sphere, torus, helix)}


def generate(spark: SparkSession, kind: str, **options) -> MeshFrame:
    """The primitive of a name, with its options."""
    if kind not in PRIMITIVES:
        raise ValueError(f"{kind!r} is none of {', '.join(sorted(PRIMITIVES))}")
    return PRIMITIVES[kind](spark, **options)
