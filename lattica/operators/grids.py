"""Between meshes and lattices: sampling, scattering back, spectra and octrees."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import POINT_KEYS, MeshFrame
from .fields import barycentric

XYZ = ("x", "y", "z")


def lattice_points(mesh_ids: DataFrame, dims: tuple[int, int, int], origin: tuple[float, float, float], spacing: tuple[float, float, float]) -> DataFrame:
    """mesh_id, point_id (x fastest), i, j, k, x, y, z: the nodes of a lattice for each mesh in ``mesh_ids``."""
    nx, ny, nz = dims
    rows = mesh_ids.select("mesh_id").distinct().crossJoin(mesh_ids.sparkSession.range(nx * ny * nz))
    at = {"i": F.col("id") % nx, "j": F.floor(F.col("id") / nx) % ny, "k": F.floor(F.col("id") / (nx * ny))}
    placed = rows.select("mesh_id", F.col("id").alias("point_id"), *[v.cast("bigint").alias(n) for n, v in at.items()])
    return placed.withColumns({c: F.col(n) * s + o for c, n, s, o in zip(XYZ, "ijk", spacing, origin, strict=True)})


def sample_grid(mesh: MeshFrame, names: list[str], dims: tuple[int, int, int], origin: tuple[float, float, float], spacing: tuple[float, float, float]) -> DataFrame:
    """The nodes of a lattice with the point arrays of the mesh at them, null outside it, and ``inside``."""
    nodes = lattice_points(mesh.points, dims, origin, spacing)
    found = barycentric(nodes, mesh, names, default=float("nan"))
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}).withColumn("inside", F.col(names[0]).isNotNull())


def scatter_grid(points: DataFrame, lattice: DataFrame, names: list[str], origin: tuple[float, float, float], spacing: tuple[float, float, float]) -> DataFrame:
    """Point ids with the lattice arrays (mesh_id, i, j, k, names) at them, trilinear; null where a node around the point is missing or null.

    Every point meets the eight nodes around it by an equi-join; a point on a
    lattice line takes the cell above it unless that cell is beyond the lattice,
    where its weights are zero anyway and the node may be missing.
    """
    at = {n: (F.col(c) - o) / s for n, c, o, s in zip("ijk", XYZ, origin, spacing, strict=True)}
    low = points.select(*POINT_KEYS, *[F.floor(v).cast("bigint").alias(f"l{n}") for n, v in at.items()], *[(v - F.floor(v)).alias(f"t{n}") for n, v in at.items()])
    corners = F.array(*[F.struct(*[F.lit(o).alias(f"o{n}") for n, o in zip("ijk", t, strict=True)]) for t in itertools.product((0, 1), repeat=3)])
    rows = low.select("*", F.explode(corners).alias("_o"))
    weight: Column = F.lit(1.0)
    for n in "ijk":
        weight = weight * F.when(F.col(f"_o.o{n}") == 1, F.col(f"t{n}")).otherwise(1 - F.col(f"t{n}"))
    rows = rows.select(*POINT_KEYS, *[(F.col(f"l{n}") + F.col(f"_o.o{n}")).alias(n) for n in "ijk"], weight.alias("_w")).where("_w > 0")
    joined = rows.join(lattice.select("mesh_id", "i", "j", "k", *names), ["mesh_id", "i", "j", "k"], "left")
    whole = lambda n: F.when(F.count(n) == F.count(F.lit(1)), F.sum(F.col(n) * F.col("_w"))).alias(n)
    return joined.groupBy(*POINT_KEYS).agg(*[whole(n) for n in names])


def resample_grid(lattice: DataFrame, names: list[str], origin, spacing, dims, new_origin, new_spacing) -> DataFrame:
    """The arrays of one lattice at the nodes of another, trilinear."""
    nodes = lattice_points(lattice, dims, new_origin, new_spacing)
    return nodes.join(scatter_grid(nodes, lattice, names, origin, spacing), POINT_KEYS, "left")


def grid_coverage(sampled: DataFrame) -> DataFrame:
    """One row for each mesh: nodes, nodes inside, and their share."""
    return sampled.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("inside").alias("inside"), F.avg(F.col("inside").cast("double")).alias("share"))


def grid_spectrum(lattice: DataFrame, name: str, dims: tuple[int, int, int], bins: int = 8) -> DataFrame:
    """mesh_id, bin, modes, power: the squared discrete Fourier transform of a lattice array (its mean taken off, nulls as 0), summed over shells of wave number.

    One lattice is one group: its size is the caller's ``dims``.
    """
    nx, ny, nz = dims

    def one(g: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros((nz, ny, nx))
        field[g.k, g.j, g.i] = g[name].fillna(0.0)
        power = np.abs(np.fft.fftn(field - field.mean())) ** 2 / field.size
        waves = [np.fft.fftfreq(n) * n for n in (nz, ny, nx)]
        radius = np.sqrt(sum(w**2 for w in np.meshgrid(*waves, indexing="ij")))
        top = radius.max() or 1.0
        shell = np.minimum((radius / top * bins).astype(int), bins - 1).ravel()
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[0], "bin": range(bins), "modes": np.bincount(shell, minlength=bins), "power": np.bincount(shell, power.ravel(), bins)})

    return lattice.select("mesh_id", "i", "j", "k", F.col(name).cast("double").alias(name)).groupBy("mesh_id").applyInPandas(one, "mesh_id string, bin int, modes bigint, power double")


def octree(triangles: DataFrame, box: tuple[tuple[float, float, float], float], min_level: int = 0, max_level: int = 4) -> DataFrame:
    """mesh_id, level, i, j, k, cut: the leaves of a tree of cubes that is split where the boxes of triangles pass.

    ``triangles`` has mesh_id and the array ``corners``; ``box`` is the lower
    corner and the side of the root. A cube is split below ``min_level``, or
    when a triangle's box touches it, down to ``max_level``. Levels are found one after
    the other, from the triangles of the cubes that were split.
    """
    origin, side = box
    spark = triangles.sparkSession
    c = F.col("corners")
    limits = triangles.select("mesh_id", *[f(*[c.getItem(k)[a] for k in range(3)]).alias(f"{p}{a}") for a in XYZ for p, f in (("l", F.least), ("h", F.greatest))])
    meshes = triangles.select("mesh_id").distinct()

    def touched(level: int) -> DataFrame:
        size, n = side / 2**level, 2**level
        rows = limits
        for a, o, m in zip(XYZ, origin, "ijk", strict=True):
            first = F.greatest(F.floor((F.col(f"l{a}") - o) / size).cast("bigint"), F.lit(0))
            last = F.least(F.floor((F.col(f"h{a}") - o) / size).cast("bigint"), F.lit(n - 1))
            rows = rows.where(first <= last).withColumn(m, F.explode(F.sequence(first, last)))
        return rows.select("mesh_id", "i", "j", "k").distinct().withColumn("cut", F.lit(1))

    eight = F.array(*[F.struct(*[F.lit(o).alias(n) for n, o in zip("ijk", t, strict=True)]) for t in itertools.product((0, 1), repeat=3)])
    live = meshes.select("mesh_id", *[F.lit(0).cast("bigint").alias(n) for n in "ijk"])
    out = None
    for level in range(max_level + 1):
        marked = live.join(touched(level), ["mesh_id", "i", "j", "k"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
        splits = (F.lit(level < min_level) | (F.col("cut") == 1)) if level < max_level else F.lit(False)
        leaves = marked.where(~splits).select("mesh_id", F.lit(level).alias("level"), "i", "j", "k", "cut")
        out = leaves if out is None else out.unionAll(leaves)
        if level < max_level:
            parents = marked.where(splits).select("mesh_id", "i", "j", "k", F.explode(eight).alias("_o"))
            live = parents.select("mesh_id", *[(2 * F.col(n) + F.col(f"_o.{n}")).alias(n) for n in "ijk"])
    return out
