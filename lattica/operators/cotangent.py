"""Operators of the cotangent Laplacian of triangle surfaces.

What needs neighbours only is native: one row for each corner, one aggregate.
Linear systems and eigenvectors need a whole surface in hand: numpy in grouped
maps, one mesh to a group, by conjugate gradients, so memory grows with the
points of the largest mesh and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import divided
from ..mesh import POINT_KEYS, MeshFrame
from .geometry import Vec, corner, cross, dot, length, minus, point_normals

XYZ = ["x", "y", "z"]


def _corners(mesh: MeshFrame) -> DataFrame:
    """One row for each corner of each triangle: point_id, its place p, the two others q and r in order."""
    c = F.col("corners")
    place = lambda k: F.struct(*[c.getItem(k)[a].alias(a) for a in XYZ])
    ids = F.col("nodes")
    rows = [
        F.struct(ids.getItem(k).alias("point_id"), ids.getItem((k + 1) % 3).alias("q_id"), ids.getItem((k + 2) % 3).alias("r_id"), place(k).alias("p"), place((k + 1) % 3).alias("q"), place((k + 2) % 3).alias("r"))
        for k in range(3)
    ]
    faces = mesh.with_corners().where("cell_type = 'triangle'")
    return faces.select("mesh_id", F.explode(F.array(*rows)).alias("e")).select("mesh_id", "e.*")


def _vec(c: str) -> Vec:
    return F.col(c)["x"], F.col(c)["y"], F.col(c)["z"]


def _cot(at: str, a: str, b: str) -> Column:
    u, v = minus(_vec(a), _vec(at)), minus(_vec(b), _vec(at))
    return divided(dot(u, v), length(cross(u, v)))


def mean_curvature(mesh: MeshFrame, dual_area: str = "mixed-voronoi") -> DataFrame:
    """point_id, area and mean: half the length of the cotangent Laplacian of the places over the dual area, signed by the point normal.

    The dual area is a third of the triangles, or Voronoi with the usual
    exception for obtuse triangles (half at the obtuse corner, else a quarter).
    Convex surfaces wound outwards are positive.
    """
    if dual_area not in ("mixed-voronoi", "barycentric"):
        raise ValueError(f"{dual_area!r} is neither mixed-voronoi nor barycentric")
    rows = _corners(mesh)
    cot_p, cot_q, cot_r = _cot("p", "q", "r"), _cot("q", "p", "r"), _cot("r", "p", "q")
    pq, pr = minus(_vec("q"), _vec("p")), minus(_vec("r"), _vec("p"))
    area = length(cross(pq, pr)) / 2
    if dual_area == "barycentric":
        dual = area / 3
    else:
        voronoi = (dot(pq, pq) * cot_r + dot(pr, pr) * cot_q) / 8
        dual = F.when((cot_p >= 0) & (cot_q >= 0) & (cot_r >= 0), voronoi).when(cot_p < 0, area / 2).otherwise(area / 4)
    # the edge to q lies opposite r, the edge to r opposite q
    pull = [(pq[k] * cot_r + pr[k] * cot_q) / 2 for k in range(3)]
    sums = rows.groupBy(*POINT_KEYS).agg(F.sum(dual).alias("area"), *[F.sum(v).alias(f"l{c}") for c, v in zip(XYZ, pull, strict=True)])
    n = sums.join(point_normals(mesh), POINT_KEYS, "left")
    size = F.sqrt(sum((F.col(f"l{c}") ** 2 for c in XYZ), F.lit(0.0)))
    along = sum((F.col(f"l{c}") * F.col(f"n{c}") for c in XYZ), F.lit(0.0))
    return n.select(*POINT_KEYS, "area", (F.when(along > 0, -1.0).otherwise(1.0) * divided(size, 2 * F.col("area"))).alias("mean"))


def principal_curvatures(mean: Column, gaussian: Column) -> tuple[Column, Column]:
    """Greatest and least curvature; a negative root is rounding and counts as 0."""
    root = F.sqrt(F.greatest(mean * mean - gaussian, F.lit(0.0)))
    return mean + root, mean - root


class Surface:
    """A triangle surface in hand: cotangent stiffness as triplets, and a lumped mass."""

    def __init__(self, places: np.ndarray, triangles: np.ndarray):
        self.p, self.t, self.n = places, triangles, len(places)
        a, b, c = (places[triangles[:, k]] for k in range(3))
        self.normal = np.cross(b - a, c - a)
        double = np.linalg.norm(self.normal, axis=1)
        self.area = double / 2
        rows, cols, weights = [], [], []
        for k in range(3):
            i, j, o = triangles[:, (k + 1) % 3], triangles[:, (k + 2) % 3], triangles[:, k]
            u, v = places[i] - places[o], places[j] - places[o]
            w = (u * v).sum(1) / np.maximum(double, 1e-300) / 2
            rows += [i, j]
            cols += [j, i]
            weights += [w, w]
        rows, cols, weights = (np.concatenate(x) for x in (rows, cols, weights))
        # repeated pairs are added up once, so that a product is one pass over distinct neighbours
        key, place = np.unique(rows * np.int64(self.n) + cols, return_inverse=True)
        self.rows, self.cols = key // self.n, key % self.n
        self.weights = np.bincount(place, weights, len(key))
        self.diagonal = np.bincount(self.rows, self.weights, self.n)
        self.mass = np.bincount(triangles.ravel(), np.repeat(self.area / 3, 3), self.n)

    def stiffness(self, x: np.ndarray) -> np.ndarray:
        """K x for one column or several."""
        if x.ndim == 1:
            return self.diagonal * x - np.bincount(self.rows, self.weights * x[self.cols], self.n)
        return np.stack([self.stiffness(x[:, k]) for k in range(x.shape[1])], 1)

    def gradient(self, u: np.ndarray) -> np.ndarray:
        """The gradient of a field on each triangle."""
        unit = self.normal / np.maximum(2 * self.area, 1e-300)[:, None]
        out = np.zeros((len(self.t), 3))
        for k in range(3):
            i, j = self.p[self.t[:, (k + 1) % 3]], self.p[self.t[:, (k + 2) % 3]]
            out += u[self.t[:, k]][:, None] * np.cross(unit, j - i)
        return out / np.maximum(2 * self.area, 1e-300)[:, None]

    def divergence(self, field: np.ndarray) -> np.ndarray:
        """The integrated divergence of a field of triangles on each point."""
        out = np.zeros(self.n)
        for k in range(3):
            o, i, j = (self.t[:, (k + m) % 3] for m in range(3))
            e1, e2 = self.p[i] - self.p[o], self.p[j] - self.p[o]
            size = np.maximum(2 * self.area, 1e-300)
            opposite = self.p[j] - self.p[i]
            cot_j = ((self.p[o] - self.p[j]) * -opposite).sum(1) / size
            cot_i = ((self.p[o] - self.p[i]) * opposite).sum(1) / size
            out += np.bincount(o, (cot_j * (e1 * field).sum(1) + cot_i * (e2 * field).sum(1)) / 2, self.n)
        return out


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-10, rounds: int = 0) -> np.ndarray:
    """The solution of a positive system, with its diagonal as preconditioner; a part without right side stays 0."""
    x = np.zeros_like(b)
    r = b.copy()
    scale = np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 0)
    z = scale * r
    p, rz = z.copy(), r @ z
    goal = tolerance * np.linalg.norm(b)
    for _ in range(rounds or 10 * len(b) + 100):
        if np.linalg.norm(r) <= goal or rz == 0:
            break
        q = apply(p)
        along = p @ q
        if along <= 0:
            break
        a = rz / along
        x += a * p
        r -= a * q
        z = scale * r
        rz, old = r @ z, rz
        p = z + (rz / old) * p
    return x


def _pieces(n: int, t: np.ndarray) -> np.ndarray:
    """The component of each point, by its least member."""
    label = np.arange(n)
    while True:
        low = label[t].min(1)
        new = label.copy()
        np.minimum.at(new, t.ravel(), np.repeat(low, 3))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _flow(s: Surface, start: np.ndarray, t: float, tolerance: float = 1e-7) -> np.ndarray:
    """(M + t K) u = start by steps that keep the digits of values however small they are: far from the sources only their ratio counts."""
    diagonal = np.maximum(s.mass + t * s.diagonal, 1e-300)
    u = start / diagonal
    for _ in range(20 * s.n + 1000):
        new = (start + t * np.bincount(s.rows, s.weights * u[s.cols], s.n)) / diagonal
        done = np.abs(new - u) <= tolerance * np.abs(new)
        u = new
        if done.all():
            break
    return u


def heat_distance(s: Surface, sources: np.ndarray, time_factor: float = 1.0) -> np.ndarray:
    """Distances by the heat method: a short flow of heat from the sources, its direction, and the potential of that.

    Pieces without a source are NaN.
    """
    ends = np.concatenate([s.t[:, [0, 1]], s.t[:, [1, 2]], s.t[:, [2, 0]]])
    h = np.linalg.norm(s.p[ends[:, 0]] - s.p[ends[:, 1]], axis=1).mean()
    t = time_factor * h * h
    start = np.zeros(s.n)
    start[sources] = 1.0
    u = _flow(s, start, t)
    g = s.gradient(u)
    size = np.linalg.norm(g, axis=1, keepdims=True)
    flow = np.where(size > 0, -g / np.where(size > 0, size, 1), 0)
    rhs = s.divergence(flow)
    piece = _pieces(s.n, s.t)
    # each piece's right side sums to zero, as it must
    count = np.bincount(piece, minlength=s.n)
    rhs = rhs - (np.bincount(piece, rhs, s.n) / np.maximum(count, 1))[piece]
    phi = conjugate_gradients(s.stiffness, -rhs, s.diagonal, rounds=20 * s.n + 100)
    out = np.full(s.n, np.nan)
    for k in np.unique(piece[sources]):
        own = piece == k
        out[own] = phi[own] - phi[sources[piece[sources] == k]].mean()
    return np.maximum(out, 0.0)


def eigenmodes(s: Surface, modes: int, rounds: int = 60, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Least eigenvalues of K x = v M x and their vectors, by blocks of inverse steps with Rayleigh and Ritz."""
    size = min(s.n, modes + max(4, modes // 2))
    mass = np.maximum(s.mass, 1e-300)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(s.n, size))
    x[:, 0] = 1.0
    shift = 0.1 * np.median(s.diagonal / mass) / s.n
    last = np.full(modes, np.inf)
    diagonal = s.diagonal + shift * mass
    for _ in range(rounds):
        y = np.stack([conjugate_gradients(lambda v: s.stiffness(v) + shift * mass * v, mass * x[:, k], diagonal, 1e-8) for k in range(size)], 1)
        q, _ = np.linalg.qr(np.sqrt(mass)[:, None] * y)
        y = q / np.sqrt(mass)[:, None]
        values, turn = np.linalg.eigh((lambda m: (m + m.T) / 2)(y.T @ s.stiffness(y)))
        x = y @ turn
        if np.abs(values[:modes] - last[: len(values[:modes])]).max() <= tolerance * max(1.0, abs(values[:modes]).max()):
            break
        last = values[:modes]
    return np.maximum(values[:modes], 0), x[:, :modes]


_NODES = ["_a", "_b", "_c"]


def _in_hand(points: DataFrame, triangles: DataFrame, columns: list[str]) -> DataFrame:
    """Points and triangles of each mesh as rows of one table, for a grouped map."""
    p = points.select("mesh_id", F.lit(0).alias("_kind"), F.col("point_id").alias("_a"), F.lit(0).cast("bigint").alias("_b"), F.lit(0).cast("bigint").alias("_c"), *[F.col(x).cast("double").alias(x) for x in columns])
    nodes = F.col("nodes")
    t = triangles.where("cell_type = 'triangle'").select("mesh_id", F.lit(1).alias("_kind"), *[nodes.getItem(k).alias(n) for k, n in enumerate(_NODES)], *[F.lit(None).cast("double").alias(x) for x in columns])
    return p.unionAll(t)


def _surface(g: pd.DataFrame) -> tuple[pd.DataFrame, Surface]:
    rows = g[g["_kind"] == 1]
    used = np.unique(rows[_NODES].to_numpy())
    p = g[(g["_kind"] == 0) & g["_a"].isin(used)].sort_values("_a").reset_index(drop=True)
    t = np.searchsorted(p["_a"].to_numpy(), rows[_NODES].to_numpy())
    return p, Surface(p[XYZ].to_numpy(float), t)


def geodesic_distance(mesh: MeshFrame, sources: DataFrame, time_factor: float = 1.0) -> DataFrame:
    """mesh_id, point_id, distance over the surface from ``sources`` (mesh_id, point_id), by the heat method.

    Points of pieces without a source get NaN; points of no triangle no row.
    """
    marked = mesh.points.join(sources.select(*POINT_KEYS, F.lit(1.0).alias("_source")).distinct(), POINT_KEYS, "left").withColumn("_source", F.coalesce("_source", F.lit(0.0)))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        p, s = _surface(g)
        at = np.flatnonzero(p["_source"].to_numpy() > 0)
        d = heat_distance(s, at, time_factor) if len(at) else np.full(s.n, np.nan)
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[0], "point_id": p["_a"], "distance": d})

    rows = _in_hand(marked, mesh.cells, [*XYZ, "_source"])
    made = rows.groupBy("mesh_id").applyInPandas(one, "mesh_id string, point_id bigint, distance double")
    return made.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))


def laplacian_eigenmodes(mesh: MeshFrame, modes: int = 10) -> DataFrame:
    """mesh_id, mode, value, point_id, component: the least eigenvalues of the cotangent Laplacian with a lumped mass, and their vectors.

    Vectors have unit mass and are signed so that their largest entry is positive.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        p, s = _surface(g)
        values, x = eigenmodes(s, min(modes, s.n))
        x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
        k = np.repeat(np.arange(len(values)), s.n)
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[0], "mode": k, "value": values[k], "point_id": np.tile(p["_a"], len(values)), "component": x.T.ravel()})

    return _in_hand(mesh.points, mesh.cells, XYZ).groupBy("mesh_id").applyInPandas(one, "mesh_id string, mode int, value double, point_id bigint, component double")


def sobolev_deform(mesh: MeshFrame, displacement: tuple[str, str, str], length_scale: float) -> DataFrame:
    """The points moved by a displacement smoothed over ``length_scale``: (M + l^2 K) u = M d for each component; 0 takes it as it is."""
    names = list(displacement)
    if length_scale == 0:
        return mesh.points.withColumns({c: F.col(c) + F.col(n) for c, n in zip(XYZ, names, strict=True)})

    def one(g: pd.DataFrame) -> pd.DataFrame:
        p, s = _surface(g)
        l2 = length_scale * length_scale
        out = {"mesh_id": g.mesh_id.iloc[0], "point_id": p["_a"]}
        for c, n in zip(XYZ, names, strict=True):
            out[f"u{c}"] = conjugate_gradients(lambda x: s.mass * x + l2 * s.stiffness(x), s.mass * p[n].to_numpy(), s.mass + l2 * s.diagonal)
        return pd.DataFrame(out)

    rows = _in_hand(mesh.points, mesh.cells, [*XYZ, *names])
    moves = rows.groupBy("mesh_id").applyInPandas(one, "mesh_id string, point_id bigint, ux double, uy double, uz double")
    moved = {c: F.col(c) + F.coalesce(F.col(f"u{c}"), F.lit(0.0)) for c in XYZ}
    return mesh.points.join(moves, POINT_KEYS, "left").withColumns(moved).drop("ux", "uy", "uz")


def morph(mesh: MeshFrame, displacement: DataFrame) -> DataFrame:
    """The points moved by ``displacement`` (mesh_id, point_id, ux, uy, uz) where it is given, the others harmonically in between."""
    given = displacement.select(*POINT_KEYS, *[F.col(f"u{c}").cast("double").alias(f"u{c}") for c in XYZ], F.lit(1.0).alias("_held"))
    marked = mesh.points.join(given, POINT_KEYS, "left").fillna(0.0, ["ux", "uy", "uz", "_held"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        p, s = _surface(g)
        held = p["_held"].to_numpy() > 0
        out = {"mesh_id": g.mesh_id.iloc[0], "point_id": p["_a"]}
        for c in XYZ:
            d = np.where(held, p[f"u{c}"].to_numpy(), 0.0)
            rhs = np.where(held, 0.0, -s.stiffness(d))
            free = lambda x: np.where(held, 0.0, s.stiffness(np.where(held, 0.0, x)))
            out[f"v{c}"] = d + conjugate_gradients(free, rhs, np.where(held, 0.0, s.diagonal))
        return pd.DataFrame(out)

    rows = _in_hand(marked, mesh.cells, [*XYZ, "ux", "uy", "uz", "_held"])
    moves = rows.groupBy("mesh_id").applyInPandas(one, "mesh_id string, point_id bigint, vx double, vy double, vz double")
    moved = {c: F.col(c) + F.coalesce(F.col(f"v{c}"), F.lit(0.0)) for c in XYZ}
    return mesh.points.join(moves, POINT_KEYS, "left").withColumns(moved).drop("vx", "vy", "vz")


def most_normal_offsets(mesh: MeshFrame) -> DataFrame:
    """mesh_id, point_id, mx, my, mz: the move of each point that shifts the planes of all its faces by one.

    The normal equations of a point come from one aggregate over its faces; the
    3 x 3 systems are solved in numpy, a batch at a time. Faces in one plane
    share their normal, so a flat point moves along it.
    """
    from .geometry import cell_normals

    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    stars = mesh.incidence().join(cell_normals(mesh), ["mesh_id", "cell_id"])
    sums = stars.groupBy(*POINT_KEYS).agg(*[F.sum(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"s{a}{b}") for a, b in pairs], *[F.sum(f"n{c}").alias(f"t{c}") for c in XYZ])

    def solve(batches):
        for g in batches:
            a = np.zeros((len(g), 3, 3))
            for i, p in enumerate(XYZ):
                for j, q in enumerate(XYZ):
                    a[:, i, j] = g["s" + "".join(sorted((p, q)))]
            rhs = g[[f"t{c}" for c in XYZ]].to_numpy()
            w, v = np.linalg.eigh(a)
            keep = w > 1e-6 * np.maximum(w[:, -1:], 1e-300)
            scaled = np.einsum("nij,ni->nj", v, rhs) * np.where(keep, 1 / np.where(keep, w, 1), 0)
            m = np.einsum("nij,nj->ni", v, scaled)
            yield pd.DataFrame({"mesh_id": g.mesh_id, "point_id": g.point_id, "mx": m[:, 0], "my": m[:, 1], "mz": m[:, 2]})

    return sums.mapInPandas(solve, "mesh_id string, point_id bigint, mx double, my double, mz double")
