"""Kernels that need a whole mesh or neighbourhood in hand: numpy inside grouped maps, one mesh or patch to a group.

They run in parallel over ``mesh_id`` (and a patch or ``point_id`` where one is
given); the memory of a task is bounded by its largest mesh.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_nan
from ..mesh import POINT_KEYS
from .spatial import k_nearest

XYZ = ["x", "y", "z"]


def estimate_normals(points: DataFrame, k: int = 16, viewpoint: tuple[float, float, float] | None = None) -> DataFrame:
    """point_id, nx, ny, nz, variation: the direction of least spread of the k nearest points and the point itself.

    The neighbourhoods come from the bucket join and their moments from an
    aggregate; only the eigenvectors of 3 x 3 matrices are worked out in numpy,
    a batch at a time. Degenerate neighbourhoods give NaN. Towards
    ``viewpoint`` if one is given.
    """
    own = points.select(*POINT_KEYS, F.col("point_id").alias("other_id"))
    near = k_nearest(points, points, k).select(*POINT_KEYS, "other_id").unionByName(own)
    at = points.select("mesh_id", F.col("point_id").alias("other_id"), *XYZ)
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    moments = near.join(at, ["mesh_id", "other_id"]).groupBy(*POINT_KEYS).agg(
        *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in pairs], F.count(F.lit(1)).alias("n")
    )
    rows = moments.join(points.select(*POINT_KEYS, *XYZ), POINT_KEYS)

    def solve(batches):
        for p in batches:
            c = np.zeros((len(p), 3, 3))
            for i, a in enumerate(XYZ):
                for j, b in enumerate(XYZ):
                    key = f"m{a}{b}" if i <= j else f"m{b}{a}"
                    c[:, i, j] = p[key] - p[f"m{a}"] * p[f"m{b}"]
            values, vectors = np.linalg.eigh(c)
            n = vectors[:, :, 0]
            if viewpoint is not None:
                away = ((np.array(viewpoint) - p[XYZ].to_numpy()) * n).sum(1) < 0
                n = np.where(away[:, None], -n, n)
            total = values.sum(1)
            bad = (p.n.to_numpy() < 3) | (values[:, 1] <= 1e-12 * np.maximum(total, 1e-300))
            n = np.where(bad[:, None], np.nan, n)
            yield pd.DataFrame({"mesh_id": p.mesh_id, "point_id": p.point_id, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "variation": np.where(bad, np.nan, values[:, 0] / np.maximum(total, 1e-300))})

    made = rows.mapInPandas(solve, "mesh_id string, point_id bigint, nx double, ny double, nz double, variation double")
    return made.withColumns({n: or_nan(F.col(n)) for n in ("nx", "ny", "nz", "variation")})  # pandas hands NaN over as null


def fit_rigid(source: np.ndarray, target: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The 4 x 4 rotation and shift that moves paired points closest, in closed form."""
    w = np.ones(len(source)) if weights is None else np.asarray(weights, float)
    w = w / w.sum()
    a, b = w @ source, w @ target
    u, _, vt = np.linalg.svd((source - a).T @ ((target - b) * w[:, None]))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, b - r @ a
    return out


def pair_moments(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, cross-covariance and root mean square distance of pairs (x, y, z, other_x, other_y, other_z): one row leaves the cluster."""
    a, b = XYZ, [f"other_{c}" for c in XYZ]
    r = pairs.agg(*[F.avg(c) for c in a], *[F.avg(c) for c in b], *[F.avg(F.col(p) * F.col(q)) for p in a for q in b], F.sqrt(F.avg(sum(((F.col(p) - F.col(q)) ** 2 for p, q in zip(a, b, strict=True)), F.lit(0.0))))).first()
    ma, mb = np.array(r[:3]), np.array(r[3:6])
    return ma, mb, np.array(r[6:15]).reshape(3, 3) - np.outer(ma, mb), float(r[15])


def rigid_from_moments(ma: np.ndarray, mb: np.ndarray, cross: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(cross)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, mb - r @ ma
    return out


def register_rigid(source: DataFrame, target: DataFrame, iterations: int = 20, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """The transform that brings ``source`` onto ``target`` by closest points, and the last root mean square distance.

    Each round is a nearest join and one aggregated row; no point is collected.
    """
    from .geometry import transform
    from .spatial import nearest

    matrix, last = np.eye(4), np.inf
    other = target.select("mesh_id", F.col("point_id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in XYZ])
    for _ in range(iterations):
        moved = transform(source.select(*POINT_KEYS, *XYZ), matrix.tolist())
        pairs = moved.join(nearest(moved, target).drop("d2"), POINT_KEYS).join(other, ["mesh_id", "other_id"])
        ma, mb, cross, rms = pair_moments(pairs)
        if abs(last - rms) <= tolerance:
            break
        last = rms
        matrix = rigid_from_moments(ma, mb, cross) @ matrix
    return matrix, last


def convex_hull_2d(points: DataFrame) -> DataFrame:
    """mesh_id, place, point_id: corners of the hull in the xy plane, counter-clockwise from the lowest x.

    Points that no direction of a fixed fan supports outright still matter, so
    all go to the group; but each task first reduces its own points to their
    hull, which is all that is shuffled.
    """

    def hull(p: np.ndarray) -> list[int]:
        order = np.lexsort((p[:, 1], p[:, 0]))
        turn = lambda o, a, b: (p[a, 0] - p[o, 0]) * (p[b, 1] - p[o, 1]) - (p[a, 1] - p[o, 1]) * (p[b, 0] - p[o, 0])
        chains = []
        for run in (order, order[::-1]):
            out: list[int] = []
            for k in run:
                while len(out) >= 2 and turn(out[-2], out[-1], k) <= 0:
                    out.pop()
                out.append(int(k))
            chains.append(out[:-1])
        return (chains[0] + chains[1]) or [int(order[0])]

    def local(batches):
        for b in batches:
            for _, g in b.groupby("mesh_id"):
                yield g.iloc[sorted(set(hull(g[["x", "y"]].to_numpy())))]

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id").drop_duplicates(["x", "y"]).reset_index(drop=True)
        k = hull(g[["x", "y"]].to_numpy())
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[k], "place": range(len(k)), "point_id": g.point_id.iloc[k]})

    small = points.select(*POINT_KEYS, "x", "y").mapInPandas(local, "mesh_id string, point_id bigint, x double, y double")
    return small.groupBy("mesh_id").applyInPandas(whole, "mesh_id string, place int, point_id bigint")


def fit_primitives(points: DataFrame, patch: str = "patch") -> DataFrame:
    """mesh_id, patch, kind (plane, sphere or cylinder about its own axis), params and rms: the best fit of each patch.

    Planes and spheres come in closed form from one aggregated row of moments
    for each patch; nothing but the moments leaves the aggregate.
    """
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    m = points.groupBy("mesh_id", patch).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in pairs],
        F.avg(r2).alias("mr"), *[F.avg(r2 * F.col(c)).alias(f"mr{c}") for c in XYZ], F.avg(r2 * r2).alias("mrr"),
    )

    def solve(batches):
        for p in batches:
            out = []
            for row in p.itertuples(index=False):
                d = row._asdict()
                mean = np.array([d[f"m{c}"] for c in XYZ])
                second = np.array([[d["m" + "".join(sorted((a, b)))] for b in XYZ] for a in XYZ])
                values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
                normal = vectors[:, 0]
                plane = float(np.sqrt(max(values[0], 0.0)))
                kind, params, rms = "plane", [*mean, *normal], plane
                # x.x = 2 c.x + e by least squares from the moments
                lhs = np.zeros((4, 4))
                lhs[:3, :3], lhs[:3, 3], lhs[3, :3], lhs[3, 3] = 2 * second, mean, 2 * mean, 1
                rhs = np.array([d["mrx"], d["mry"], d["mrz"], d["mr"]])
                if d["n"] >= 4 and np.linalg.cond(lhs) < 1e10:
                    s = np.linalg.solve(lhs, rhs)
                    radius2 = s[3] + s[:3] @ s[:3]
                    if radius2 > 0:
                        c4 = np.array([2 * s[0], 2 * s[1], 2 * s[2], s[3]])
                        square = np.zeros((4, 4))
                        square[:3, :3], square[:3, 3], square[3, :3], square[3, 3] = second, mean, mean, 1
                        algebraic = d["mrr"] - 2 * c4 @ rhs + c4 @ square @ c4
                        sphere = float(np.sqrt(max(algebraic, 0.0)) / (2 * np.sqrt(radius2)))
                        if sphere < 0.5 * plane:
                            kind, params, rms = "sphere", [*s[:3], np.sqrt(radius2)], sphere
                out.append((d["mesh_id"], d[patch], kind, [float(v) for v in params], rms))
            yield pd.DataFrame(out, columns=["mesh_id", patch, "kind", "params", "rms"])

    kind_of = dict(points.dtypes)[patch]
    return m.mapInPandas(solve, f"mesh_id string, {patch} {kind_of}, kind string, params array<double>, rms double")


def edge_distance(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """mesh_id, point_id, distance along edges (mesh_id, src, dst, length, both ways) from the sources.

    Relaxation in rounds over the points whose distance has just fallen;
    lineage is cut each round. Points that are not reached have no row.
    """
    from .components import checkpointed

    best = checkpointed(sources.select("mesh_id", "point_id", F.lit(0.0).alias("distance")))
    front = best
    for _ in range(most_rounds):
        step = front.join(edges.withColumnRenamed("src", "point_id"), POINT_KEYS).groupBy("mesh_id", F.col("dst").alias("point_id")).agg(F.min(F.col("distance") + F.col("length")).alias("new"))
        front = checkpointed(step.join(best, POINT_KEYS, "left").where("distance is null or new < distance").select(*POINT_KEYS, F.col("new").alias("distance")))
        if front.isEmpty():
            break
        best = checkpointed(best.unionAll(front).groupBy(*POINT_KEYS).agg(F.min("distance").alias("distance")))
    return best


def edge_lengths(cells: DataFrame, points: DataFrame) -> DataFrame:
    """mesh_id, src, dst and length of every edge, both ways."""
    from .topology import adjacency

    at = lambda name, p: points.select("mesh_id", F.col("point_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    e = adjacency(cells, "node").join(at("src", "a"), ["mesh_id", "src"]).join(at("dst", "b"), ["mesh_id", "dst"])
    return e.select("mesh_id", "src", "dst", F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in XYZ), F.lit(0.0))).alias("length"))


def signed_distance(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """point_id and distance to a closed triangle surface (mesh_id, cell_id, corners: 3 structs x, y, z), negative inside."""
    from .proximity import nearest_triangles

    near = nearest_triangles(points, triangles)
    return near.select(*POINT_KEYS, (F.col("side") * F.col("distance")).alias("distance"))


#: Triangles that rays are cast against in hand.
MAX_TRIANGLES = 200_000


def winding(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The share of the full sphere that a closed surface covers as seen from each point: 1 inside, 0 outside."""
    a, b, c = (t[None, :, k] - p[:, None] for k in range(3))
    la, lb, lc = (np.linalg.norm(v, axis=2) for v in (a, b, c))
    top = np.einsum("ijk,ijk->ij", a, np.cross(b, c))
    bottom = la * lb * lc + (a * b).sum(2) * lc + (b * c).sum(2) * la + (c * a).sum(2) * lb
    return np.arctan2(top, bottom).sum(1) / (2 * np.pi)
