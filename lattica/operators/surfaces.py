"""Surfaces and clouds in hand: closest points, rays, clipping, shells, triangulations and orders.

As in ``kernels``, one mesh is one group, or the smaller side is checked
against a limit before it is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_nan
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .cotangent import most_normal_offsets
from .geometry import cell_normals, centroids
from .kernels import MAX_TRIANGLES, XYZ
from .proximity import nearest_triangles
from .spatial import as_other, within
from .topology import facets


def held_triangles(triangles: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(cell ids, n x 3 x 3 corners) of each mesh; an error beyond MAX_TRIANGLES."""
    n = triangles.count()
    if n > MAX_TRIANGLES:
        raise ValueError(f"{n} triangles are over {MAX_TRIANGLES}; cut the surface into meshes first")
    names = [f"{c}{k}" for k in range(3) for c in XYZ]
    rows = triangles.select(*CELL_KEYS, *[F.col("corners").getItem(int(m[1]))[m[0]].alias(m) for m in names]).toPandas().sort_values("cell_id")
    return {m: (g.cell_id.to_numpy(), g[names].to_numpy().reshape(-1, 3, 3)) for m, g in rows.groupby("mesh_id")}


def closest_points(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, point_id, cell_id, qx, qy, qz, distance: the nearest point on a triangle surface, and the triangle it is on."""
    return nearest_triangles(points, triangles).drop("side")


def shrinkwrap(points: DataFrame, triangles: DataFrame, weight: float = 1.0, max_distance: float = 0.0) -> DataFrame:
    """Points moved towards the surface by ``weight``; those farther than ``max_distance`` (if it is over 0) stay."""
    near = closest_points(points, triangles).drop("cell_id")
    joined = points.join(near, POINT_KEYS, "left")
    moves = F.col("distance").isNotNull() & ((F.lit(max_distance) <= 0) | (F.col("distance") <= max_distance))
    moved = {c: F.when(moves, F.col(c) + weight * (F.col(f"q{c}") - F.col(c))).otherwise(F.col(c)) for c in XYZ}
    return joined.withColumns(moved).drop("qx", "qy", "qz", "distance")


def contact_pairs(slave: DataFrame, master: DataFrame, max_gap: float) -> DataFrame:
    """point_id, cell_id and gap: the nearest master triangle of each slave point; cell_id is null beyond ``max_gap``."""
    near = closest_points(slave, master)
    return near.select(*POINT_KEYS, F.when(F.col("distance") <= max_gap, F.col("cell_id")).alias("cell_id"), F.col("distance").alias("gap"))


def thickness(triangles: DataFrame, inward: bool = True) -> DataFrame:
    """cell_id and thickness: along a ray from the centroid of each triangle to the next one, null where there is none.

    Inward rays run against the normal. A triangle never hits itself.
    """
    held = held_triangles(triangles)

    def run(batches):
        for b in batches:
            out = []
            for mesh, g in b.groupby("mesh_id"):
                ids, t = held[mesh]
                place = {v: k for k, v in enumerate(ids)}
                a, e1, e2 = t[:, 0], t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
                n = np.cross(e1, e2)
                n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
                for cell in g.cell_id:
                    k = place[cell]
                    o, d = t[k].mean(0), n[k] * (-1 if inward else 1)
                    h = np.cross(d, e2)
                    det = (e1 * h).sum(1)
                    ok = np.abs(det) > 1e-14
                    inv = 1 / np.where(ok, det, 1)
                    s = o - a
                    u = (s * h).sum(1) * inv
                    q = np.cross(s, e1)
                    v = (q * d).sum(1) * inv
                    far = (e2 * q).sum(1) * inv
                    hit = ok & (u >= 0) & (v >= 0) & (u + v <= 1) & (far > 1e-12)
                    hit[k] = False
                    out.append((mesh, cell, float(far[hit].min()) if hit.any() else None))
            yield pd.DataFrame(out, columns=["mesh_id", "cell_id", "thickness"])

    return triangles.select(*CELL_KEYS).mapInPandas(run, "mesh_id string, cell_id bigint, thickness double")


def offset_points(mesh: MeshFrame, distance: float) -> MeshFrame:
    """The surface moved so that the plane of every face moves by ``distance``: each point along its most-normal normal."""
    n = most_normal_offsets(mesh)
    moved = {c: F.col(c) + distance * F.coalesce(F.col(f"m{c}"), F.lit(0.0)) for c in XYZ}
    return mesh.with_(points=mesh.points.join(n, POINT_KEYS, "left").withColumns(moved).drop("mx", "my", "mz"))


def thicken(mesh: MeshFrame, distance: float) -> MeshFrame:
    """Wedges and hexahedra between a surface and its offset."""
    last = mesh.points.groupBy("mesh_id").agg((F.max("point_id") + 1).alias("_n"))
    lifted = offset_points(mesh, distance).points.join(F.broadcast(last), "mesh_id").withColumn("point_id", F.col("point_id") + F.col("_n")).drop("_n")
    cells = mesh.cells.join(F.broadcast(last), "mesh_id")
    cells = cells.withColumn("nodes", F.concat("nodes", F.transform("nodes", lambda n: n + F.col("_n")))).drop("_n")
    kind = F.when(F.col("cell_type") == "triangle", "wedge").otherwise("hexahedron")
    return mesh.with_(points=mesh.points.unionByName(lifted), cells=cells.withColumn("cell_type", kind))


def find_interface_proximity(mesh: MeshFrame, a: DataFrame, b: DataFrame, gap: float, max_angle: float = 30.0) -> DataFrame:
    """cell_a, cell_b, distance: for each face of ``a`` (mesh_id, cell_id) the nearest face of ``b`` within ``gap`` whose normal opposes it."""
    at = centroids(mesh).withColumnsRenamed({"cx": "x", "cy": "y", "cz": "z"}).join(cell_normals(mesh), CELL_KEYS)
    left = at.join(a.select(*CELL_KEYS), CELL_KEYS, "left_semi").withColumnRenamed("cell_id", "point_id")
    right = as_other(at.join(b.select(*CELL_KEYS), CELL_KEYS, "left_semi"), "cell_id", ["nx", "ny", "nz"])
    pairs = within(left, right, gap, ["mesh_id"])
    cosine = sum((F.col(f"n{c}") * F.col(f"other_n{c}") for c in XYZ), F.lit(0.0))
    best = pairs.where(cosine <= -math.cos(math.radians(max_angle))).groupBy("mesh_id", F.col("point_id").alias("cell_a")).agg(F.min(F.struct("d2", "other_id")).alias("m"))
    return best.select("mesh_id", "cell_a", F.col("m.other_id").alias("cell_b"), F.sqrt("m.d2").alias("distance"))


def clip_triangles(mesh: MeshFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """mesh_id, parent, polygon (array of x, y, z structs): what is left of each triangle below a plane.

    Native: each side gives its lower end and its crossing, in order.
    """
    size = math.sqrt(sum(v * v for v in normal))
    rows = mesh.with_corners().where("cell_type = 'triangle'")
    corners = [F.col("corners").getItem(k) for k in range(3)]
    d = [sum(((p[c] - o) * (v / size) for c, o, v in zip(XYZ, origin, normal, strict=True)), F.lit(0.0)) for p in corners]
    parts = []
    for k in range(3):
        j = (k + 1) % 3
        t = d[k] / (d[k] - d[j])
        cross_ = F.struct(*[(corners[k][c] + t * (corners[j][c] - corners[k][c])).alias(c) for c in XYZ])
        parts.append(F.when(d[k] < 0, F.struct(*[corners[k][c].alias(c) for c in XYZ])))
        parts.append(F.when((d[k] < 0) != (d[j] < 0), cross_))
    polygon = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return rows.select("mesh_id", F.col("cell_id").alias("parent"), polygon.alias("polygon")).where("size(polygon) >= 3")


def subdivide(mesh: MeshFrame) -> DataFrame:
    """mesh_id, parent, facet, faces: each solid as one polyhedron for each of its faces, the face and a triangle from each of its edges to the middle.

    The middle has the id -1 - parent; its place is the mean of the corners
    (``geometry.centroids``).
    """
    f = facets(mesh.cells).select(*CELL_KEYS, "facet", F.col("facet_nodes").alias("n"))
    middle = (-1 - F.col("cell_id")).cast("bigint")
    turned = F.concat(F.slice("n", 2, F.size("n") - 1), F.slice("n", 1, 1))
    sides = F.zip_with("n", turned, lambda a, b: F.array(b, a, middle))
    return f.select("mesh_id", F.col("cell_id").alias("parent"), "facet", F.concat(F.array("n"), sides).alias("faces"))


def metric_from_hessian(hessians: DataFrame, error: float = 0.01, hmin: float = 1e-3, hmax: float = 1.0) -> DataFrame:
    """mesh_id, cell_id and m_xx ... of the metric |H| / error with eigenvalues between 1/hmax^2 and 1/hmin^2."""
    pairs = [(a, b) for a in XYZ for b in XYZ]

    def run(batches):
        for b in batches:
            h = b[[f"h_{p}{q}" for p, q in pairs]].to_numpy().reshape(-1, 3, 3)
            ok = np.isfinite(h).all((1, 2))
            h = np.where(ok[:, None, None], (h + h.transpose(0, 2, 1)) / 2, 0)
            w, v = np.linalg.eigh(h)
            w = np.clip(np.abs(w) / error, 1 / hmax**2, 1 / hmin**2)
            m = np.einsum("nij,nj,nkj->nik", v, w, v)
            m[~ok] = np.nan
            yield pd.DataFrame({"mesh_id": b.mesh_id, "cell_id": b.cell_id} | {f"m_{p}{q}": m[:, i // 3, i % 3] for i, (p, q) in enumerate(pairs)})

    names = [f"m_{p}{q}" for p, q in pairs]
    made = hessians.mapInPandas(run, "mesh_id string, cell_id bigint, " + ", ".join(f"{n} double" for n in names))
    return made.withColumns({n: or_nan(F.col(n)) for n in names})  # pandas hands NaN over as null


def reorder_rcm(graph: DataFrame) -> DataFrame:
    """mesh_id, point_id, new_id: reverse Cuthill-McKee order of each graph (mesh_id, src, dst both ways).

    Each component starts from its point of least degree, ties by id;
    neighbours follow by degree, then id.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = defaultdict(list)
        for s, d in zip(g.src, g.dst, strict=True):
            near[s].append(d)
        key = lambda v: (len(near[v]), v)
        order, seen = [], set()
        for start in sorted(near, key=key):
            if start in seen:
                continue
            seen.add(start)
            line = deque([start])
            while line:
                v = line.popleft()
                order.append(v)
                for w in sorted((x for x in near[v] if x not in seen), key=key):
                    seen.add(w)
                    line.append(w)
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[0], "point_id": order[::-1], "new_id": range(len(order))})

    return graph.groupBy("mesh_id").applyInPandas(one, "mesh_id string, point_id bigint, new_id bigint")


def no_triangles() -> pd.DataFrame:
    return pd.DataFrame({"mesh_id": pd.Series([], dtype=str), **{c: pd.Series([], dtype="int64") for c in "abc"}})


def along_curve(p: np.ndarray) -> np.ndarray:
    """Places of points of the plane in Morton order, so that those inserted one after the other are near."""
    low = p.min(0)
    q = ((p - low) / max(np.ptp(p, axis=0).max(), 1e-300) * 65535).astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        q = (q | q << np.uint64(shift)) & np.uint64(mask)
    return np.argsort(q[:, 0] | q[:, 1] << np.uint64(1), kind="stable")


class Triangulation:
    """Delaunay triangles of distinct points, inserted one by one.

    ``third`` has the point opposite each directed edge, whose key is
    a * (n + 1) + b; n stands for the outside, so the hull is exact. A point is
    found by a walk from the last one. Signs are exact: where rounding could
    change one, it is worked out in fractions.
    """

    def __init__(self, p: np.ndarray):
        self.n = len(p)
        self.x, self.y = p[:, 0].tolist(), p[:, 1].tolist()
        self.third: dict[int, int] = {}
        first = next((k for k in range(2, self.n) if self.turn(0, 1, k)), None) if self.n > 2 else None
        if first is None:
            return
        a, b, c = (0, 1, first) if self.turn(0, 1, first) > 0 else (1, 0, first)
        for t in ((a, b, c), (b, a, self.n), (c, b, self.n), (a, c, self.n)):
            self.put(*t)
        self.last = (a, b, c)
        for k in range(2, self.n):
            if k != first:
                self.insert(k)

    def put(self, a: int, b: int, c: int) -> None:
        m = self.n + 1
        self.third[a * m + b], self.third[b * m + c], self.third[c * m + a] = c, a, b

    def turn(self, a: int, b: int, c: int) -> float:
        """Over 0 where a, b, c turn left, 0 on a line."""
        x, y = self.x, self.y
        left, right = (x[a] - x[c]) * (y[b] - y[c]), (y[a] - y[c]) * (x[b] - x[c])
        d = left - right
        if abs(d) > 4e-16 * (abs(left) + abs(right)):
            return d
        ax, ay, bx, by, cx, cy = (Fraction(v) for k in (a, b, c) for v in (x[k], y[k]))
        d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        return (d > 0) - (d < 0)

    def holds(self, a: int, b: int, c: int, k: int) -> bool:
        """Whether k is inside the circle around a, b, c, which for an edge of the hull is what lies beyond it."""
        while a == self.n or b == self.n:
            a, b, c = b, c, a
        x, y = self.x, self.y
        if c == self.n:
            side = self.turn(a, b, k)
            return side > 0 or (side == 0 and min(x[a], x[b]) <= x[k] <= max(x[a], x[b]) and min(y[a], y[b]) <= y[k] <= max(y[a], y[b]))
        px, py = x[k], y[k]
        adx, ady, bdx, bdy, cdx, cdy = x[a] - px, y[a] - py, x[b] - px, y[b] - py, x[c] - px, y[c] - py
        bc, cb, ca, ac, ab, ba = bdx * cdy, cdx * bdy, cdx * ady, adx * cdy, adx * bdy, bdx * ady
        al, bl, cl = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
        d = al * (bc - cb) + bl * (ca - ac) + cl * (ab - ba)
        if abs(d) > 1.2e-15 * (al * (abs(bc) + abs(cb)) + bl * (abs(ca) + abs(ac)) + cl * (abs(ab) + abs(ba))):
            return d > 0
        px, py = Fraction(px), Fraction(py)
        (adx, ady), (bdx, bdy), (cdx, cdy) = ((Fraction(x[v]) - px, Fraction(y[v]) - py) for v in (a, b, c))
        al, bl, cl = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
        return al * (bdx * cdy - cdx * bdy) + bl * (cdx * ady - adx * cdy) + cl * (adx * bdy - bdx * ady) > 0

    def insert(self, k: int) -> None:
        third, m, n = self.third, self.n + 1, self.n
        a, b, c = self.last
        while c != n:
            for u, v in ((a, b), (b, c), (c, a)):
                if self.turn(u, v, k) < 0:
                    a, b, c = v, u, third[v * m + u]
                    break
            else:
                break
        edges = [(a, b), (b, c), (c, a)]
        for u, v in edges:
            del third[u * m + v]
        rim = []
        while edges:
            u, v = edges.pop()
            w = third.get(v * m + u)
            if w is None:
                continue
            if self.holds(v, u, w, k):
                del third[v * m + u], third[u * m + w], third[w * m + v]
                edges += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            self.put(u, v, k)
            if u != n and v != n:
                self.last = (u, v, k)

    def triangles(self) -> list[tuple[int, int, int]]:
        m = self.n + 1
        found = ((*divmod(e, m), c) for e, c in self.third.items())
        return [(a, b, c) for a, b, c in found if a < b and a < c and max(b, c) < self.n]


def delaunay_2d(points: DataFrame) -> DataFrame:
    """mesh_id, a, b, c (a the least, counter-clockwise): the Delaunay triangles of each cloud in the xy plane, by insertion.

    Of points at one place the least identifier counts; those without a finite
    place are left out. Points on one line have no triangles.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g[np.isfinite(g[["x", "y"]].to_numpy(float)).all(1)].sort_values("point_id").drop_duplicates(["x", "y"])
        if len(g) < 3:
            return no_triangles()
        p = g[["x", "y"]].to_numpy(float)
        order = along_curve(p)
        ids = g.point_id.to_numpy()[order]
        t = ids[np.array(Triangulation(p[order]).triangles(), np.int64).reshape(-1, 3)]
        least = t.argmin(1)
        t = t[np.arange(len(t))[:, None], (least[:, None] + np.arange(3)) % 3]
        t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 0]))]
        return pd.DataFrame({"mesh_id": g.mesh_id.iloc[0], "a": t[:, 0], "b": t[:, 1], "c": t[:, 2]}) if len(t) else no_triangles()

    return points.select(*POINT_KEYS, "x", "y").groupBy("mesh_id").applyInPandas(one, "mesh_id string, a bigint, b bigint, c bigint")


def convex_hull(points: DataFrame) -> DataFrame:
    """mesh_id, a, b, c: triangles of the hull of each cloud in space, wound outwards, by insertion of the points outside."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id").drop_duplicates(XYZ)
        ids, p = g.point_id.to_numpy(), g[XYZ].to_numpy(float)
        if len(p) < 4:
            return no_triangles()
        scale = max(np.ptp(p, axis=0).max(), 1e-300)
        i = 0
        j = int(np.argmax(((p - p[i]) ** 2).sum(1)))
        k = int(np.argmax(np.linalg.norm(np.cross(p - p[i], p[j] - p[i]), axis=1)))
        normal = np.cross(p[j] - p[i], p[k] - p[i])
        l = int(np.argmax(np.abs((p - p[i]) @ normal)))
        if abs((p[l] - p[i]) @ normal) <= 1e-12 * scale**3:
            return no_triangles()
        inner = p[[i, j, k, l]].mean(0)

        def plane(t):
            n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
            return n, n @ p[t[0]]

        faces = {}
        for t in ((i, j, k), (i, j, l), (i, k, l), (j, k, l)):
            n, d = plane(t)
            t = t if n @ inner < d else (t[0], t[2], t[1])
            faces[t] = plane(t)
        for v in range(len(p)):
            seen = [t for t, (n, d) in faces.items() if n @ p[v] - d > 1e-12 * scale**3]
            rim = {e for t in seen for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
            for t in seen:
                del faces[t]
            for a, b in rim:
                if (b, a) not in rim:
                    faces[(a, b, v)] = plane((a, b, v))
        return pd.DataFrame([[ids[x] for x in t] for t in faces], columns=["a", "b", "c"]).assign(mesh_id=g.mesh_id.iloc[0])[["mesh_id", "a", "b", "c"]]

    return points.select(*POINT_KEYS, *XYZ).groupBy("mesh_id").applyInPandas(one, "mesh_id string, a bigint, b bigint, c bigint")
