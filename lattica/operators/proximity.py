"""Points against triangle surfaces of any size: a bucket join whose radius doubles for the points that are still short."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import CELL_KEYS, POINT_KEYS
from .components import checkpointed

XYZ = ("x", "y", "z")
CORNERS = [f"{c}{k}" for k in range(3) for c in XYZ]
PAIR = "mesh_id string, point_id bigint, cell_id bigint, qx double, qy double, qz double, distance double, wx double, wy double, wz double"


def nearest_on(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest place of its triangle (n x 3 x 3), the distance, and the triangle's normal by the angle that it fills there.

    Full turns count inside, half turns on an edge, the corner's angle at a corner.
    """
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    u = n / np.where(size > 0, size, 1)[:, None]
    foot = p - ((p - a) * u).sum(1)[:, None] * u
    inside = size > 0
    best, at = np.full(len(p), np.inf), np.zeros_like(p)
    filled = np.full(len(p), np.pi)
    corners = (a, b, c)
    for k in range(3):
        s, e, o = corners[k], corners[(k + 1) % 3], corners[(k + 2) % 3]
        inside &= (np.cross(e - s, foot - s) * u).sum(1) >= 0
        d = e - s
        w = np.clip(((p - s) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        q = s + w[:, None] * d
        length = np.linalg.norm(p - q, axis=1)
        nearer = length < best
        # at its ends an edge shares a corner: its angle in this triangle
        angle = np.full(len(p), np.pi)
        for end, x, y in ((w <= 0, e - s, o - s), (w >= 1, s - e, o - e)):
            cosine = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-300)
            angle = np.where(end, np.arccos(np.clip(cosine, -1, 1)), angle)
        best, at, filled = np.where(nearer, length, best), np.where(nearer[:, None], q, at), np.where(nearer, angle, filled)
    height = np.abs(((p - a) * u).sum(1))
    best, at, filled = np.where(inside, height, best), np.where(inside[:, None], foot, at), np.where(inside, 2 * np.pi, filled)
    return at, best, u * filled[:, None]


def _judged(batches):
    for g in batches:
        q, d, w = nearest_on(g[["tx", "ty", "tz"]].to_numpy(float), g[CORNERS].to_numpy(float).reshape(-1, 3, 3))
        yield pd.DataFrame({"mesh_id": g.mesh_id, "point_id": g.point_id, "cell_id": g.cell_id, "qx": q[:, 0], "qy": q[:, 1], "qz": q[:, 2], "distance": d, "wx": w[:, 0], "wy": w[:, 1], "wz": w[:, 2]})


def nearest_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, point_id, cell_id, qx, qy, qz, distance and side: the nearest place on a surface, ties to the lower cell.

    ``triangles`` has mesh_id, cell_id and ``corners`` (3 structs x, y, z).
    ``side`` is negative behind the surface, by the normals of all triangles
    that the nearest place is on, each by the angle that it fills there.

    A triangle is dealt to the buckets that its box touches and a point to the
    27 around the place of the surface's box that is nearest to it; as in
    ``spatial.k_nearest``, a point far outside meets no more triangles than one
    inside. Points whose nearest triangle may be farther than the radius go on
    with twice the radius.
    """
    corner = lambda k, c: F.col("corners").getItem(k)[c]
    rows = triangles.select(*CELL_KEYS, *[corner(k, c).alias(f"{c}{k}") for k in range(3) for c in XYZ])
    low = {c: F.least(*[F.col(f"{c}{k}") for k in range(3)]) for c in XYZ}
    high = {c: F.greatest(*[F.col(f"{c}{k}") for k in range(3)]) for c in XYZ}
    boxes = rows.groupBy("mesh_id").agg(*[F.min(low[c]).alias(f"lo{c}") for c in XYZ], *[F.max(high[c]).alias(f"hi{c}") for c in XYZ])
    widest = rows.agg(F.max(F.greatest(*[high[c] - low[c] for c in XYZ]))).first()[0]
    reach = boxes.agg(F.max(F.sqrt(sum(((F.col(f"hi{c}") - F.col(f"lo{c}")) ** 2 for c in XYZ), F.lit(0.0))))).first()[0]
    radius = float(widest or 0.0) or 1.0
    clamped = {c: F.least(F.greatest(F.col(f"t{c}"), F.col(f"lo{c}")), F.col(f"hi{c}")) for c in XYZ}
    open_ = points.select(*POINT_KEYS, *[F.col(c).alias(f"t{c}") for c in XYZ]).join(F.broadcast(boxes), "mesh_id")
    open_ = open_.select(*POINT_KEYS, "tx", "ty", "tz", *[clamped[c].alias(c) for c in XYZ])
    open_ = open_.withColumn("h2", sum(((F.col(c) - F.col(f"t{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{c}") for c, o in zip(XYZ, t, strict=True)]) for t in itertools.product((-1, 0, 1), repeat=3)])
    out = None
    while True:
        last = radius > 2 * float(reach or 0.0)
        bucket = lambda v: F.floor(v / F.lit(radius)).cast("bigint")
        dealt = rows
        for c in XYZ:
            dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(bucket(low[c]), bucket(high[c]))))
        asked = open_.select("*", F.explode(offsets).alias("o")).select("*", *[(bucket(F.col(c)) + F.col(f"o.o{c}")).alias(f"b{c}") for c in XYZ]).drop("o", *XYZ)
        pairs = asked.join(dealt, ["mesh_id", "bx", "by", "bz"]).dropDuplicates([*POINT_KEYS, "cell_id"])
        judged = checkpointed(pairs.select(*POINT_KEYS, "cell_id", "tx", "ty", "tz", *CORNERS).mapInPandas(_judged, PAIR))
        best = judged.groupBy(*POINT_KEYS).agg(F.min("distance").alias("best")).join(open_, POINT_KEYS)
        if not last:
            best = best.where(F.col("best") * F.col("best") <= radius * radius + F.col("h2"))
        best = checkpointed(best.select(*POINT_KEYS, "best", "tx", "ty", "tz"))
        ties = judged.join(best, POINT_KEYS).where(F.col("distance") <= F.col("best") * (1 + 1e-9) + 1e-300)
        along = sum((F.col(f"w{c}") * (F.col(f"t{c}") - F.col(f"q{c}")) for c in XYZ), F.lit(0.0))
        found = ties.groupBy(*POINT_KEYS).agg(F.min(F.struct("cell_id", "qx", "qy", "qz", "distance")).alias("f"), F.sum(along).alias("along"))
        found = checkpointed(found.select(*POINT_KEYS, "f.*", F.when(F.col("along") < 0, -1).otherwise(1).alias("side")))
        out = found if out is None else out.unionAll(found)
        if last:
            return out
        open_ = checkpointed(open_.join(best.select(*POINT_KEYS), POINT_KEYS, "left_anti"))
        if open_.isEmpty():
            return out
        radius *= 2
