"""Measured against intended: deviations, fitted elements, tolerances, datums and symmetry."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .geometry import transform
from .spatial import nearest
from .topology import edge_components

XYZ = ("x", "y", "z")
SHARES = (0.01, 0.05, 0.5, 0.95, 0.99)


def deviation_stats(distances: DataFrame, column: str = "distance", tolerance: float = 0.0) -> DataFrame:
    """One row for each mesh: n, min, max, mean, rms, sigma, p1 to p99 (linear between ranks) and the share within ``tolerance``."""
    d = F.col(column)
    parts = [F.percentile(d, F.lit(s)).alias(f"p{round(100 * s)}") for s in SHARES]
    return distances.where(d.isNotNull() & ~F.isnan(d)).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.stddev_pop(d).alias("sigma"), *parts, F.avg((F.abs(d) <= tolerance).cast("double")).alias("within")
    )


def deviation_histogram(distances: DataFrame, lo: float, hi: float, bins: int = 20, column: str = "distance") -> DataFrame:
    """mesh_id, bin, n: how many distances fall in each of equal bins; those beyond an end count in the end's bin."""
    d = F.col(column)
    at = F.least(F.greatest(F.floor((d - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return distances.where(d.isNotNull() & ~F.isnan(d)).groupBy("mesh_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def deviation(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, point_id, distance: signed distance of measured points to a reference surface, negative inside a closed one."""
    from .kernels import signed_distance

    return signed_distance(points, triangles)


def deviation_regions(mesh: MeshFrame, cell_distance: DataFrame, tolerance: float) -> DataFrame:
    """mesh_id, region, kind, cells, worst: pieces of cells (joined by edges) that are beyond the tolerance, excess above and missing below."""
    d = cell_distance.select(*CELL_KEYS, "distance").where(F.abs("distance") > tolerance)
    out = None
    for kind, test in (("excess", F.col("distance") > 0), ("missing", F.col("distance") < 0)):
        side = d.where(test)
        parts = edge_components(mesh.with_(cells=mesh.cells.join(side.select(*CELL_KEYS), CELL_KEYS, "left_semi")))
        rows = parts.join(side, CELL_KEYS).groupBy("mesh_id", F.col("root").alias("region")).agg(F.count(F.lit(1)).alias("cells"), F.max(F.abs("distance")).alias("worst")).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select("mesh_id", "region", "kind", "cells", "worst")


def fit_elements(points: DataFrame, element: str = "element", kinds: dict[str, str] | None = None) -> DataFrame:
    """mesh_id, element, kind, cx, cy, cz, dx, dy, dz, radius, rms: a point, line, plane or sphere through the points of each element.

    ``kinds`` names the kind of each element (plane where it is silent). Only
    moments leave the aggregate; the direction is a line's or a plane's normal.
    """
    r2 = sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0))
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    m = points.groupBy("mesh_id", element).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in pairs], F.avg(r2).alias("mr"), *[F.avg(r2 * F.col(c)).alias(f"mr{c}") for c in XYZ], F.avg(r2 * r2).alias("mrr")
    )
    named = dict(kinds or {})

    def solve(batches):
        for g in batches:
            out = []
            for row in g.to_dict("records"):
                kind = named.get(row[element], "plane")
                mean = np.array([row[f"m{c}"] for c in XYZ])
                second = np.array([[row["m" + "".join(sorted((a, b)))] for b in XYZ] for a in XYZ])
                values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
                values = np.maximum(values, 0)
                centre, axis, radius, rms = mean, np.zeros(3), 0.0, math.sqrt(values.sum())
                if kind == "line":
                    axis, rms = vectors[:, 2], math.sqrt(values[0] + values[1])
                elif kind == "plane":
                    axis, rms = vectors[:, 0], math.sqrt(values[0])
                elif kind == "sphere":
                    lhs = np.zeros((4, 4))
                    lhs[:3, :3], lhs[:3, 3], lhs[3, :3], lhs[3, 3] = 2 * second, mean, 2 * mean, 1
                    s = np.linalg.lstsq(lhs, np.array([row["mrx"], row["mry"], row["mrz"], row["mr"]]), rcond=None)[0]
                    centre, radius = s[:3], math.sqrt(max(s[3] + s[:3] @ s[:3], 0))
                    full = np.zeros((4, 4))
                    full[:3, :3], full[:3, 3], full[3, :3], full[3, 3] = second, mean, mean, 1
                    c4 = np.array([*(2 * s[:3]), s[3]])
                    square = row["mrr"] - 2 * c4 @ np.array([row["mrx"], row["mry"], row["mrz"], row["mr"]]) + c4 @ full @ c4
                    rms = math.sqrt(max(square, 0)) / max(2 * radius, 1e-300)
                # the largest entry of a direction is positive
                if axis[np.abs(axis).argmax()] < 0:
                    axis = -axis
                out.append((row["mesh_id"], row[element], kind, *map(float, centre), *map(float, axis), float(radius), float(rms)))
            yield pd.DataFrame(out, columns=["mesh_id", element, "kind", "cx", "cy", "cz", "dx", "dy", "dz", "radius", "rms"])

    kind_of = dict(points.dtypes)[element]
    return m.mapInPandas(solve, f"mesh_id string, {element} {kind_of}, kind string, cx double, cy double, cz double, dx double, dy double, dz double, radius double, rms double")


def dimensions(elements: DataFrame, spec: DataFrame, element: str = "element") -> DataFrame:
    """The rows of ``spec`` (name, kind, a, b, nominal, low, high) with value, deviation and verdict (PASS or FAIL).

    Kinds: distance between centres, or from the centre of ``a`` to the plane
    ``b``; angle between directions in degrees (0 to 90); radius and diameter of
    ``a``; flatness, twice the root mean square of ``a``.
    """
    side = lambda p: elements.select("mesh_id", F.col(element).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("kind", "cx", "cy", "cz", "dx", "dy", "dz", "radius", "rms")])
    rows = spec.join(side("a"), "a").join(side("b").withColumnRenamed("mesh_id", "_m"), "b", "left").where("_m is null or _m = mesh_id")
    dot = sum((F.col(f"a_d{c}") * F.col(f"b_d{c}") for c in XYZ), F.lit(0.0))
    gap = F.sqrt(sum(((F.col(f"a_c{c}") - F.col(f"b_c{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    height = F.abs(sum(((F.col(f"a_c{c}") - F.col(f"b_c{c}")) * F.col(f"b_d{c}") for c in XYZ), F.lit(0.0)))
    kind = F.col("kind")
    value: Column = (
        F.when(kind == "distance", F.when(F.col("b_kind") == "plane", height).otherwise(gap))
        .when(kind == "angle", F.degrees(F.acos(F.least(F.abs(dot), F.lit(1.0)))))
        .when(kind == "radius", F.col("a_radius"))
        .when(kind == "diameter", 2 * F.col("a_radius"))
        .when(kind == "flatness", 2 * F.col("a_rms"))
    )
    out = rows.withColumn("value", value).withColumn("deviation", F.col("value") - F.col("nominal"))
    ok = (F.col("deviation") >= F.col("low")) & (F.col("deviation") <= F.col("high"))
    return out.select("mesh_id", "name", "kind", "a", "b", "nominal", "low", "high", "value", "deviation", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


def align_datums(primary: tuple[float, float, float], secondary: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[list[float]]:
    """The rigid map whose z axis is the primary direction, x the part of the secondary across it, and zero the origin."""
    z = np.array(primary, float) / np.linalg.norm(primary)
    x = np.array(secondary, float) - (np.array(secondary) @ z) * z
    if np.linalg.norm(x) < 1e-12:
        raise ValueError("the datums are parallel")
    x /= np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, -r @ np.array(origin, float)
    return out.tolist()


def principal_frame(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, axes (columns, largest spread first) and spreads of the points: one aggregated row."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    r = points.agg(*[F.avg(c).alias(c) for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs]).first()
    mean = np.array([r[c] for c in XYZ])
    second = np.array([[r["".join(sorted((a, b)))] for b in XYZ] for a in XYZ])
    values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
    return mean, vectors[:, ::-1], np.maximum(values[::-1], 0)


def _score(moved: DataFrame, target: DataFrame) -> float:
    """Root mean square distance of the points to the nearest of ``target``."""
    return float(nearest(moved, target).agg(F.sqrt(F.avg("d2"))).first()[0] or 0.0)


def auto_align(source: DataFrame, target: DataFrame) -> tuple[np.ndarray, float]:
    """The rigid start that brings principal frames together, of the turns that keep them right-handed the one that fits best, and its distance.

    Axes change places only where their spreads are within a tenth of one
    another; each candidate is one nearest join and one aggregated row.
    """
    a, va, spread = principal_frame(source)
    b, vb, _ = principal_frame(target)
    best = (math.inf, np.eye(4))
    rows = source.select(*POINT_KEYS, *XYZ)
    for order in itertools.permutations(range(3)):
        if any(abs(spread[i] - spread[k]) > 0.1 * max(spread[0], 1e-300) for i, k in enumerate(order)):
            continue
        for signs in itertools.product((1, -1), repeat=3):
            r = vb @ (va[:, order] * np.array(signs)).T
            if np.linalg.det(r) < 0:
                continue
            m = np.eye(4)
            m[:3, :3], m[:3, 3] = r, b - r @ a
            score = _score(transform(rows, m.tolist()), target)
            if score < best[0]:
                best = (score, m)
    return best[1], best[0]


def find_symmetry_plane(points: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, normal and distance of the mirror plane through the centre, across a principal axis, that fits best."""
    from .geometry import mirror

    centre, axes, _ = principal_frame(points)
    best = (math.inf, axes[:, 0])
    for k in range(3):
        n = axes[:, k]
        score = _score(mirror(points.select(*POINT_KEYS, *XYZ), tuple(map(float, centre)), tuple(map(float, n))), points)
        if score < best[0]:
            best = (score, n)
    return centre, best[1], best[0]


def measure_table(elements: DataFrame, element: str = "element") -> DataFrame:
    """The elements as rows in the order of their names, with a number."""
    return elements.withColumn("row", F.row_number().over(Window.partitionBy("mesh_id").orderBy(element)) - 1)
