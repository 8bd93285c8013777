"""What training on meshes needs: edge vectors, world edges, augmentation, budgets and health."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..mesh import POINT_KEYS, MeshFrame
from .geometry import with_measure
from .ordering import grid_points, random_points
from .spatial import bucketed_pairs, k_nearest
from .topology import edges

XYZ = ("x", "y", "z")


def edge_vectors(graph: DataFrame, points: DataFrame) -> DataFrame:
    """mesh_id, src, dst, dx, dy, dz (source less destination) and length of each edge."""
    at = lambda name, p: points.select("mesh_id", F.col("point_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    rows = graph.select("mesh_id", "src", "dst").join(at("src", "s"), ["mesh_id", "src"]).join(at("dst", "t"), ["mesh_id", "dst"])
    d = [(F.col(f"s{c}") - F.col(f"t{c}")) for c in XYZ]
    return rows.select("mesh_id", "src", "dst", *[v.alias(f"d{c}") for c, v in zip(XYZ, d, strict=True)], F.sqrt(sum((v * v for v in d), F.lit(0.0))).alias("length"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """mesh_id, src, dst: each pair (a, b) in both directions, from one pass."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select("mesh_id", F.inline(ends))


def proximity_graph(points: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """mesh_id, src, dst, both ways: points at most ``radius`` apart, or each point with its k nearest and those it is near to."""
    if radius is not None:
        return both_ways(bucketed_pairs(points, radius))
    near = k_nearest(points, points, k or 1).select("mesh_id", F.col("point_id").alias("src"), F.col("other_id").alias("dst"))
    return near.unionAll(near.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def world_edges(mesh: MeshFrame, radius: float) -> DataFrame:
    """mesh_id, src, dst, both ways: points at most ``radius`` apart that no edge of the mesh joins."""
    joined = edges(mesh.cells).select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # the optimiser takes cells made of a range for small ones and would send all their edges to the driver
    return both_ways(bucketed_pairs(mesh.points, radius).join(joined.hint("merge"), ["mesh_id", "a", "b"], "left_anti"))


def bistride(graph: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """mesh_id, point_id, ring, kept: rings of a breadth-first walk from the seeds (mesh_id, point_id), of which every other one is kept."""
    from .components import checkpointed

    seen = checkpointed(seeds.select(*POINT_KEYS, F.lit(0).alias("ring")).distinct())
    front = seen
    for ring in range(1, rounds):
        step = front.join(graph.withColumnRenamed("src", "point_id"), POINT_KEYS).select("mesh_id", F.col("dst").alias("point_id")).distinct()
        front = checkpointed(step.join(seen, POINT_KEYS, "left_anti").withColumn("ring", F.lit(ring)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionAll(front)) if ring % 8 == 0 else seen.unionAll(front)
    return seen.withColumn("kept", F.col("ring") % 2 == 0)


def subsample_points(points: DataFrame, budget: int, method: str = "random", seed: int = 0, cell: float | None = None) -> DataFrame:
    """The points of a budget with all their columns and ``original_id``: a seeded draw, or one point of each lattice cell."""
    chosen = random_points(points, budget, seed) if method == "random" else grid_points(points, cell or 1.0)
    return points.join(chosen.select(*POINT_KEYS), POINT_KEYS, "left_semi").withColumn("original_id", F.col("point_id"))


def augmentation(seed: int, rotate: bool = True, translate: float = 0.0, scale: tuple[float, float] = (1.0, 1.0)) -> list[list[float]]:
    """A random affine map that the seed sets: a uniform rotation, a uniform scale and a shift within a cube."""
    rng = np.random.default_rng(seed)
    q = rng.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = (r if rotate else np.eye(3)) * rng.uniform(*scale)
    out[:3, 3] = rng.uniform(-translate, translate, 3) if translate else 0.0
    return out.tolist()


def augment(points: DataFrame, seed: int, vectors: list[tuple[str, str, str]] | None = None, **options) -> DataFrame:
    """The points under ``augmentation``; vector arrays turn with them."""
    from .geometry import transform

    return transform(points, augmentation(seed, **options), vectors)


def dataset_health(mesh: MeshFrame, splits: DataFrame | None = None) -> DataFrame:
    """One row for each mesh: points, NaN and infinite entries of its arrays, cells, inverted and empty cells, and its split where ``splits`` (mesh_id, split) has it."""
    numbers = [c for c, k in mesh.points.dtypes if k in ("double", "float")]
    nan = sum((F.sum(F.isnan(F.col(c)).cast("bigint")) for c in numbers), F.lit(0))
    bad = sum((F.sum((~finite(F.col(c)) & F.col(c).isNotNull() & ~F.isnan(F.col(c))).cast("bigint")) for c in numbers), F.lit(0))
    p = mesh.points.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("points"), nan.alias("nan_entries"), bad.alias("inf_entries"))
    m = with_measure(mesh).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("measure") < 0).alias("inverted"), F.count_if(F.col("measure") == 0).alias("empty"))
    out = p.join(m, "mesh_id", "left")
    return out if splits is None else out.join(splits.select("mesh_id", "split"), "mesh_id", "left")


def split_balance(splits: DataFrame) -> DataFrame:
    """split, n and share of the meshes in each split."""
    n = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("split", "n", (F.col("n") / F.col("_all")).alias("share"))


def topology_hash(cells: DataFrame) -> DataFrame:
    """mesh_id and a hash of its connectivity that does not depend on the order of rows: equal ones can share their edges."""
    row = F.xxhash64("cell_id", "cell_type", "nodes")
    return cells.groupBy("mesh_id").agg(F.bit_xor(row).alias("topology"), F.count(F.lit(1)).alias("cells"))


