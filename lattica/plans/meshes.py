"""Meshes made of the star-schema tables and of lattices, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import MeshFrame
from ..operators.generate import grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_mesh(spark: SparkSession, sf_dir: str) -> MeshFrame:
    """Parts as points, orders as cells, lineitems as incidence; order status and priority as cell regions."""
    part, orders, lines = (table(spark, sf_dir, n) for n in ("part", "orders", "lineitem"))
    mesh = F.lit("orders").alias("mesh_id")
    points = part.select(
        mesh, F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.0).alias("z"), "p_size", "p_retailprice"
    )
    nodes = lines.groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("_n"))
    cells = orders.join(nodes, orders["o_orderkey"] == nodes["cell_id"]).select(
        mesh, "cell_id", F.lit("polygon").alias("cell_type"), F.col("_n.l_partkey").alias("nodes"), "o_totalprice", "o_custkey", "o_orderstatus"
    )
    entry = lambda c: orders.select(mesh, F.lit("cell").alias("kind"), F.col(c).alias("name"), F.lit(2).alias("dim"), F.lit(0).cast("bigint").alias("tag"), F.col("o_orderkey").alias("entity"))
    links = lines.select(mesh, F.col("l_orderkey").alias("cell_id"), F.col("l_linenumber").alias("local"), F.col("l_partkey").alias("point_id"))
    return MeshFrame(points, cells, entry("o_orderstatus").unionAll(entry("o_orderpriority")), links)


def lattice(spark: SparkSession, dims: tuple[int, ...] = (6, 5, 4)) -> MeshFrame:
    """A lattice with the point array u = x^2 + y z + 0.25 x and the cell array m = cell_id % 7."""
    mesh = grid(spark, dims)
    u = F.col("x") * F.col("x") + F.col("y") * F.col("z") + 0.25 * F.col("x")
    return MeshFrame(mesh.points.withColumn("u", u), mesh.cells.withColumn("m", F.col("cell_id") % 7))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components of the embeddings as points."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("cloud").alias("mesh_id"), F.col("vec_id").alias("point_id"), *[F.col("embedding").getItem(k).cast("double").alias(c) for k, c in enumerate("xyz")], "label")


def lattice_sql(nx: int, ny: int, nz: int | None) -> str:
    """The same lattice for DuckDB: pts(point_id, x, y, z, u) and cells(cell_id, nodes, m)."""
    px, py = nx + 1, ny + 1
    n_points = px * py * (1 if nz is None else nz + 1)
    n_cells = nx * ny * (nz or 1)
    ring = f"[v, v + 1, v + {px + 1}, v + {px}" + ("" if nz is None else f", v + {px * py}, v + {px * py + 1}, v + {px * py + px + 1}, v + {px * py + px}") + "]"
    return f"""
WITH pts AS (
  SELECT *, x * x + y * z + 0.25 * x AS u FROM (
    SELECT i AS point_id, (i % {px})::DOUBLE AS x, ((i // {px}) % {py})::DOUBLE AS y, (i // {px * py})::DOUBLE AS z FROM range({n_points}) t(i))),
cells AS (
  SELECT i AS cell_id, {ring} AS nodes, i % 7 AS m FROM (
    SELECT i, ((i // {nx * ny}) * {py} + (i // {nx}) % {ny}) * {px} + i % {nx} AS v FROM range({n_cells}) t(i))),
inc AS (SELECT cell_id, m, unnest(nodes) AS point_id, unnest(range(len(nodes))) AS local FROM cells)
"""
