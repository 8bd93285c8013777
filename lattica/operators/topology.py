"""Facets, surfaces, graphs and components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..celltypes import EDGES, FACETS, dimension, tuples
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .components import connected_components
from .geometry import cell_normals


def facets(cells: DataFrame) -> DataFrame:
    """mesh_id, cell_id, facet (its number), nodes (wound outwards) and key (sorted nodes)."""
    return cells.select(
        *CELL_KEYS, "cell_type", F.posexplode(tuples(F.col("cell_type"), F.col("nodes"), FACETS)).alias("facet", "facet_nodes")
    ).select(*CELL_KEYS, "cell_type", "facet", "facet_nodes", F.array_sort("facet_nodes").alias("key"))


def edges(cells: DataFrame) -> DataFrame:
    """mesh_id, cell_id, edge (its number), a and b as the cell runs along it."""
    return cells.select(*CELL_KEYS, F.posexplode(tuples(F.col("cell_type"), F.col("nodes"), EDGES)).alias("edge", "ends")).select(
        *CELL_KEYS, "edge", F.col("ends").getItem(0).alias("a"), F.col("ends").getItem(1).alias("b")
    )


def unique_edges(cells: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, and uses, how many cells have the edge and how many run from lo to hi."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return edges(cells).groupBy("mesh_id", lo.alias("lo"), hi.alias("hi")).agg(
        F.count(F.lit(1)).alias("uses"), F.count_if(F.col("a") < F.col("b")).alias("forward")
    )


def extract_surface(cells: DataFrame) -> DataFrame:
    """Facets used exactly once by cells of the top dimension: mesh_id, cell_id (parent), facet, nodes."""
    top = cells.groupBy("mesh_id").agg(F.max(dimension(F.col("cell_type"))).alias("_top"))
    solid = cells.join(F.broadcast(top), "mesh_id").where(dimension(F.col("cell_type")) == F.col("_top"))
    once = (
        facets(solid)
        .groupBy("mesh_id", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cell_id", "facet", "facet_nodes")).alias("f"))
        .where("n = 1")
    )
    return once.select("mesh_id", F.col("f.cell_id").alias("cell_id"), F.col("f.facet").alias("facet"), F.col("f.facet_nodes").alias("nodes"))


def surface_mesh(mesh: MeshFrame) -> MeshFrame:
    """The surface as a mesh of its own: used points, and cells numbered by parent and facet."""
    from .ordering import numbered

    n = F.size("nodes")
    kind = F.when(n == 1, "vertex").when(n == 2, "line").when(n == 3, "triangle").otherwise("quad")
    rows = extract_surface(mesh.cells).withColumnRenamed("cell_id", "parent")
    made = numbered(rows, ["parent", "facet"], "cell_id").select("mesh_id", "cell_id", kind.alias("cell_type"), "nodes", "parent", "facet")
    used = made.select("mesh_id", F.explode("nodes").alias("point_id")).distinct()
    return MeshFrame(mesh.points.join(used, POINT_KEYS, "left_semi"), made)


def watertight_check(cells: DataFrame) -> DataFrame:
    """One row for each mesh: edges that are open, shared by over two, or run the same way by both faces."""
    return unique_edges(cells).groupBy("mesh_id").agg(
        F.count_if(F.col("uses") == 1).alias("open"),
        F.count_if(F.col("uses") > 2).alias("non_manifold"),
        F.count_if((F.col("uses") == 2) & (F.col("forward") != 1)).alias("inconsistent"),
    )


def feature_edges(mesh: MeshFrame, angle: float = 30.0) -> DataFrame:
    """mesh_id, lo, hi, class: 1 feature, 2 boundary, 3 non-manifold, 4 inconsistent; other edges are left out."""
    faces = mesh.cells.where(F.col("cell_type").isin("triangle", "quad"))
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    along = edges(faces).join(cell_normals(mesh), CELL_KEYS).select("mesh_id", lo, hi, (F.col("a") < F.col("b")).cast("int").alias("f"), F.struct("nx", "ny", "nz").alias("n"))
    grouped = along.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("uses"), F.sum("f").alias("forward"), F.slice(F.collect_list("n"), 1, 2).alias("n"))
    a, b = F.col("n").getItem(0), F.col("n").getItem(1)
    cosine = a["nx"] * b["nx"] + a["ny"] * b["ny"] + a["nz"] * b["nz"]
    kind = (
        F.when(F.col("uses") > 2, 3)
        .when(F.col("uses") == 1, 2)
        .when(F.col("forward") != 1, 4)
        .when(cosine < math.cos(math.radians(angle)), 1)
    )
    return grouped.withColumn("class", kind).where("class is not null").select("mesh_id", "lo", "hi", "class")


def adjacency(cells: DataFrame, kind: str = "node") -> DataFrame:
    """mesh_id, src, dst, both ways, without loops and repeats: points on an edge, points in a cell (clique), or cells by facet (cell)."""
    if kind == "node":
        pairs = edges(cells).select("mesh_id", F.col("a").alias("src"), F.col("b").alias("dst"))
        pairs = pairs.unionAll(pairs.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    elif kind == "clique":
        # both ends from the same row: no join
        pairs = cells.select("mesh_id", "nodes", F.explode("nodes").alias("src")).select("mesh_id", "src", F.explode("nodes").alias("dst"))
    else:
        mine = facets(cells).select("mesh_id", "key", "cell_id")
        pairs = mine.withColumnRenamed("cell_id", "src").join(mine.withColumnRenamed("cell_id", "dst"), ["mesh_id", "key"]).select("mesh_id", "src", "dst")
    return pairs.where("src <> dst").distinct()


def graph_summary(graph: DataFrame) -> DataFrame:
    """One row for each mesh: vertices with a neighbour, undirected edges, largest degree."""
    degree = graph.groupBy("mesh_id", "src").agg(F.count(F.lit(1)).alias("d"))
    return degree.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), (F.sum("d") / 2).cast("bigint").alias("edges"), F.max("d").alias("max_degree"))


def compute_bandwidth(cells: DataFrame) -> DataFrame:
    """Largest difference between two nodes of a cell: from each cell's least and greatest, without pairs."""
    return cells.groupBy("mesh_id").agg(F.max(F.array_max("nodes") - F.array_min("nodes")).alias("bandwidth"))


def region_adjacency(cells: DataFrame, regions: DataFrame, names: list[str]) -> DataFrame:
    """mesh_id, region_a, region_b, shared: facets between cells of different regions, names ascending."""
    entries = regions.where((F.col("kind") == "cell") & F.col("name").isin(names)).select("mesh_id", F.col("entity").alias("cell_id"), F.col("name").alias("region"))
    mine = facets(cells).join(entries, CELL_KEYS).select("mesh_id", "key", "cell_id", "region")
    other = mine.select("mesh_id", "key", F.col("cell_id").alias("cell_b"), F.col("region").alias("region_b"))
    pairs = mine.join(other, ["mesh_id", "key"]).where("cell_id <> cell_b and region < region_b")
    return pairs.groupBy("mesh_id", F.col("region").alias("region_a"), "region_b").agg(F.count_distinct("key").alias("shared"))


def find_interface(cells: DataFrame, regions: DataFrame, a: str, b: str) -> DataFrame:
    """Boundary facets of region ``a`` that are boundary facets of ``b``: mesh_id, cell_a, facet_a, cell_b, facet_b."""

    def border(name: str, suffix: str) -> DataFrame:
        entries = regions.where((F.col("kind") == "cell") & (F.col("name") == name)).select("mesh_id", F.col("entity").alias("cell_id"))
        own = facets(cells.join(entries, CELL_KEYS, "left_semi"))
        return own.groupBy("mesh_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias(f"cell_{suffix}"), F.min("facet").alias(f"facet_{suffix}")).where("n = 1").drop("n")

    return border(a, "a").join(border(b, "b"), ["mesh_id", "key"]).drop("key")


def cell_components(mesh: MeshFrame) -> DataFrame:
    """mesh_id, cell_id, component: cells that hang together by shared points, numbered by their lowest cell.

    Points and cells are the two sides of one graph; its edges are the
    incidence, so no pair of cells is formed.
    """
    stars = mesh.incidence().select("mesh_id", "cell_id", "point_id")
    first = stars.groupBy("mesh_id", "point_id").agg(F.min("cell_id").alias("b"))
    links = stars.join(first, ["mesh_id", "point_id"]).where("cell_id <> b").select("mesh_id", F.col("cell_id").alias("a"), "b")
    labels = connected_components(links, ["mesh_id"])
    named = mesh.cells.select(*CELL_KEYS).join(labels.withColumnRenamed("node", "cell_id"), CELL_KEYS, "left")
    root = F.coalesce("component", "cell_id")
    return named.select(*CELL_KEYS, root.alias("root"))


def numbered_components(components: DataFrame) -> DataFrame:
    """``root`` replaced by a dense number in the order of the roots."""
    roots = components.select("mesh_id", "root").distinct()
    number = F.row_number().over(Window.partitionBy("mesh_id").orderBy("root")) - 1
    return components.join(roots.withColumn("component", number), ["mesh_id", "root"]).drop("root")


def edge_components(mesh: MeshFrame) -> DataFrame:
    """As ``cell_components``, by shared edges: points alone do not tie cells."""
    uses = edges(mesh.cells).select("mesh_id", "cell_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    first = uses.groupBy("mesh_id", "lo", "hi").agg(F.min("cell_id").alias("b"))
    links = uses.join(first, ["mesh_id", "lo", "hi"]).where("cell_id <> b").select("mesh_id", F.col("cell_id").alias("a"), "b")
    labels = connected_components(links, ["mesh_id"])
    named = mesh.cells.select(*CELL_KEYS).join(labels.withColumnRenamed("node", "cell_id"), CELL_KEYS, "left")
    return named.select(*CELL_KEYS, F.coalesce("component", "cell_id").alias("root"))


def remove_islands(mesh: MeshFrame, min_cells: int = 0, min_area: float = 0.0, min_diagonal: float = 0.0, min_share: float = 0.0, connectivity: str = "point") -> MeshFrame:
    """Without components that are too small by any criterion that is over 0.

    Cells, summed length, area or volume, the diagonal of the box, or the share
    of the largest component's cells; components hang together by points or by
    edges.
    """
    from .geometry import with_measure

    parts = cell_components(mesh) if connectivity == "point" else edge_components(mesh)
    sized = parts.groupBy("mesh_id", "root").agg(F.count(F.lit(1)).alias("n"))
    if min_area > 0:
        sums = parts.join(with_measure(mesh).select(*CELL_KEYS, F.abs("measure").alias("m")), CELL_KEYS).groupBy("mesh_id", "root").agg(F.sum("m").alias("m"))
        sized = sized.join(sums.where(F.col("m") >= min_area).drop("m"), ["mesh_id", "root"])
    if min_diagonal > 0:
        at = mesh.incidence().join(parts, CELL_KEYS).join(mesh.points.select(*POINT_KEYS, "x", "y", "z"), POINT_KEYS)
        spans = at.groupBy("mesh_id", "root").agg(F.sqrt(sum(((F.max(c) - F.min(c)) ** 2 for c in "xyz"), F.lit(0.0))).alias("d"))
        sized = sized.join(spans.where(F.col("d") >= min_diagonal).drop("d"), ["mesh_id", "root"])
    if min_share > 0:
        largest = sized.groupBy("mesh_id").agg(F.max("n").alias("most"))
        sized = sized.join(F.broadcast(largest), "mesh_id").where(F.col("n") >= min_share * F.col("most"))
    large = sized.where(F.col("n") >= min_cells)
    kept = parts.join(large, ["mesh_id", "root"], "left_semi").select(*CELL_KEYS)
    return mesh.with_(cells=mesh.cells.join(kept, CELL_KEYS, "left_semi"))


def smooth(mesh: MeshFrame, iterations: int = 1, weight: float = 0.5, fixed: DataFrame | None = None, back: float | None = None) -> DataFrame:
    """Points after Laplacian steps towards the mean of their neighbours; ``fixed`` (mesh_id, point_id) and lone points stay.

    With ``back`` (Taubin, negative) each step is followed by one of that
    weight, which undoes the shrinking. Lineage is cut every few steps.
    """
    from .components import checkpointed

    graph = adjacency(mesh.cells, "node")
    points = mesh.points
    weights = [w for _ in range(iterations) for w in ((weight,) if back is None else (weight, back))]
    if len(weights) > 2:
        graph = checkpointed(graph)
    for step, weight in enumerate(weights):
        if step % 4 == 3:
            points = checkpointed(points)
        near = graph.join(points.select("mesh_id", F.col("point_id").alias("dst"), "x", "y", "z"), ["mesh_id", "dst"])
        mean = near.groupBy("mesh_id", F.col("src").alias("point_id")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        if fixed is not None:
            mean = mean.join(fixed, POINT_KEYS, "left_anti")
        moved = {c: F.coalesce(F.col(c) + weight * (F.col(f"m{c}") - F.col(c)), F.col(c)) for c in "xyz"}
        points = points.join(mean, POINT_KEYS, "left").withColumns(moved).drop("mx", "my", "mz")
    return points


