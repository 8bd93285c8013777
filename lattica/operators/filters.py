"""Crop, select, split, clean, merge and the order of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..celltypes import FLIPPED, by_type, corner_count
from ..functions.numbers import finite
from ..mesh import CELL_COLUMNS, CELL_KEYS, POINT_COLUMNS, POINT_KEYS, MeshFrame
from .spatial import bucketed_pairs


def in_box(lo: tuple[float, ...], hi: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).between(a, b) for c, a, b in zip("xyz", lo, hi, strict=False)])


def in_half_space(point: tuple[float, ...], normal: tuple[float, ...]) -> Column:
    return sum(((F.col(c) - p) * n for c, p, n in zip("xyz", point, normal, strict=True)), F.lit(0.0)) >= 0


def in_ball(centre: tuple[float, ...], radius: float) -> Column:
    return sum(((F.col(c) - p) ** 2 for c, p in zip("xyz", centre, strict=True)), F.lit(0.0)) <= radius * radius


def comparison(name: str, op: str, value: float) -> Column:
    """A comparison that what is not finite never passes."""
    c = F.col(name).cast("double")
    test = {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "==": c == value, "!=": c != value}[op]
    return finite(c) & test


def cells_by_points(mesh: MeshFrame, test: Column, mode: str = "all") -> DataFrame:
    """mesh_id, cell_id of the cells all (or any) of whose nodes pass."""
    inside = mesh.incidence().join(mesh.points.select(*POINT_KEYS, test.alias("_in")), POINT_KEYS)
    passed = F.bool_and("_in") if mode == "all" else F.bool_or("_in")
    return inside.groupBy(*CELL_KEYS).agg(passed.alias("_in")).where("_in").select(*CELL_KEYS)


def cells_by_centroid(mesh: MeshFrame, test: Column) -> DataFrame:
    means = mesh.incidence().join(mesh.points.select(*POINT_KEYS, "x", "y", "z"), POINT_KEYS).groupBy(*CELL_KEYS).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return means.where(test).select(*CELL_KEYS)


def kept(mesh: MeshFrame, cells: DataFrame) -> MeshFrame:
    """Only these cells, and the points they use."""
    return pruned(mesh.with_(cells=mesh.cells.join(cells, CELL_KEYS, "left_semi")))


def pruned(mesh: MeshFrame) -> MeshFrame:
    """Without points that no cell uses."""
    used = mesh.incidence().select(*POINT_KEYS).distinct()
    return mesh.with_(points=mesh.points.join(used, POINT_KEYS, "left_semi"))


def crop(mesh: MeshFrame, test: Column, mode: str = "all") -> MeshFrame:
    return kept(mesh, cells_by_points(mesh, test, mode))


def crop_where(mesh: MeshFrame, name: str, op: str, value: float) -> MeshFrame:
    return kept(mesh, mesh.cells.where(comparison(name, op, value)).select(*CELL_KEYS))


def select(mesh: MeshFrame, name: str, kind: str, test: Column, mode: str = "all", tag: int = 0) -> DataFrame:
    """Region rows of the points or cells that pass."""
    if kind == "point":
        rows = mesh.points.where(test).select("mesh_id", F.col("point_id").alias("entity"))
    else:
        rows = (cells_by_centroid(mesh, test) if mode == "centroid" else cells_by_points(mesh, test, mode)).select("mesh_id", F.col("cell_id").alias("entity"))
    return rows.select("mesh_id", F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(None).cast("int").alias("dim"), F.lit(tag).cast("bigint").alias("tag"), "entity")


def renumbered(mesh: MeshFrame) -> MeshFrame:
    """Points and cells from 0 in the order of their ids, with ``original_id``."""
    from .ordering import numbered

    def dense(df: DataFrame, key: str) -> DataFrame:
        return numbered(df.select("mesh_id", key), [key], "new").drop("new_of")

    p, c = dense(mesh.points, "point_id"), dense(mesh.cells, "cell_id")
    points = mesh.points.join(p, POINT_KEYS).withColumn("original_id", F.col("point_id")).withColumn("point_id", F.col("new")).drop("new")
    nodes = (
        mesh.incidence().join(p, POINT_KEYS).groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("local", "new"))).alias("_n"))
    )
    cells = (
        mesh.cells.join(nodes, CELL_KEYS).join(c, CELL_KEYS)
        .withColumn("nodes", F.col("_n.new")).withColumn("original_id", F.col("cell_id")).withColumn("cell_id", F.col("new")).drop("_n", "new")
    )
    return mesh.with_(points=points, cells=cells)


def flip_normals(cells: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """Cells turned inside out, all or those of a region (mesh_id, entity)."""
    turned = by_type(F.col("cell_type"), FLIPPED, lambda order: F.array(*[F.col("nodes").getItem(i) for i in order]), F.col("nodes"))
    if region is None:
        return cells.withColumn("nodes", turned)
    marks = region.select("mesh_id", F.col("entity").alias("cell_id"), F.lit(True).alias("_turn"))
    return cells.join(marks, CELL_KEYS, "left").withColumn("nodes", F.when(F.col("_turn"), turned).otherwise(F.col("nodes"))).drop("_turn")


def split(mesh: MeshFrame, by: str = "type", tag: str | None = None) -> DataFrame:
    """mesh_id, cell_id, piece: by cell type, or by a tag in the order of each value's first cell."""
    value = F.col("cell_type" if by == "type" else tag)
    rows = mesh.cells.select(*CELL_KEYS, value.alias("value"))
    firsts = rows.groupBy("mesh_id", "value").agg(F.min("cell_id").alias("first"))
    number = F.row_number().over(Window.partitionBy("mesh_id").orderBy("first")) - 1
    named = firsts.select("mesh_id", "value", number.alias("piece"))
    return rows.join(named, ["mesh_id", "value"]).select(*CELL_KEYS, "piece")


def drop_degenerate(cells: DataFrame) -> DataFrame:
    """Without cells that repeat a corner."""
    corners = F.slice("nodes", 1, F.coalesce(corner_count(F.col("cell_type")), F.size("nodes")))
    return cells.where(F.size(F.array_distinct(corners)) == F.size(corners))


def drop_duplicates(cells: DataFrame) -> DataFrame:
    """Of cells of one type with the same set of nodes the first."""
    key = cells.withColumn("_key", F.array_sort("nodes"))
    firsts = key.groupBy("mesh_id", "cell_type", "_key").agg(F.min("cell_id").alias("cell_id")).select(*CELL_KEYS)
    return cells.join(firsts, CELL_KEYS, "left_semi")


def weld_map(points: DataFrame, atol: float) -> DataFrame:
    """mesh_id, point_id, target: points joined to the first earlier representative within ``atol``.

    Greedy in the order of the ids, not transitive. Pairs within reach come
    from a bucket join. Where every earlier neighbour of a point is itself no
    one's neighbour, its least neighbour is the answer, without more work; the
    chains that remain are resolved in rounds, a point as soon as all its
    earlier neighbours are.
    """
    from .components import checkpointed

    pairs = bucketed_pairs(points, atol).select("mesh_id", F.col("b").alias("point_id"), F.col("a").alias("earlier"))
    pairs = checkpointed(pairs)
    open_ = pairs
    reps = None
    done = points.sparkSession.createDataFrame([], "mesh_id string, point_id bigint, target bigint")
    while not open_.isEmpty():
        # points whose earlier neighbours are all settled: not open themselves
        waiting = open_.select("mesh_id", F.col("point_id").alias("earlier")).distinct()
        blocked = open_.join(waiting, ["mesh_id", "earlier"], "left_semi").select("mesh_id", "point_id").distinct()
        ready = open_.join(blocked, POINT_KEYS, "left_anti")
        # an earlier neighbour counts if it is a representative
        merged = done.where("target <> point_id").select("mesh_id", F.col("point_id").alias("earlier"))
        reach = ready.join(merged, ["mesh_id", "earlier"], "left_anti")
        settled = ready.select(*POINT_KEYS).distinct().join(reach.groupBy(*POINT_KEYS).agg(F.min("earlier").alias("target")), POINT_KEYS, "left")
        settled = settled.select(*POINT_KEYS, F.coalesce("target", "point_id").alias("target"))
        done = checkpointed(done.unionAll(settled))
        open_ = checkpointed(open_.join(settled, POINT_KEYS, "left_anti"))
        reps = done
    found = points.select(*POINT_KEYS).join(reps if reps is not None else done, POINT_KEYS, "left")
    return found.select(*POINT_KEYS, F.coalesce("target", "point_id").alias("target"))


def weld(mesh: MeshFrame, atol: float) -> MeshFrame:
    """Points fused onto their representatives, whose values stay."""
    target = weld_map(mesh.points, atol)
    points = mesh.points.join(target.where("target = point_id").select(*POINT_KEYS), POINT_KEYS, "left_semi")
    nodes = mesh.incidence().join(target, POINT_KEYS).groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("local", "target"))).alias("_n"))
    cells = mesh.cells.join(nodes, CELL_KEYS).withColumn("nodes", F.col("_n.target")).drop("_n")
    return mesh.with_(points=points, cells=cells)


def clean(mesh: MeshFrame, atol: float | None = None) -> MeshFrame:
    """Weld (if ``atol`` is given), drop degenerate cells, then duplicates, then points that are not used."""
    if atol is not None:
        mesh = weld(mesh, atol)
    return pruned(mesh.with_(cells=drop_duplicates(drop_degenerate(mesh.cells))))


def merge(meshes: list[MeshFrame], mesh_id: str, policy: str = "intersection") -> MeshFrame:
    """One mesh, ids offset by what came before, with ``source_mesh``.

    Arrays: those that all have (intersection), or all, NaN where one has none (fill).
    """
    points, cells = [], []
    p0 = c0 = 0
    for k, m in enumerate(meshes):
        sizes = m.points.agg((F.coalesce(F.max("point_id"), F.lit(-1)) + 1).alias("p")).first()[0], m.cells.agg((F.coalesce(F.max("cell_id"), F.lit(-1)) + 1)).first()[0]
        source = {"mesh_id": F.lit(mesh_id), "source_mesh": F.lit(k)}
        points.append(m.points.withColumns(source | {"point_id": F.col("point_id") + p0}))
        cells.append(m.cells.withColumns(source | {"cell_id": F.col("cell_id") + c0, "nodes": shifted("nodes", p0)}))
        p0, c0 = p0 + sizes[0], c0 + sizes[1]

    def together(parts: list[DataFrame], fixed: list[str]) -> DataFrame:
        if policy == "intersection":
            common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
            return reduce(DataFrame.unionByName, [p.select(*common) for p in parts])
        names = list(dict.fromkeys(c for p in parts for c in p.columns))
        filled = [p.select(*[F.col(c) if c in p.columns else F.lit(float("nan")).alias(c) for c in names]) for p in parts]
        return reduce(DataFrame.unionByName, filled)

    return MeshFrame(together(points, POINT_COLUMNS), together(cells, CELL_COLUMNS))


def shifted(column: str, by: int) -> Column:
    return F.transform(column, lambda n: n + F.lit(by))
