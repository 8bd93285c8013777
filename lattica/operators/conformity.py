"""How cells meet: facets that do not match, hanging points, split interfaces, repairs and crossing triangles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..celltypes import FLIPPED, SIMPLICES, by_type, dimension, tuples
from ..functions.numbers import divided
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .components import checkpointed, connected_components
from .geometry import corner, cross, dot, length, minus, with_measure
from .ordering import numbered
from .topology import edges, facets

XYZ = ("x", "y", "z")


def unmatched_facets(cells: DataFrame) -> DataFrame:
    """mesh_id, cell_id, facet, nodes, n: facets that are not shared by exactly two cells of the top dimension."""
    top = cells.groupBy("mesh_id").agg(F.max(dimension(F.col("cell_type"))).alias("_top"))
    solid = cells.join(F.broadcast(top), "mesh_id").where(dimension(F.col("cell_type")) == F.col("_top"))
    uses = facets(solid).groupBy("mesh_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cell_id", "facet", "facet_nodes")).alias("f"))
    return uses.where("n <> 2").select("mesh_id", F.col("f.cell_id").alias("cell_id"), F.col("f.facet").alias("facet"), F.col("f.facet_nodes").alias("nodes"), "n")


def _spread(df: DataFrame, cell: Column, low: str, high: str) -> DataFrame:
    """Each row once for each bucket that the box low* to high* touches."""
    out = df
    for c in XYZ:
        first, last = F.floor(F.col(f"{low}{c}") / cell).cast("bigint"), F.floor(F.col(f"{high}{c}") / cell).cast("bigint")
        out = out.withColumn(f"b{c}", F.explode(F.sequence(first, last)))
    return out


def hanging_points(mesh: MeshFrame, tolerance: float = 1e-9) -> DataFrame:
    """mesh_id, lo, hi, point_id: points that lie inside an edge of an unmatched facet without being its end.

    Edges are dealt to the buckets that their boxes touch, of the size of the
    longest of them in the mesh, and points to one bucket: an equi-join.
    """
    rim = unmatched_facets(mesh.cells)
    n = F.size("nodes")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.col("nodes").getItem(k).alias("a"), F.col("nodes").getItem((k + 1) % n).alias("b")))
    sides = rim.where("size(nodes) > 1").select("mesh_id", F.explode(ends).alias("e")).select("mesh_id", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi")).where("lo <> hi").distinct()
    at = lambda name, p: mesh.points.select("mesh_id", F.col("point_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    placed = sides.join(at("lo", "p"), ["mesh_id", "lo"]).join(at("hi", "q"), ["mesh_id", "hi"])
    size = F.sqrt(sum(((F.col(f"q{c}") - F.col(f"p{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    longest = placed.groupBy("mesh_id").agg(F.max(size).alias("_cell")).where("_cell > 0")
    boxes = placed.withColumns({f"l{c}": F.least(f"p{c}", f"q{c}") - tolerance for c in XYZ} | {f"h{c}": F.greatest(f"p{c}", f"q{c}") + tolerance for c in XYZ})
    dealt = _spread(boxes.join(F.broadcast(longest), "mesh_id"), F.col("_cell"), "l", "h")
    used = rim.select("mesh_id", F.explode("nodes").alias("point_id")).distinct()
    points = mesh.points.join(used, POINT_KEYS, "left_semi").join(F.broadcast(longest), "mesh_id")
    points = points.select(*POINT_KEYS, *XYZ, *[F.floor(F.col(c) / F.col("_cell")).cast("bigint").alias(f"b{c}") for c in XYZ])
    pairs = dealt.drop("_cell").join(points, ["mesh_id", "bx", "by", "bz"]).where("point_id <> lo and point_id <> hi")
    d = {c: F.col(f"q{c}") - F.col(f"p{c}") for c in XYZ}
    square = sum((d[c] * d[c] for c in XYZ), F.lit(0.0))
    t = sum(((F.col(c) - F.col(f"p{c}")) * d[c] for c in XYZ), F.lit(0.0)) / square
    off = sum(((F.col(c) - F.col(f"p{c}") - t * d[c]) ** 2 for c in XYZ), F.lit(0.0))
    return pairs.where((square > 0) & (t > tolerance) & (t < 1 - tolerance) & (off <= tolerance * tolerance)).select("mesh_id", "lo", "hi", "point_id").distinct()


def check_conformity(mesh: MeshFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row for each mesh: facets of one cell (boundary), of over two (non_manifold), hanging points, edges that have one, and facets that lie on another without sharing its points (unwelded)."""
    rim = unmatched_facets(mesh.cells)
    counts = rim.groupBy("mesh_id").agg(F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold"))
    hanging = hanging_points(mesh, tolerance).groupBy("mesh_id").agg(F.count_distinct("point_id").alias("hanging_points"), F.count_distinct("lo", "hi").alias("hanging_edges"))
    place = lambda c: F.round(F.col(c) / tolerance).cast("bigint")
    spot = mesh.points.select(*POINT_KEYS, F.struct(*[place(c).alias(c) for c in XYZ]).alias("spot"))
    rows = rim.where("n = 1").select(*CELL_KEYS, "facet", F.explode("nodes").alias("point_id")).join(spot, POINT_KEYS)
    shapes = rows.groupBy(*CELL_KEYS, "facet").agg(F.array_sort(F.collect_list("spot")).alias("shape")).groupBy("mesh_id", "shape").agg(F.count(F.lit(1)).alias("n"))
    unwelded = shapes.where("n > 1").groupBy("mesh_id").agg(F.sum("n").alias("unwelded"))
    meshes = mesh.cells.select("mesh_id").distinct()
    out = meshes.join(counts, "mesh_id", "left").join(hanging, "mesh_id", "left").join(unwelded, "mesh_id", "left")
    return out.fillna(0)


def split_interface(mesh: MeshFrame, side: DataFrame) -> MeshFrame:
    """The mesh cut along the facets in ``side`` (mesh_id, cell_id, facet): points get a copy for each fan of cells beyond the first.

    At each point of the cut, cells that still share a facet through it are one
    fan; fans are ordered by their least cell. Points at the rim of the cut
    whose cells hang together stay single. Copies have ``original_id``.
    """
    all_facets = facets(mesh.cells)
    cut = all_facets.join(side.select(*CELL_KEYS, "facet"), [*CELL_KEYS, "facet"], "left_semi").select("mesh_id", "key").distinct()
    touched = cut.select("mesh_id", F.explode("key").alias("point_id")).distinct()
    whole = all_facets.join(cut, ["mesh_id", "key"], "left_anti").select("mesh_id", "key", "cell_id")
    pairs = whole.groupBy("mesh_id", "key").agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    links = pairs.select("mesh_id", F.explode("key").alias("point_id"), "a", "b").join(touched, POINT_KEYS, "left_semi")
    labels = connected_components(links, POINT_KEYS).withColumnRenamed("node", "cell_id")
    stars = mesh.incidence().join(touched, POINT_KEYS, "left_semi")
    fans = stars.join(labels, [*POINT_KEYS, "cell_id"], "left").select(*POINT_KEYS, "cell_id", "local", F.coalesce("component", "cell_id").alias("fan"))
    first = fans.groupBy(*POINT_KEYS).agg(F.min("fan").alias("first"))
    others = fans.join(first, POINT_KEYS).where("fan <> first").select(*POINT_KEYS, "fan").distinct()
    last = mesh.points.groupBy("mesh_id").agg(F.max("point_id").alias("_last"))
    new = numbered(others, ["point_id", "fan"], "_place").join(F.broadcast(last), "mesh_id").select(*POINT_KEYS, "fan", (F.col("_last") + 1 + F.col("_place")).alias("copy"))
    points = mesh.points.withColumn("original_id", F.col("point_id"))
    copies = points.join(new.select(*POINT_KEYS, "copy"), POINT_KEYS).withColumn("point_id", F.col("copy")).drop("copy")
    moved = fans.join(new, [*POINT_KEYS, "fan"]).select(*CELL_KEYS, "local", "copy")
    nodes = mesh.incidence().join(moved, [*CELL_KEYS, "local"], "left").groupBy(*CELL_KEYS).agg(F.array_sort(F.collect_list(F.struct("local", F.coalesce("copy", "point_id").alias("node")))).alias("_n"))
    cells = mesh.cells.join(nodes, CELL_KEYS).withColumn("nodes", F.col("_n.node")).drop("_n")
    return mesh.with_(points=points.unionByName(copies.select(*points.columns)), cells=cells)


def triangulated(cells: DataFrame) -> DataFrame:
    """Triangles and quads as triangles, with ``parent``; numbered by parent."""
    parts = cells.where(F.col("cell_type").isin("triangle", "quad")).select("*", F.posexplode(tuples(F.col("cell_type"), F.col("nodes"), SIMPLICES)).alias("_k", "_nodes"))
    out = parts.withColumn("parent", F.col("cell_id")).withColumn("cell_type", F.lit("triangle")).withColumn("nodes", F.col("_nodes"))
    return numbered(out, ["parent", "_k"], "cell_id").drop("_k", "_nodes", "cell_id_of")


def orient(cells: DataFrame) -> DataFrame:
    """Faces turned so that neighbours run along their shared edge in opposite ways; the least cell of each component keeps its own.

    Every face stands twice in a graph, as it is and turned. Two faces that
    share an edge tie the copies that agree, so one component of the graph has
    the faces as they are beside the least one. What can't be oriented (a
    Moebius strip) ties both copies and stays as it is. Edges of over two faces
    tie nothing.
    """
    e = edges(cells).select(*CELL_KEYS, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") < F.col("b")).alias("up"))
    pairs = e.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cell_id", "up")).alias("p"), F.max(F.struct("cell_id", "up")).alias("q")).where("n = 2 and p.cell_id <> q.cell_id")
    agree = F.col("p.up") != F.col("q.up")
    # the copy of cell c that is turned has the number 2 c + 1
    both = F.array(*[F.struct((2 * F.col("p.cell_id") + s).alias("a"), (2 * F.col("q.cell_id") + F.when(agree, s).otherwise(1 - s)).alias("b")) for s in (0, 1)])
    labels = connected_components(pairs.select("mesh_id", F.explode(both).alias("e")).select("mesh_id", "e.a", "e.b"), ["mesh_id"])
    turned = labels.where("node % 2 = 1").select("mesh_id", ((F.col("node") - 1) / 2).cast("bigint").alias("cell_id"), F.col("component").alias("odd"))
    plain = labels.where("node % 2 = 0").select("mesh_id", (F.col("node") / 2).cast("bigint").alias("cell_id"), F.col("component").alias("even"))
    # the least cell of a component is even there: its plain copy names the component to keep
    keep = plain.join(turned, CELL_KEYS).where("odd < even").select(*CELL_KEYS, F.lit(True).alias("_turn"))
    nodes = by_type(F.col("cell_type"), FLIPPED, lambda order: F.array(*[F.col("nodes").getItem(i) for i in order]), F.col("nodes"))
    return cells.join(keep, CELL_KEYS, "left").withColumn("nodes", F.when(F.col("_turn"), nodes).otherwise(F.col("nodes"))).drop("_turn")


def hole_loops(cells: DataFrame) -> DataFrame:
    """mesh_id, loop, edges: boundary edges of faces that hang together, named by their least point."""
    e = edges(cells).select("mesh_id", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    rim = e.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b")).alias("e")).where("n = 1").select("mesh_id", "e.a", "e.b")
    labels = connected_components(rim, ["mesh_id"])
    return rim.join(labels, (rim["mesh_id"] == labels["mesh_id"]) & (rim["a"] == labels["node"])).select(rim["mesh_id"], F.col("component").alias("loop"), "a", "b")


def fill_holes(mesh: MeshFrame, max_edges: int = 10) -> MeshFrame:
    """Every loop of at most ``max_edges`` boundary edges closed by a fan of triangles about its middle, wound like the faces around it."""
    loops = hole_loops(mesh.cells)
    small = loops.groupBy("mesh_id", "loop").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_edges)
    rim = loops.join(small.select("mesh_id", "loop"), ["mesh_id", "loop"])
    last = mesh.points.groupBy("mesh_id").agg(F.max("point_id").alias("_last"))
    middles = numbered(small.select("mesh_id", "loop"), ["loop"], "_place").join(F.broadcast(last), "mesh_id").select("mesh_id", "loop", (F.col("_last") + 1 + F.col("_place")).alias("middle"))
    arrays = [c for c, k in mesh.points.dtypes if c not in ("mesh_id", "point_id") and k in ("double", "float")]
    at = rim.select("mesh_id", "loop", F.col("a").alias("point_id")).join(mesh.points.select(*POINT_KEYS, *arrays), POINT_KEYS)
    points = at.groupBy("mesh_id", "loop").agg(*[F.avg(c).alias(c) for c in arrays]).join(middles, ["mesh_id", "loop"]).select("mesh_id", F.col("middle").alias("point_id"), *arrays)
    top = mesh.cells.groupBy("mesh_id").agg(F.max("cell_id").alias("_top"))
    fans = numbered(rim.join(middles, ["mesh_id", "loop"]), ["loop", "a"], "_place").join(F.broadcast(top), "mesh_id")
    made = fans.select("mesh_id", (F.col("_top") + 1 + F.col("_place")).alias("cell_id"), F.lit("triangle").alias("cell_type"), F.array("b", "a", "middle").alias("nodes"))
    return mesh.with_(points=mesh.points.unionByName(points, allowMissingColumns=True), cells=mesh.cells.unionByName(made, allowMissingColumns=True))


def orient_outward(mesh: MeshFrame) -> MeshFrame:
    """Closed pieces of triangles whose signed volume is negative turned inside out."""
    from .topology import edge_components

    parts = edge_components(mesh)
    c = F.col("corners")
    six = dot(corner(c, 0), cross(corner(c, 1), corner(c, 2)))
    volumes = mesh.with_corners().where("cell_type = 'triangle'").select(*CELL_KEYS, six.alias("v")).join(parts, CELL_KEYS).groupBy("mesh_id", "root").agg(F.sum("v").alias("v"))
    inside = parts.join(volumes.where("v < 0").select("mesh_id", "root"), ["mesh_id", "root"]).select(*CELL_KEYS, F.lit(True).alias("_turn"))
    nodes = F.col("nodes")
    turned = F.array(nodes.getItem(0), nodes.getItem(2), nodes.getItem(1))
    cells = mesh.cells.join(inside, CELL_KEYS, "left").withColumn("nodes", F.when(F.col("_turn"), turned).otherwise(nodes)).drop("_turn")
    return mesh.with_(cells=cells)


def without_degenerate(mesh: MeshFrame, factor: float = 1e-12) -> MeshFrame:
    """Without cells that have a point twice or no extent."""
    single = mesh.cells.where(F.size(F.array_distinct("nodes")) == F.size("nodes"))
    sized = with_measure(mesh.with_(cells=single)).where((F.abs("measure") > factor) | F.col("measure").isNull())
    return mesh.with_(cells=single.join(sized.select(*CELL_KEYS), CELL_KEYS, "left_semi"))


def repair(mesh: MeshFrame, weld_tolerance: float = 0.0, fix_orientation: bool = True, outward: bool = True, max_hole_edges: int = 10) -> MeshFrame:
    """A surface made whole: welded, triangulated, without degenerate and repeated faces, oriented, small holes filled, closed pieces outward."""
    from .filters import drop_duplicates, weld

    if weld_tolerance > 0:
        mesh = weld(mesh, weld_tolerance)
    # lineage is cut after each step, since each reads its cells several times
    mesh = mesh.with_(cells=triangulated(mesh.cells))
    mesh = without_degenerate(mesh)
    mesh = mesh.with_(cells=checkpointed(drop_duplicates(mesh.cells)))
    if fix_orientation:
        mesh = mesh.with_(cells=checkpointed(orient(mesh.cells)))
    if max_hole_edges > 0:
        mesh = fill_holes(mesh, max_hole_edges)
        mesh = mesh.with_(points=checkpointed(mesh.points), cells=checkpointed(mesh.cells))
    return orient_outward(mesh) if outward else mesh


def find_intersections(a: MeshFrame, b: MeshFrame | None = None) -> DataFrame:
    """mesh_id, cell_a, cell_b: triangles of ``a`` and ``b`` (or of ``a`` alone, cell_a below cell_b) that cross.

    Two triangles cross when an edge of one passes through the inside of the
    other. Pairs that share a point are left out within one mesh. Boxes are
    dealt to the buckets that they touch, of the size of the longest box side,
    and each pair is judged once, in the bucket of the higher of the two lower
    corners.
    """

    def boxed(mesh: MeshFrame, s: str) -> DataFrame:
        rows = mesh.with_corners().where("cell_type = 'triangle'").select("mesh_id", F.col("cell_id").alias(f"cell_{s}"), F.col("nodes").alias(f"n{s}"), F.col("corners").alias(f"c{s}"))
        side = lambda f, c: f(*[F.col(f"c{s}").getItem(k)[c] for k in range(3)])
        return rows.withColumns({f"{s}l{c}": side(F.least, c) for c in XYZ} | {f"{s}h{c}": side(F.greatest, c) for c in XYZ})

    own, other = boxed(a, "a"), boxed(a if b is None else b, "b")
    wide = own.select("mesh_id", F.greatest(*[F.col(f"ah{c}") - F.col(f"al{c}") for c in XYZ]).alias("w")).unionAll(
        other.select("mesh_id", F.greatest(*[F.col(f"bh{c}") - F.col(f"bl{c}") for c in XYZ]).alias("w"))
    )
    cell = wide.groupBy("mesh_id").agg(F.greatest(F.max("w"), F.lit(1e-300)).alias("_cell"))
    deal = lambda df, s: _spread(df.join(F.broadcast(cell), "mesh_id"), F.col("_cell"), f"{s}l", f"{s}h")
    pairs = deal(own, "a").join(deal(other, "b").drop("_cell"), ["mesh_id", "bx", "by", "bz"])
    for c in XYZ:
        pairs = pairs.where((F.col(f"al{c}") <= F.col(f"bh{c}")) & (F.col(f"bl{c}") <= F.col(f"ah{c}")))
        pairs = pairs.where(F.col(f"b{c}") == F.floor(F.greatest(f"al{c}", f"bl{c}") / F.col("_cell")))
    if b is None:
        pairs = pairs.where("cell_a < cell_b").where(~F.arrays_overlap("na", "nb"))

    names = [f"{s}{k}{c}" for s in "ab" for k in range(3) for c in XYZ]
    flat = pairs.select("mesh_id", "cell_a", "cell_b", *[F.col(f"c{n[0]}").getItem(int(n[1]))[n[2]].alias(n) for n in names])

    def judge(batches):
        for g in batches:
            both = g[names].to_numpy(float).reshape(-1, 2, 3, 3)
            hit = pierces(both[:, 0], both[:, 1]) | pierces(both[:, 1], both[:, 0])
            yield g.loc[hit, ["mesh_id", "cell_a", "cell_b"]]

    return flat.mapInPandas(judge, "mesh_id string, cell_a bigint, cell_b bigint")


def pierces(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether an edge of each triangle of ``p`` (n x 3 x 3) passes through the inside of its partner in ``t``."""
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    out = np.zeros(len(p), bool)
    for k in range(3):
        s, d = p[:, k], p[:, (k + 1) % 3] - p[:, k]
        along, start = (n * d).sum(1), (n * (s - t[:, 0])).sum(1)
        w = -start / np.where(along == 0, 1, along)
        hit = s + w[:, None] * d
        inside = (along != 0) & (w > 0) & (w < 1)
        for j in range(3):
            q, r = t[:, j], t[:, (j + 1) % 3]
            inside &= (np.cross(r - q, hit - q) * n).sum(1) > 0
        out |= inside
    return out


def spikes(mesh: MeshFrame, angle: float = 5.0) -> DataFrame:
    """mesh_id, cell_id: triangles with a corner sharper than ``angle`` degrees."""
    c = F.col("corners")
    sharp = []
    for k in range(3):
        u, v = minus(corner(c, (k + 1) % 3), corner(c, k)), minus(corner(c, (k + 2) % 3), corner(c, k))
        sharp.append(F.degrees(F.acos(F.least(F.greatest(divided(dot(u, v), length(u) * length(v)), F.lit(-1.0)), F.lit(1.0)))) < angle)
    return mesh.with_corners().where("cell_type = 'triangle'").where(sharp[0] | sharp[1] | sharp[2]).select(*CELL_KEYS)
