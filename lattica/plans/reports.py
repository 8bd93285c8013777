"""Tables that are made of one mesh, by name: what the command line prints or writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import MeshFrame
from ..operators import conformity as K
from ..operators import cotangent as L
from ..operators import data as D
from ..operators import datasets as E
from ..operators import derivatives as V
from ..operators import fields as W
from ..operators import generate as N
from ..operators import geometry as G
from ..operators import grids as X
from ..operators import kernels as H
from ..operators import measuring as M
from ..operators import ordering as O
from ..operators import surfaces as U
from ..operators import topology as Y

Report = Callable[[MeshFrame, dict], DataFrame]


def _seeds(m: MeshFrame, o: dict) -> DataFrame:
    return m.points.where(F.col("point_id").isin([int(v) for v in o["sources"]])).select("mesh_id", "point_id")


def _flat(m: MeshFrame) -> DataFrame:
    """The surface's triangles with their corners."""
    return m.with_(cells=K.triangulated(m.cells)).with_corners()


#: name: (keys that must be there, keys that may be, function)
REPORTS: dict[str, tuple[set[str], set[str], Report]] = {
    "stats": (set(), set(), lambda m, o: G.compute_stats(m)),
    "cell_types": (set(), set(), lambda m, o: G.cell_type_counts(m.cells)),
    "quality": (set(), set(), lambda m, o: G.compute_quality(m)),
    "check": ({"thresholds"}, set(), lambda m, o: G.check_quality(G.compute_quality(m), o["thresholds"])),
    "check_tetrahedra": (set(), {"factor"}, lambda m, o: G.check_tetrahedra(m, o.get("factor", 1e-6))),
    "check_conformity": (set(), {"tolerance"}, lambda m, o: K.check_conformity(m, o.get("tolerance", 1e-9))),
    "find_intersections": (set(), set(), lambda m, o: K.find_intersections(m.with_(cells=K.triangulated(m.cells)))),
    "holes": (set(), set(), lambda m, o: K.hole_loops(m.cells)),
    "watertight": (set(), set(), lambda m, o: Y.watertight_check(m.cells)),
    "feature_edges": (set(), {"angle"}, lambda m, o: Y.feature_edges(m, o.get("angle", 30.0))),
    "graph": (set(), {"kind"}, lambda m, o: Y.adjacency(m.cells, o.get("kind", "node"))),
    "graph_summary": (set(), {"kind"}, lambda m, o: Y.graph_summary(Y.adjacency(m.cells, o.get("kind", "node")))),
    "bandwidth": (set(), set(), lambda m, o: Y.compute_bandwidth(m.cells)),
    "components": (set(), set(), lambda m, o: Y.numbered_components(Y.cell_components(m))),
    "normals": (set(), set(), lambda m, o: G.cell_normals(m)),
    "point_normals": (set(), set(), lambda m, o: G.point_normals(m)),
    "estimate_normals": (set(), {"k"}, lambda m, o: H.estimate_normals(m.points, o.get("k", 16))),
    "curvature": (set(), {"dual_area"}, lambda m, o: L.mean_curvature(m, o.get("dual_area", "mixed-voronoi")).join(G.angle_defect(m).drop("area"), ["mesh_id", "point_id"], "left")),
    "eigenmodes": (set(), {"modes"}, lambda m, o: L.laplacian_eigenmodes(m, o.get("modes", 10))),
    "geodesic": ({"sources"}, {"time_factor"}, lambda m, o: L.geodesic_distance(m, _seeds(m, o), o.get("time_factor", 1.0))),
    "bistride": ({"sources"}, set(), lambda m, o: E.bistride(Y.adjacency(m.cells), _seeds(m, o))),
    "gradient": ({"array"}, {"method"}, lambda m, o: (V.gradient_green_gauss if o.get("method", "green-gauss") == "green-gauss" else G.gradient)(m, o["array"])),
    "divergence": ({"vector"}, set(), lambda m, o: V.divergence(m, tuple(o["vector"]))),
    "curl": ({"vector"}, set(), lambda m, o: V.curl(m, tuple(o["vector"]))),
    "hessian": ({"array"}, set(), lambda m, o: W.hessian(m, o["array"])),
    "metric": ({"array"}, {"error", "hmin", "hmax"}, lambda m, o: U.metric_from_hessian(W.hessian(m, o["array"]), o.get("error", 0.01), o.get("hmin", 1e-3), o.get("hmax", 1.0))),
    "error": ({"array"}, set(), lambda m, o: G.estimate_error(m, o["array"])),
    "isosurface": ({"array", "level"}, set(), lambda m, o: N.isosurface(m, F.col(o["array"]), o["level"])),
    "slice": ({"origin", "normal"}, set(), lambda m, o: N.slice_mesh(m, tuple(o["origin"]), tuple(o["normal"]))),
    "clip": ({"origin", "normal"}, set(), lambda m, o: U.clip_triangles(m, tuple(o["origin"]), tuple(o["normal"]))),
    "segment": (set(), {"angle"}, lambda m, o: W.segment(m, o.get("angle", 30.0))),
    "thickness": (set(), {"inward"}, lambda m, o: U.thickness(_flat(m).select("mesh_id", "cell_id", "corners"), o.get("inward", True))),
    "hull": (set(), set(), lambda m, o: U.convex_hull(m.points)),
    "hull_2d": (set(), set(), lambda m, o: H.convex_hull_2d(m.points)),
    "delaunay": (set(), set(), lambda m, o: U.delaunay_2d(m.points)),
    "partition": ({"parts"}, {"curve"}, lambda m, o: _partition(m, o)),
    "select_points": ({"count"}, {"method", "seed", "cell", "start"}, lambda m, o: _select(m, o)),
    "proximity": (set(), {"radius", "k"}, lambda m, o: E.proximity_graph(m.points, o.get("radius"), o.get("k"))),
    "world_edges": ({"radius"}, set(), lambda m, o: E.world_edges(m, o["radius"])),
    "edge_vectors": (set(), set(), lambda m, o: E.edge_vectors(Y.adjacency(m.cells), m.points)),
    "octree": ({"origin", "side"}, {"min_level", "max_level"}, lambda m, o: X.octree(_flat(m), (tuple(o["origin"]), o["side"]), o.get("min_level", 0), o.get("max_level", 4))),
    "grid_sample": ({"arrays", "dims", "origin", "spacing"}, set(), lambda m, o: X.sample_grid(m, o["arrays"], tuple(o["dims"]), tuple(o["origin"]), tuple(o["spacing"]))),
    "measure": ({"element"}, set(), lambda m, o: M.fit_elements(m.points, o["element"])),
    "data_info": (set(), {"location"}, lambda m, o: D.data_info(m.points if o.get("location", "point") == "point" else m.cells, o.get("location", "point"))),
    "integrate": ({"arrays"}, set(), lambda m, o: D.data_integrate(G.with_measure(m), o["arrays"])),
    "health": (set(), set(), lambda m, o: E.dataset_health(m)),
    "topology_hash": (set(), set(), lambda m, o: E.topology_hash(m.cells)),
}


def _partition(m: MeshFrame, o: dict) -> DataFrame:
    at = G.centroids(m).select("mesh_id", F.col("cell_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    keyed = O.with_hilbert(O.quantised(at)) if o.get("curve", "hilbert") == "hilbert" else O.quantised(at).withColumn("hilbert", O.morton(F.col("qx"), F.col("qy"), F.col("qz")))
    return O.partition_labels(keyed.select("mesh_id", F.col("point_id").alias("cell_id"), "hilbert"), "cell_id", "hilbert", int(o["parts"])).select("mesh_id", "cell_id", "part")


def _select(m: MeshFrame, o: dict) -> DataFrame:
    method = o.get("method", "farthest")
    if method == "random":
        return O.random_points(m.points, int(o["count"]), o.get("seed", 0)).select("mesh_id", "point_id")
    if method == "grid":
        return O.grid_points(m.points, o.get("cell", 1.0)).select("mesh_id", "point_id")
    return O.farthest_points(m.points, int(o["count"]), o.get("start", 0))


def report(mesh: MeshFrame, name: str, options: dict | None = None) -> DataFrame:
    """The table of a name, once its options are known to be right."""
    if name not in REPORTS:
        raise ValueError(f"{name!r} is none of {', '.join(sorted(REPORTS))}")
    needed, optional, make = REPORTS[name]
    options = options or {}
    if missing := needed - set(options):
        raise ValueError(f"{name}: {sorted(missing)} missing")
    if unknown := set(options) - needed - optional:
        raise ValueError(f"{name}: {sorted(unknown)} unknown")
    return make(mesh, options)
