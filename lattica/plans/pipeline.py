"""Chains of mesh operators from JSON settings; checked as a whole before anything is read."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import functions as F

from ..mesh import MeshFrame
from ..operators import conformity as K
from ..operators import cotangent as L
from ..operators import data as D
from ..operators import datasets as E
from ..operators import filters as C
from ..operators import generate as N
from ..operators import geometry as G
from ..operators import ordering as O
from ..operators import refinement as R
from ..operators import surfaces as U
from ..operators import topology as Y

Step = Callable[[MeshFrame, dict], MeshFrame]


def _points(f) -> Step:
    return lambda m, o: m.with_(points=f(m.points, o))


def _cells(f) -> Step:
    return lambda m, o: m.with_(cells=f(m.cells, o))


def _located(f) -> Step:
    return lambda m, o: (_points if o.get("location", "point") == "point" else _cells)(f)(m, o)


def _options(step: dict) -> dict:
    return {k: v for k, v in step.items() if k != "op"}


def _reordered(mesh: MeshFrame, curve: str) -> MeshFrame:
    new = O.reorder(mesh.points, curve)
    points = mesh.points.join(new, ["mesh_id", "point_id"]).withColumn("point_id", F.col("new_id")).drop("new_id")
    moved = mesh.incidence().join(new, ["mesh_id", "point_id"]).groupBy("mesh_id", "cell_id").agg(F.array_sort(F.collect_list(F.struct("local", "new_id"))).alias("_n"))
    cells = mesh.cells.join(moved, ["mesh_id", "cell_id"]).withColumn("nodes", F.col("_n.new_id")).drop("_n")
    return mesh.with_(points=points, cells=cells)


#: op: (keys that must be there, keys that may be, function)
STEPS: dict[str, tuple[set[str], set[str], Step]] = {
    "crop": ({"box"}, {"mode"}, lambda m, o: C.crop(m, C.in_box(*map(tuple, o["box"])), o.get("mode", "all"))),
    "crop_plane": ({"point", "normal"}, {"mode"}, lambda m, o: C.crop(m, C.in_half_space(o["point"], o["normal"]), o.get("mode", "all"))),
    "crop_where": ({"array", "compare", "value"}, set(), lambda m, o: C.crop_where(m, o["array"], o["compare"], o["value"])),
    "clean": (set(), {"atol"}, lambda m, o: C.clean(m, o.get("atol"))),
    "prune": (set(), set(), lambda m, o: C.pruned(m)),
    "flip_normals": (set(), set(), _cells(lambda c, o: C.flip_normals(c))),
    "translate": ({"by"}, set(), _points(lambda p, o: G.transform(p, G.translation(*o["by"])))),
    "scale": ({"by"}, set(), _points(lambda p, o: G.transform(p, G.scaling(*o["by"])))),
    "rotate": ({"axis", "degrees"}, set(), _points(lambda p, o: G.transform(p, G.rotation(tuple(o["axis"]), o["degrees"])))),
    "simplexify": (set(), set(), _cells(lambda c, o: N.simplexify(c))),
    "linearize": (set(), set(), lambda m, o: N.linearize(m)),
    "elevate": (set(), set(), lambda m, o: N.elevate(m)),
    "extrude": ({"direction"}, {"layers", "ratio"}, lambda m, o: N.extrude(m, tuple(o["direction"]), o.get("layers", 1), o.get("ratio", 1.0))),
    "surface": (set(), set(), lambda m, o: Y.surface_mesh(m)),
    "smooth": (set(), {"iterations", "weight"}, lambda m, o: m.with_(points=Y.smooth(m, o.get("iterations", 1), o.get("weight", 0.5)))),
    "remove_islands": (set(), {"min_cells", "min_area", "min_diagonal", "min_share", "connectivity"}, lambda m, o: Y.remove_islands(m, **_options(o))),
    "taubin": (set(), {"iterations", "weight", "back"}, lambda m, o: m.with_(points=Y.smooth(m, o.get("iterations", 1), o.get("weight", 0.5), back=o.get("back", -0.53)))),
    "mirror": ({"origin", "normal"}, set(), lambda m, o: G.mirror_mesh(m, tuple(o["origin"]), tuple(o["normal"]))),
    "units": ({"old", "new"}, set(), _points(lambda p, o: G.transform(p, G.unit_change(o["old"], o["new"])))),
    "coordinates": (set(), {"system"}, _points(lambda p, o: G.convert_coordinates(p, o.get("system", "cylindrical")))),
    "weld": ({"atol"}, set(), lambda m, o: C.weld(m, o["atol"])),
    "renumber": (set(), set(), lambda m, o: C.renumbered(m)),
    "reorder": (set(), {"curve"}, lambda m, o: _reordered(m, o.get("curve", "morton"))),
    "refine": (set(), set(), lambda m, o: R.refine(m)),
    "triangulate": (set(), set(), _cells(lambda c, o: K.triangulated(c))),
    "orient": (set(), set(), _cells(lambda c, o: K.orient(c))),
    "fill_holes": (set(), {"max_edges"}, lambda m, o: K.fill_holes(m, o.get("max_edges", 10))),
    "repair": (set(), {"weld_tolerance", "fix_orientation", "outward", "max_hole_edges"}, lambda m, o: K.repair(m, **_options(o))),
    "offset_surface": ({"distance"}, set(), lambda m, o: U.offset_points(m, o["distance"])),
    "thicken": ({"distance"}, set(), lambda m, o: U.thicken(m, o["distance"])),
    "revolve": (set(), {"angle", "layers"}, lambda m, o: N.revolve(m, o.get("angle", 360.0), o.get("layers", 16))),
    "sobolev": ({"displacement", "length_scale"}, set(), lambda m, o: m.with_(points=L.sobolev_deform(m, tuple(o["displacement"]), o["length_scale"]))),
    "augment": ({"seed"}, {"rotate", "translate", "scale"}, _points(lambda p, o: E.augment(p, o["seed"], **{k: tuple(v) if isinstance(v, list) else v for k, v in _options(o).items() if k != "seed"}))),
    "subsample": ({"budget"}, {"method", "seed", "cell"}, _points(lambda p, o: E.subsample_points(p, **_options(o)))),
    "data_calc": ({"output", "expression"}, {"location", "overwrite"}, _located(lambda d, o: D.data_calc(d, o["output"], o["expression"], overwrite=o.get("overwrite", False)))),
    "data_keep": ({"names"}, {"location", "ignore_missing"}, _located(lambda d, o: D.data_keep(d, o["names"], o.get("ignore_missing", False)))),
    "data_drop": ({"names"}, {"location", "ignore_missing"}, _located(lambda d, o: D.data_drop(d, o["names"], o.get("ignore_missing", False)))),
    "data_rename": ({"names"}, {"location", "ignore_missing"}, _located(lambda d, o: D.data_rename(d, o["names"], o.get("ignore_missing", False)))),
    "data_condition": ({"array", "mode"}, {"location", "lo", "hi", "output"}, _located(lambda d, o: D.data_condition(d, o["array"], o["mode"], o.get("lo", 0.0), o.get("hi", 1.0), o.get("output")))),
}


def parse_pipeline(settings: dict | str) -> list[dict]:
    """The steps, once all operators and keys are known to be right."""
    if isinstance(settings, str):
        settings = json.loads(settings)
    if settings.get("version", 1) != 1 or not isinstance(settings.get("steps"), list):
        raise ValueError("settings need version 1 and a list of steps")
    for k, step in enumerate(settings["steps"]):
        if step.get("op") not in STEPS:
            raise ValueError(f"step {k}: no operator {step.get('op')!r}; there are {', '.join(sorted(STEPS))}")
        needed, optional, _ = STEPS[step["op"]]
        keys = set(step) - {"op"}
        if missing := needed - keys:
            raise ValueError(f"step {k} ({step['op']}): {sorted(missing)} missing")
        if unknown := keys - needed - optional:
            raise ValueError(f"step {k} ({step['op']}): {sorted(unknown)} unknown")
    return settings["steps"]


def run_pipeline(mesh: MeshFrame, settings: dict | str) -> MeshFrame:
    """Folds the steps over a mesh; nothing runs until the result is read, so the whole chain is one plan."""
    for step in parse_pipeline(settings):
        mesh = STEPS[step["op"]][2](mesh, step)
    return mesh


def pipeline_op_table() -> dict[str, list[str]]:
    """The step vocabulary: each operator with its keys, those that must be there first."""
    return {op: sorted(needed) + sorted(optional) for op, (needed, optional, _) in STEPS.items()}


def apply_step(mesh: MeshFrame, step: dict) -> MeshFrame:
    """One step, checked first."""
    return STEPS[parse_pipeline({"version": 1, "steps": [step]})[0]["op"]][2](mesh, step)


def parse_pipeline_file(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return parse_pipeline(f.read())


def run_pipeline_file(mesh: MeshFrame, path: str) -> MeshFrame:
    return run_pipeline(mesh, {"version": 1, "steps": parse_pipeline_file(path)})


def pipeline_report_json(steps: list[dict], warnings: list[str] | None = None) -> str:
    """The steps that were run and what was remarked, as text that any reader takes."""
    return json.dumps({"steps": steps, "warnings": warnings or []}, sort_keys=True)
