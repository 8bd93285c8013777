"""Option names: one table of what each option may be, and a parser and a printer for each entry."""

from __future__ import annotations

from collections.abc import Callable

#: The spellings that each option takes.
OPTIONS: dict[str, tuple[str, ...]] = {
    "adapt_volume_quality": ("min_dihedral", "mean_ratio", "amips"),
    "adapt_volume_boundary_sizing": ("input", "geometry"),
    "adjacency_kind": ("node", "clique", "cell"),
    "graph_format": ("metis", "scotch"),
    "conservative_interpolate_conflict": ("error", "overwrite", "suffix"),
    "primitive_relation": ("coaxial", "parallel", "perpendicular", "equal_radius"),
    "convert_cells_mode": ("linearize", "simplexify", "elevate"),
    "coordinate_system": ("cylindrical", "spherical"),
    "curvature_dual_area": ("mixed-voronoi", "barycentric"),
    "cell_point_weight": ("uniform", "measure"),
    "data_location": ("point", "cell"),
    "nan_policy": ("ignore", "replace", "fail"),
    "condition_mode": ("clamp", "normalize", "standardize"),
    "condition_scope": ("global", "component"),
    "decimate_placement": ("optimal", "midpoint", "endpoint"),
    "diff_verdict": ("identical", "equal within tolerance", "different"),
    "error_method": ("recovery", "jump"),
    "error_marking": ("absolute", "fraction", "dorfler"),
    "fit_cad_part_class": ("any", "analytic", "cast", "freeform"),
    "sketch_piece_type": ("line", "arc", "circle"),
    "fit_criterion": ("least_squares", "minimum_zone", "min_circumscribed", "max_inscribed"),
    "gradient_operator": ("gradient", "divergence", "curl"),
    "gradient_method": ("green-gauss", "least-squares"),
    "interpolate_method": ("nearest", "barycentric"),
    "interpolate_conflict": ("error", "overwrite", "suffix"),
    "octree_balance": ("none", "face", "full"),
    "octree_transition": ("hanging", "polyhedra", "templates"),
    "octree_mesh_output": ("castellated", "tet", "hex"),
    "octree_mesh_conformity": ("stuffing", "cleaving"),
    "octree_mesh_skin_grading": ("graded", "uniform"),
    "octree_mesh_hex_grading": ("uniform", "graded"),
    "octree_mesh_fill": ("all", "inside", "cover"),
    "thicken_side": ("inward", "outward", "both"),
    "optimize_volume_objective": ("worst", "energy"),
    "partition_method": ("sfc", "kahip", "auto"),
    "partition_mode": ("fast", "eco", "strong"),
    "pipeline_encoding": ("default", "ascii", "binary"),
    "pipeline_codec": ("none", "zlib", "lz4", "zstd"),
    "pipeline_mmap": ("auto", "on", "off"),
    "normal_orientation": ("consistent", "viewpoint", "none"),
    "profile_feature": ("extrude", "revolve", "fillet", "chamfer", "shell"),
    "region_op": ("union", "intersection", "difference", "rename", "retag", "delete"),
    "registration_method": ("point_to_point", "point_to_plane"),
    "registration_initial": ("matrix", "auto"),
    "remesh_metric": ("isotropic", "quadric", "anisotropic"),
    "island_connectivity": ("edge", "point"),
    "reorder_method": ("rcm", "morton", "hilbert"),
    "repair_fill_style": ("fan", "flat", "curved"),
    "sdf_sign": ("unsigned", "pseudonormal", "winding-number"),
    "sdf_weight": ("angle", "area"),
    "sdf_location": ("point", "cell"),
    "sdf_structure": ("voxel", "octree"),
    "sdf_watertight_check": ("off", "warn", "error"),
    "select_mode": ("all", "any", "centroid"),
    "smooth_method": ("laplacian", "taubin", "odt"),
    "split_by": ("type", "component", "tag", "regions"),
    "tensor_invariant": ("von_mises", "principal", "hydrostatic", "deviatoric"),
    "thickness_method": ("ray", "sphere", "cone"),
    "voxel_fill": ("all", "surface", "inside"),
}
#: Other spellings that mean the same; an empty text is the first of the pipeline's choices.
ALIASES: dict[str, dict[str, str]] = {
    "region_op": {"intersect": "intersection"},
    "reorder_method": {"RCM": "rcm", "z": "morton", "zorder": "morton"},
    "split_by": {"region": "tag"},
    "sdf_location": {"corner": "point", "center": "cell"},
    "pipeline_encoding": {"": "default"},
    "pipeline_mmap": {"": "auto"},
}
#: Options of which several may be named at once, separated by commas.
LISTS = frozenset({"tensor_invariant"})


def parse(option: str, name: str) -> str:
    """The spelling of ``name``; an error that lists what there is otherwise."""
    found = ALIASES.get(option, {}).get(name, name)
    if found not in OPTIONS[option]:
        raise ValueError(f"{option} {name!r} is none of {', '.join(OPTIONS[option])}")
    return found


def parse_list(option: str, names: str) -> list[str]:
    return [parse(option, n.strip()) for n in names.split(",") if n.strip()]


def place(option: str, name: str) -> int:
    """The number of a choice, as files and tables store it."""
    return OPTIONS[option].index(parse(option, name))


def name_of(option: str, number: int) -> str:
    """The spelling that ``parse`` reads back."""
    if not 0 <= number < len(OPTIONS[option]):
        raise ValueError(f"{option} has no number {number}")
    return OPTIONS[option][number]


def _parser(option: str) -> Callable[[str], str]:
    return lambda name: parse(option, name)


def _list_parser(option: str) -> Callable[[str], list[str]]:
    return lambda names: parse_list(option, names)


def _printer(option: str) -> Callable[[int], str]:
    return lambda number: name_of(option, number)


#: ``<option>_from_name`` and ``<option>_name`` for every option.
FROM_NAME: dict[str, Callable] = {f"{o}_from_name": (_list_parser if o in LISTS else _parser)(o) for o in OPTIONS}
TO_NAME: dict[str, Callable[[int], str]] = {f"{o}_name": _printer(o) for o in OPTIONS}


def __getattr__(name: str) -> Callable:
    found = FROM_NAME.get(name) or TO_NAME.get(name)
    if found is None:
        raise AttributeError(name)
    return found


def profile_features_from_text(text: str) -> list[tuple[str, list[str]]]:
    """Features such as ``extrude:5;fillet:0.5`` as (name, parameters), in order."""
    out = []
    for part in text.split(";"):
        if part.strip():
            name, *rest = part.strip().split(":")
            out.append((parse("profile_feature", name), rest))
    return out


def unknown_key_message(name: str, known: list[str]) -> str:
    """What to say of an array that isn't there."""
    return f"there is no array {name!r}; there are: {', '.join(sorted(known)) or 'none'}"
