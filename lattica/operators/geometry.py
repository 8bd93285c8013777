"""Coordinates, measures, quality and differential operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..celltypes import FLIPPED, SIMPLICES, by_type, dimension
from ..functions.numbers import divided, finite, only_finite, or_nan
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame

Matrix = list[list[float]]
IDENTITY: Matrix = [[float(i == j) for j in range(4)] for i in range(4)]


def translation(x: float, y: float, z: float) -> Matrix:
    return [[1.0, 0.0, 0.0, x], [0.0, 1.0, 0.0, y], [0.0, 0.0, 1.0, z], IDENTITY[3]]


def scaling(x: float, y: float, z: float) -> Matrix:
    return [[x, 0.0, 0.0, 0.0], [0.0, y, 0.0, 0.0], [0.0, 0.0, z, 0.0], IDENTITY[3]]


#: Metres in a unit of length.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "um": 1e-6, "km": 1000.0, "in": 0.0254, "ft": 0.3048}


def unit_change(old: str, new: str) -> Matrix:
    return scaling(*[UNITS[old] / UNITS[new]] * 3)


def rotation(axis: tuple[float, float, float], degrees: float) -> Matrix:
    """About an axis through the origin, by the right-hand rule."""
    n = math.sqrt(sum(a * a for a in axis))
    if n == 0:
        raise ValueError("the axis has no direction")
    x, y, z = (a / n for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1 - c
    return [
        [t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0.0],
        [t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0.0],
        [t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0.0],
        IDENTITY[3],
    ]


def composed(second: Matrix, first: Matrix) -> Matrix:
    return [[sum(second[i][k] * first[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def transform(points: DataFrame, matrix: Matrix, vectors: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Affine map of the points; named vector triples turn with it."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    row = lambda r, a, b, c, d: a * r[0] + b * r[1] + c * r[2] + d
    out = {n: row(m, x, y, z, F.lit(m[3])) for n, m in zip("xyz", matrix, strict=False)}
    for names in vectors or []:
        a, b, c = (F.col(n) for n in names)
        out |= {n: row(m, a, b, c, F.lit(0.0)) for n, m in zip(names, matrix, strict=False)}
    return points.withColumns(out)


def mirror(points: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """Points reflected in a plane; ``mirror_mesh`` turns the cells as well."""
    n = math.sqrt(sum(a * a for a in normal))
    u = [a / n for a in normal]
    d = sum(((F.col(c) - o) * a for c, o, a in zip("xyz", origin, u, strict=True)), F.lit(0.0))
    return points.withColumns({c: F.col(c) - 2 * d * a for c, a in zip("xyz", u, strict=True)})


def convert_coordinates(points: DataFrame, system: str = "cylindrical") -> DataFrame:
    """r, theta, z about the z axis, or r, theta (from the z axis), phi; angles in radians, theta from 0 at x."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rho = F.sqrt(x * x + y * y)
    if system == "cylindrical":
        return points.withColumns({"cyl_r": rho, "cyl_theta": F.atan2(y, x), "cyl_z": z})
    return points.withColumns({"sph_r": F.sqrt(x * x + y * y + z * z), "sph_theta": F.atan2(rho, z), "sph_phi": F.atan2(y, x)})


def inverse_cylindrical(points: DataFrame) -> DataFrame:
    return points.withColumns({"x": F.col("cyl_r") * F.cos("cyl_theta"), "y": F.col("cyl_r") * F.sin("cyl_theta"), "z": F.col("cyl_z")})


def inverse_spherical(points: DataFrame) -> DataFrame:
    flat = F.col("sph_r") * F.sin("sph_theta")
    return points.withColumns({"x": flat * F.cos("sph_phi"), "y": flat * F.sin("sph_phi"), "z": F.col("sph_r") * F.cos("sph_theta")})


def mirror_mesh(mesh: MeshFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> MeshFrame:
    """The mesh reflected in a plane, its cells turned so that they are as they were seen from inside."""
    t, nodes = F.col("cell_type"), F.col("nodes")
    turned = by_type(t, FLIPPED, lambda order: F.array(*[nodes.getItem(k) for k in order]), nodes)
    return mesh.with_(points=mirror(mesh.points, origin, normal), cells=mesh.cells.withColumn("nodes", turned))


Vec = tuple[Column, Column, Column]


def corner(corners: Column, k: int) -> Vec:
    c = corners.getItem(k)
    return c["x"], c["y"], c["z"]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def simplex_measure(corners: Column, s: tuple[int, ...]) -> Column:
    """Length, area, or signed volume."""
    p = [corner(corners, k) for k in s]
    if len(s) == 2:
        return length(minus(p[1], p[0]))
    n = cross(minus(p[1], p[0]), minus(p[2], p[0]))
    if len(s) == 3:
        return length(n) / 2
    return dot(n, minus(p[3], p[0])) / 6


def cell_measure(cell_type: Column, corners: Column) -> Column:
    """Sum over the simplices of the type: lengths, areas, signed volumes; NaN for types without."""
    linear = {t: SIMPLICES[t] for t in SIMPLICES}

    def total(simplices):
        out = F.lit(0.0)
        for s in simplices:
            out = out + simplex_measure(corners, s)
        return out

    return by_type(cell_type, linear, total, F.lit(float("nan")))


def with_measure(mesh: MeshFrame) -> DataFrame:
    """The cells with ``measure``."""
    return mesh.with_corners().withColumn("measure", cell_measure(F.col("cell_type"), F.col("corners")))


def centroids(mesh: MeshFrame) -> DataFrame:
    """mesh_id, cell_id, cx, cy, cz: the mean of each cell's nodes."""
    return (
        mesh.incidence().join(mesh.points.select(*POINT_KEYS, "x", "y", "z"), POINT_KEYS).groupBy(*CELL_KEYS).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    )


def compute_stats(mesh: MeshFrame) -> DataFrame:
    """One row for each mesh: counts, box, centroid of the points, and measures by dimension."""
    box = mesh.points.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("num_points"),
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )
    dim, m = dimension(F.col("cell_type")), F.col("measure")
    sums = with_measure(mesh).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("num_cells"),
        F.sum(F.when(dim == 1, m).otherwise(0.0)).alias("length"),
        F.sum(F.when(dim == 2, m).otherwise(0.0)).alias("area"),
        F.sum(F.when(dim == 3, m).otherwise(0.0)).alias("signed_volume"),
        F.sum(F.when(dim == 3, F.abs(m)).otherwise(0.0)).alias("volume"),
        F.count_if((dim == 3) & (m < 0)).alias("num_inverted"),
    )
    return box.join(sums, "mesh_id", "left")


def cell_type_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("mesh_id", "cell_type").agg(F.count(F.lit(1)).alias("n"))


def compute_quality(mesh: MeshFrame) -> DataFrame:
    """cell_id with metrics, NaN where a type has none: measure, edge_ratio (longest by shortest), min and max angle of plane cells in degrees, radius_ratio of triangles, scaled_jacobian of hexahedra and tetrahedra."""
    from ..celltypes import EDGES

    t, corners, nan = F.col("cell_type"), F.col("corners"), F.lit(float("nan"))

    def edge_lengths(edges):
        return F.array(*[length(minus(corner(corners, b), corner(corners, a))) for a, b in edges])

    lengths = by_type(t, EDGES, edge_lengths, F.array().cast("array<double>"))

    def angles(n):
        out = []
        for k in range(n):
            p, a, b = corner(corners, k), corner(corners, (k + 1) % n), corner(corners, (k - 1) % n)
            u, v = minus(a, p), minus(b, p)
            out.append(F.degrees(F.acos(F.least(F.greatest(divided(dot(u, v), length(u) * length(v)), F.lit(-1.0)), F.lit(1.0)))))
        return F.array(*out)

    plane = by_type(t, {"triangle": 3, "quad": 4}, angles, F.array().cast("array<double>"))

    def jacobian(spec):
        out = []
        for at, (i, j, k) in spec:
            p = corner(corners, at)
            u, v, w = (minus(corner(corners, q), p) for q in (i, j, k))
            out.append(divided(dot(cross(u, v), w), length(u) * length(v) * length(w)))
        return F.array_min(F.array(*out))

    hexa = [(0, (1, 3, 4)), (1, (2, 0, 5)), (2, (3, 1, 6)), (3, (0, 2, 7)), (4, (7, 5, 0)), (5, (4, 6, 1)), (6, (5, 7, 2)), (7, (6, 4, 3))]
    tetra = [(0, (1, 2, 3)), (1, (2, 0, 3)), (2, (0, 1, 3)), (3, (1, 0, 2))]
    scaled = by_type(t, {"hexahedron": hexa}, jacobian, nan)
    scaled = F.when(t == "tetra", jacobian(tetra) * math.sqrt(2)).otherwise(scaled)
    out = with_measure(mesh).withColumn("_l", lengths).withColumn("_a", plane)
    a, b, c = (F.col("_l").getItem(k) for k in range(3))
    half = (a + b + c) / 2
    ratio = divided(8 * (half - a) * (half - b) * (half - c), a * b * c)  # 2 r / R
    return out.select(
        *CELL_KEYS,
        "cell_type",
        "measure",
        F.when(F.size("_l") > 0, divided(F.array_max("_l"), F.array_min("_l"))).otherwise(nan).alias("edge_ratio"),
        F.when(F.size("_a") > 0, F.array_min("_a")).otherwise(nan).alias("min_angle"),
        F.when(F.size("_a") > 0, F.array_max("_a")).otherwise(nan).alias("max_angle"),
        F.when(t == "triangle", ratio).otherwise(nan).alias("radius_ratio"),
        scaled.alias("scaled_jacobian"),
    )


def parse_quality_thresholds(spec: str) -> list[tuple[str, str, float, float]]:
    """(metric, comparison, limit, allowed share) of lines such as ``min_angle >= 20 @ 1%``; # starts a comment."""
    out = []
    for line in spec.replace(";", "\n").split("\n"):
        line = line.split("#")[0].strip()
        if not line:
            continue
        test, _, share = line.partition("@")
        op = ">=" if ">=" in test else "<="
        metric, found, limit = test.partition(op)
        if not found or not metric.strip():
            raise ValueError(f"not a threshold: {line!r}")
        out.append((metric.strip(), op, float(limit), float(share.strip().rstrip("%")) / 100 if share.strip() else 0.0))
    return out


def check_quality(quality: DataFrame, spec: str) -> DataFrame:
    """One row for each threshold: cells judged, violations, the worst cell (least margin, then id) and whether it passes."""
    rows = []
    for k, (metric, op, limit, share) in enumerate(parse_quality_thresholds(spec)):
        margin = F.col(metric) - limit if op == ">=" else limit - F.col(metric)
        rows.append(F.struct(F.lit(k).alias("row"), F.lit(metric).alias("metric"), F.lit(share).alias("share"), only_finite(margin).alias("margin")))
    long = quality.select("cell_id", F.explode(F.array(*rows)).alias("e")).select("cell_id", "e.*")
    bad = F.count_if(F.col("margin") < 0)
    n = F.count("margin")
    return long.groupBy("row", "metric", "share").agg(
        n.alias("evaluated"),
        bad.alias("violations"),
        F.min(F.when(F.col("margin").isNotNull(), F.struct("margin", "cell_id")))["cell_id"].alias("worst_cell"),
        ((bad == 0) | (divided(bad, n) <= F.first("share"))).alias("passes"),
    )


def gradient(mesh: MeshFrame, name: str) -> DataFrame:
    """mesh_id, cell_id, gx, gy, gz of a point array on each cell, by least squares over its nodes about their mean.

    NaN where the nodes span too little (plane cells with constant z take the
    plane's gradient).
    """
    v = F.col(name).cast("double")
    rows = mesh.incidence().join(mesh.points.select(*POINT_KEYS, "x", "y", "z", name), POINT_KEYS)
    means = rows.groupBy(*CELL_KEYS).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.avg(v).alias("mv"))
    d = rows.join(means, CELL_KEYS).select(*CELL_KEYS, *[(F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in "xyz"], (v - F.col("mv")).alias("dv"))
    pairs = ["xx", "yy", "zz", "xy", "yz", "zx"]
    s = d.groupBy(*CELL_KEYS).agg(
        *[F.sum(F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(f"s{p}") for p in pairs], *[F.sum(F.col(f"d{c}") * F.col("dv")).alias(f"b{c}") for c in "xyz"]
    )
    # cells in a plane of constant z: the z row is replaced by g_z = 0
    flat = F.col("szz") == 0
    xx, yy, xy = F.col("sxx"), F.col("syy"), F.col("sxy")
    zz = F.when(flat, F.lit(1.0)).otherwise(F.col("szz"))
    yz, zx = F.when(flat, F.lit(0.0)).otherwise(F.col("syz")), F.when(flat, F.lit(0.0)).otherwise(F.col("szx"))
    bx, by, bz = F.col("bx"), F.col("by"), F.when(flat, F.lit(0.0)).otherwise(F.col("bz"))
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * zx) + zx * (xy * yz - yy * zx)
    gx = bx * (yy * zz - yz * yz) - xy * (by * zz - yz * bz) + zx * (by * yz - yy * bz)
    gy = xx * (by * zz - yz * bz) - bx * (xy * zz - yz * zx) + zx * (xy * bz - by * zx)
    gz = xx * (yy * bz - by * yz) - xy * (xy * bz - by * zx) + bx * (xy * yz - yy * zx)
    usable = F.abs(det) > 1e-12 * F.greatest(xx * yy * zz, F.lit(1e-300))
    value = lambda g: F.when(usable, g / F.when(usable, det).otherwise(1.0)).otherwise(F.lit(float("nan")))
    return s.select(*CELL_KEYS, value(gx).alias("gx"), value(gy).alias("gy"), value(gz).alias("gz"))


def estimate_error(mesh: MeshFrame, name: str) -> DataFrame:
    """cell_id and eta: the size of the jump between each cell's gradient and the one recovered on its points."""
    g = gradient(mesh, name).join(with_measure(mesh).select(*CELL_KEYS, F.abs("measure").alias("w")), CELL_KEYS)
    on_points = (
        mesh.incidence().join(g, CELL_KEYS).groupBy(*POINT_KEYS).agg(*[divided(F.sum(only_finite(F.col(f"g{c}")) * F.col("w")), F.sum(F.when(finite(F.col(f"g{c}")), F.col("w")))).alias(f"p{c}") for c in "xyz"])
    )
    back = mesh.incidence().join(on_points, POINT_KEYS).groupBy(*CELL_KEYS).agg(*[F.avg(only_finite(F.col(f"p{c}"))).alias(f"r{c}") for c in "xyz"])
    square = sum(((F.col(f"r{c}") - F.col(f"g{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return g.join(back, CELL_KEYS).select(*CELL_KEYS, or_nan(F.sqrt(F.col("w") * square)).alias("eta"))


def error_size(mesh: MeshFrame, errors: DataFrame, target: float, order: float = 1.0) -> DataFrame:
    """point_id and size: least over its cells of the cell size scaled by (target / eta)^(1 / order)."""
    cells = with_measure(mesh).join(errors, CELL_KEYS)
    size = F.pow(F.abs("measure"), 1.0 / F.greatest(dimension(F.col("cell_type")), F.lit(1)))
    scale = F.pow(divided(F.lit(float(target)), F.col("eta")), F.lit(1.0 / order))
    wanted = cells.select(*CELL_KEYS, F.when(F.col("eta") > 0, size * scale).alias("size"))
    return mesh.incidence().join(wanted, CELL_KEYS).groupBy(*POINT_KEYS).agg(F.min("size").alias("size"))


def cell_normals(mesh: MeshFrame) -> DataFrame:
    """Unit normals of triangles and quads (by the cross of the diagonals), with twice the area."""
    c = F.col("corners")
    t3 = cross(minus(corner(c, 1), corner(c, 0)), minus(corner(c, 2), corner(c, 0)))
    t4 = cross(minus(corner(c, 2), corner(c, 0)), minus(corner(c, 3), corner(c, 1)))
    faces = mesh.with_corners().where(F.col("cell_type").isin("triangle", "quad"))
    n = [F.when(F.col("cell_type") == "triangle", a).otherwise(b) for a, b in zip(t3, t4, strict=True)]
    out = faces.select(*CELL_KEYS, *[v.alias(k) for k, v in zip(("ux", "uy", "uz"), n, strict=True)])
    size = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    return out.select(*CELL_KEYS, *[divided(F.col(f"u{k}"), size).alias(f"n{k}") for k in "xyz"], size.alias("weight"))


def point_normals(mesh: MeshFrame) -> DataFrame:
    """Unit normals of points: the area-weighted mean over their faces."""
    w = mesh.incidence().join(cell_normals(mesh), CELL_KEYS)
    s = w.groupBy(*POINT_KEYS).agg(*[F.sum(F.col(f"n{k}") * F.col("weight")).alias(f"s{k}") for k in "xyz"])
    size = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2)
    return s.select(*POINT_KEYS, *[divided(F.col(f"s{k}"), size).alias(f"n{k}") for k in "xyz"])


def angle_defect(mesh: MeshFrame) -> DataFrame:
    """point_id, defect (2 pi less the angles of its triangles), area (a third of them) and gaussian curvature."""
    c = F.col("corners")
    rows = []
    for k in range(3):
        u, v = minus(corner(c, (k + 1) % 3), corner(c, k)), minus(corner(c, (k + 2) % 3), corner(c, k))
        angle = F.acos(F.least(F.greatest(divided(dot(u, v), length(u) * length(v)), F.lit(-1.0)), F.lit(1.0)))
        rows.append(F.struct(F.col("nodes").getItem(k).alias("point_id"), angle.alias("angle")))
    area = simplex_measure(c, (0, 1, 2)) / 3
    faces = mesh.with_corners().where("cell_type = 'triangle'").select("mesh_id", area.alias("third"), F.explode(F.array(*rows)).alias("e"))
    sums = faces.groupBy("mesh_id", F.col("e.point_id").alias("point_id")).agg(F.sum("e.angle").alias("angles"), F.sum("third").alias("area"))
    defect = F.lit(2 * math.pi) - F.col("angles")
    return sums.select(*POINT_KEYS, defect.alias("defect"), "area", divided(defect, F.col("area")).alias("gaussian"))


def check_tetrahedra(mesh: MeshFrame, factor: float = 1e-6) -> DataFrame:
    """One row for each mesh: tetrahedra inverted and degenerate, by a volume tolerance of ``factor`` x longest edge cubed."""
    from ..celltypes import EDGES

    c = F.col("corners")
    longest = F.greatest(*[length(minus(corner(c, b), corner(c, a))) for a, b in EDGES["tetra"]])
    tol = factor * longest**3
    v = simplex_measure(c, (0, 1, 2, 3))
    return mesh.with_corners().where("cell_type = 'tetra'").groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("num_tetrahedra"), F.count_if(v < -tol).alias("inverted"), F.count_if(F.abs(v) <= tol).alias("degenerate")
    )
