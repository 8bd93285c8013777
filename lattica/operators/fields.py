"""Moving fields between meshes and steps, second derivatives, patches and dataset features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import divided, only_finite, or_nan
from ..mesh import CELL_KEYS, POINT_KEYS, MeshFrame
from .components import checkpointed, connected_components
from .geometry import Vec, corner, cross, dot, gradient, minus
from .spatial import as_other, within
from .topology import edges, feature_edges, numbered_components


def barycentric(target: DataFrame, source: MeshFrame, names: list[str], default: float = 0.0, slack: float = 1e-12) -> DataFrame:
    """The target points with each array of the simplex of ``source`` that holds them, the first by cell id; ``default`` outside.

    ``source`` has triangles (in the xy plane) or tetrahedra. A simplex goes to
    every bucket that its box touches; buckets are as wide as the widest box,
    so there are at most eight, and a point goes to one.
    """
    cells = source.with_corners(names).where(F.col("cell_type").isin("triangle", "tetra"))
    lo = {c: F.array_min(_coordinate(c)) for c in "xyz"}
    hi = {c: F.array_max(_coordinate(c)) for c in "xyz"}
    boxed = cells.select(*CELL_KEYS, "cell_type", "corners", *[lo[c].alias(f"lo{c}") for c in "xyz"], *[hi[c].alias(f"hi{c}") for c in "xyz"])
    widest = boxed.agg(F.max(F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"]))).first()[0] or 1.0
    at = lambda col: F.floor(F.col(col) / F.lit(float(widest))).cast("bigint")
    spread = boxed
    for c in "xyz":
        spread = spread.withColumn(f"b{c}", F.explode(F.sequence(at(f"lo{c}"), at(f"hi{c}"))))
    points = target.select(*POINT_KEYS, "x", "y", "z", *[at(c).alias(f"b{c}") for c in "xyz"])
    pairs = points.join(spread.drop(*[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]), ["mesh_id", "bx", "by", "bz"])
    p: Vec = (F.col("x"), F.col("y"), F.col("z"))
    q = [corner(F.col("corners"), k) for k in range(4)]

    def area(a: Vec, b: Vec, c: Vec) -> Column:
        return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])

    def volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
        return dot(cross(minus(b, a), minus(c, a)), minus(d, a))

    flat = F.array(*[divided(v, area(q[0], q[1], q[2])) for v in (area(p, q[1], q[2]), area(q[0], p, q[2]), area(q[0], q[1], p))])
    solid = F.array(*[divided(v, volume(*q)) for v in (volume(p, q[1], q[2], q[3]), volume(q[0], p, q[2], q[3]), volume(q[0], q[1], p, q[3]), volume(q[0], q[1], q[2], p))])
    weighted = pairs.withColumn("w", F.when(F.col("cell_type") == "triangle", flat).otherwise(solid)).where(F.array_min("w") >= -slack)

    def value(n: str) -> Column:
        return F.aggregate(F.zip_with("w", "corners", lambda w, c: w * c[n]), F.lit(0.0), lambda a, x: a + x)

    found = weighted.select(*POINT_KEYS, "cell_id", *[value(n).alias(n) for n in names])
    first = found.groupBy(*POINT_KEYS).agg(F.min(F.struct("cell_id", *names)).alias("f"))
    out = target.join(first, POINT_KEYS, "left")
    return out.withColumns({n: F.coalesce(F.col(f"f.{n}"), F.lit(float(default))) for n in names}).drop("f")


def _coordinate(c: str) -> Column:
    return F.col("corners").getField(c)


def blend_steps(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], w: float) -> DataFrame:
    """(1 - w) a + w b for each array; integers come from the nearer step. Rows on one side only are an error when read."""
    kinds = dict(a.dtypes)
    both = a.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names], F.lit(True).alias("_a")).join(
        b.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names], F.lit(True).alias("_b")), keys, "full"
    )
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the steps have different entities")).cast("boolean")).otherwise(True)
    whole = lambda n: kinds[n] in ("int", "bigint", "smallint", "tinyint")
    values = [(F.col(f"{'b' if w > 0.5 else 'a'}_{n}") if whole(n) else (1 - w) * F.col(f"a_{n}") + w * F.col(f"b_{n}")).alias(n) for n in names]
    return both.where(ok).select(*keys, *values)


def diff_unordered(a: DataFrame, b: DataFrame, names: list[str], atol: float = 1e-9, tolerance: float = 1e-9) -> DataFrame:
    """One row for each mesh: points of a matched to one point of b within ``atol``, ambiguous or lost ones, and value violations."""
    pairs = within(a.select(*POINT_KEYS, "x", "y", "z", *[F.col(n).alias(f"a_{n}") for n in names]), as_other(b, extra=names), atol, ["mesh_id"])
    over = sum(((F.abs(F.col(f"a_{n}") - F.col(f"other_{n}")) > tolerance).cast("int") for n in names), F.lit(0))
    best = pairs.groupBy(*POINT_KEYS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d2", "other_id", over.alias("over")))["over"].alias("over"))
    rows = a.select(*POINT_KEYS).join(best, POINT_KEYS, "left")
    return rows.groupBy("mesh_id").agg(
        F.count_if(F.col("n") == 1).alias("matched"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("n").isNull()).alias("lost"), F.coalesce(F.sum("over"), F.lit(0)).alias("violations")
    )


def exaggerate(points: DataFrame, displacement: tuple[str, str, str], factor: float) -> DataFrame:
    """Points moved along a displacement, ``factor`` times."""
    return points.withColumns({c: F.col(c) + factor * F.col(d) for c, d in zip("xyz", displacement, strict=True)})


def point_gradient(mesh: MeshFrame, name: str) -> DataFrame:
    """point_id, gx, gy, gz: the mean of the gradients of a point's cells."""
    rows = mesh.incidence().join(gradient(mesh, name), CELL_KEYS)
    return rows.groupBy(*POINT_KEYS).agg(*[or_nan(F.avg(only_finite(F.col(f"g{c}")))).alias(f"g{c}") for c in "xyz"])


def hessian(mesh: MeshFrame, name: str) -> DataFrame:
    """cell_id and h_xx ... h_zz: the gradient of each component of the gradient on the points."""
    points = mesh.points.join(point_gradient(mesh, name), POINT_KEYS)
    out = None
    for a in "xyz":
        g = gradient(mesh.with_(points=points), f"g{a}").select(*CELL_KEYS, *[F.col(f"g{b}").alias(f"h_{a}{b}") for b in "xyz"])
        out = g if out is None else out.join(g, CELL_KEYS)
    return out


def segment(mesh: MeshFrame, angle: float = 30.0) -> DataFrame:
    """mesh_id, cell_id, patch: faces joined over edges that are no crease, numbered by their lowest face."""
    faces = mesh.cells.where(F.col("cell_type").isin("triangle", "quad"))
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    sides = edges(faces).select(*CELL_KEYS, lo, hi)
    smooth = sides.join(feature_edges(mesh, angle), ["mesh_id", "lo", "hi"], "left_anti")
    links = smooth.groupBy("mesh_id", "lo", "hi").agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b")).select("mesh_id", "a", "b")
    labels = connected_components(links, ["mesh_id"]).withColumnRenamed("node", "cell_id")
    rooted = faces.select(*CELL_KEYS).join(labels, CELL_KEYS, "left").select(*CELL_KEYS, F.coalesce("component", "cell_id").alias("root"))
    return numbered_components(rooted).withColumnRenamed("component", "patch")


def grow(cells: DataFrame, seeds: DataFrame, rings: int) -> DataFrame:
    """mesh_id, cell_id, ring: the cells within ``rings`` steps over shared points of the seeds (mesh_id, cell_id)."""
    inc = cells.select(*CELL_KEYS, F.explode("nodes").alias("point_id"))
    found = checkpointed(seeds.select(*CELL_KEYS, F.lit(0).alias("ring")))
    front = found
    for k in range(1, rings + 1):
        touched = inc.join(front.select(*CELL_KEYS), CELL_KEYS, "left_semi").select("mesh_id", "point_id").distinct()
        near = inc.join(touched, ["mesh_id", "point_id"], "left_semi").select(*CELL_KEYS).distinct()
        front = checkpointed(near.join(found, CELL_KEYS, "left_anti").withColumn("ring", F.lit(k)))
        found = found.unionAll(front)
    return found


def feature_columns(points: DataFrame, arrays: list[str], regions: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Coordinates, arrays by name, then one 0/1 column for each named point region, in a fixed order."""
    out = points.select(*POINT_KEYS, "x", "y", "z", *sorted(arrays))
    if regions is None or not names:
        return out
    flags = regions.where((F.col("kind") == "point") & F.col("name").isin(names)).groupBy("mesh_id", F.col("entity").alias("point_id")).agg(
        *[F.max((F.col("name") == n).cast("int")).alias(f"region_{n}") for n in sorted(names)]
    )
    joined = out.join(flags, POINT_KEYS, "left")
    return joined.withColumns({f"region_{n}": F.coalesce(f"region_{n}", F.lit(0)) for n in sorted(names)})


def geometry_guard(train: DataFrame, check: DataFrame, names: list[str], margin: float = 1.5) -> DataFrame:
    """``check`` with score, the root mean square of its descriptors standardised by ``train``, and whether it is within ``margin`` times the worst training score. NaN counts as missing."""
    stats = train.agg(*[f(only_finite(F.col(n))).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])

    def scored(df: DataFrame) -> DataFrame:
        df = df.crossJoin(F.broadcast(stats))  # one row
        z = [only_finite(divided(F.col(n) - F.col(f"m_{n}"), F.greatest(F.col(f"s_{n}"), F.lit(1e-12)))) for n in names]
        total = sum((F.coalesce(v * v, F.lit(0.0)) for v in z), F.lit(0.0))
        count = sum((v.isNotNull().cast("int") for v in z), F.lit(0))
        return df.withColumn("score", F.sqrt(divided(total, F.greatest(count, F.lit(1))))).drop(*[f"{k}_{n}" for n in names for k in "ms"])

    worst = scored(train).agg(F.max("score").alias("_worst"))
    return scored(check).crossJoin(F.broadcast(worst)).withColumn("within", F.col("score") <= margin * F.col("_worst")).drop("_worst")


def register_landmarks(pairs: DataFrame):
    """The rigid 4 x 4 matrix that moves (x, y, z) closest to (other_x, other_y, other_z), from one row of moments."""
    from .kernels import pair_moments, rigid_from_moments

    ma, mb, cross_, _ = pair_moments(pairs)
    return rigid_from_moments(ma, mb, cross_)

