"""Joins by distance: a grid of buckets turns |a - b| <= r into an equi-join."""

from __future__ import annotations

import itertools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Buckets along a side of a box that repeats.
MOST_BUCKETS = 1 << 20


def buckets(cell: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(cell)).cast("bigint").alias(f"b{c}") for c in AXES]


def around(df: DataFrame, cell: float, reach: int = 1) -> DataFrame:
    """Each row once for each bucket within ``reach`` of its own."""
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{c}") for c, o in zip(AXES, t, strict=True)]) for t in itertools.product(range(-reach, reach + 1), repeat=3)])
    near = df.select("*", *buckets(cell), F.explode(offsets).alias("_o"))
    return near.withColumns({f"b{c}": F.col(f"b{c}") + F.col(f"_o.o{c}") for c in AXES}).drop("_o")


def squared_distance(a: str = "", b: str = "other_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in AXES), F.lit(0.0))


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` (columns other_x, other_y, other_z) at most ``radius`` away, and ``d2``.

    ``left`` is sent to the 27 buckets around its own and ``right`` to one, so
    the join is an equi-join on the bucket, which adaptive execution splits
    where a bucket is crowded.
    """
    keys = keys or []
    cell = radius if radius > 0 else 1.0
    placed = right.select("*", *[F.floor(F.col(f"other_{c}") / F.lit(cell)).cast("bigint").alias(f"b{c}") for c in AXES])
    pairs = around(left, cell).join(placed, [*keys, "bx", "by", "bz"]).withColumn("d2", squared_distance())
    return pairs.where(F.col("d2") <= radius * radius).drop("bx", "by", "bz")


def as_other(points: DataFrame, key: str = "point_id", extra: list[str] | None = None) -> DataFrame:
    return points.select("mesh_id", F.col(key).alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in [*AXES, *(extra or [])]])


def bucketed_pairs(points: DataFrame, radius: float) -> DataFrame:
    """mesh_id, a, b, d2 with a < b: all pairs at most ``radius`` apart, once each.

    Each point goes to its own bucket and to the 13 of its 26 neighbours that
    come after it, so two points meet in one place only.
    """
    cell = radius if radius > 0 else 1.0
    placed = points.select("mesh_id", "point_id", *AXES, *buckets(cell))
    offsets = [t for t in itertools.product((-1, 0, 1), repeat=3) if t >= (0, 0, 0)]
    near = placed.withColumn("_o", F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{c}") for c, o in zip(AXES, t, strict=True)]) for t in offsets])))
    own = (F.col("_o.ox") == 0) & (F.col("_o.oy") == 0) & (F.col("_o.oz") == 0)
    near = near.withColumn("_own", own).withColumns({f"b{c}": F.col(f"b{c}") + F.col(f"_o.o{c}") for c in AXES}).drop("_o")
    other = placed.withColumnsRenamed({"point_id": "other_id"} | {c: f"other_{c}" for c in AXES})
    # all points are on either side: never sent to the driver and all tasks, however small they are in Parquet
    pairs = near.join(other.hint("merge"), ["mesh_id", *[f"b{c}" for c in AXES]]).withColumn("d2", squared_distance()).where(F.col("d2") <= radius * radius)
    pairs = pairs.where(F.when(F.col("_own"), F.col("point_id") < F.col("other_id")).otherwise(F.col("point_id") != F.col("other_id")))
    return pairs.select("mesh_id", F.least("point_id", "other_id").alias("a"), F.greatest("point_id", "other_id").alias("b"), "d2")


def periodic_pairs(points: DataFrame, radius: float, box: tuple[float, float, float]) -> DataFrame:
    """As ``bucketed_pairs`` in a box that repeats; the radius is at most half its least side.

    Along each axis the distance is the lesser of that between the points and
    that of one to the other's image a side away. Coordinates stay as they are
    and may lie anywhere: only their buckets wrap around, so no point has
    copies and no rounding of shifted places decides.
    """
    if radius > min(box) / 2:
        raise ValueError("the radius is over half the box")
    # a little wider than the radius, so that rounding never puts a pair two buckets apart
    counts = [max(1, int(min(b / (radius * (1 + 1e-6)) if radius > 0 else MOST_BUCKETS, MOST_BUCKETS))) for b in box]
    steps = [(-1, 0, 1) if n > 2 else tuple(range(n)) for n in counts]
    bucket = {c: F.pmod(F.floor(F.pmod(F.col(c), F.lit(float(b))) / F.lit(b / n)), F.lit(n)) for c, b, n in zip(AXES, box, counts, strict=True)}
    placed = points.select("mesh_id", "point_id", *AXES, *[v.alias(f"b{c}") for c, v in bucket.items()])
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{c}") for c, o in zip(AXES, t, strict=True)]) for t in itertools.product(*steps)])
    near = placed.withColumn("_o", F.explode(offsets))
    near = near.withColumns({f"b{c}": F.pmod(F.col(f"b{c}") + F.col(f"_o.o{c}"), F.lit(n)) for c, n in zip(AXES, counts, strict=True)}).drop("_o")
    other = placed.withColumnsRenamed({"point_id": "other_id"} | {c: f"other_{c}" for c in AXES})
    apart = {c: F.abs(F.col(c) - F.col(f"other_{c}")) for c in AXES}
    d2 = sum((F.least(apart[c], F.lit(float(b)) - apart[c]) ** 2 for c, b in zip(AXES, box, strict=True)), F.lit(0.0))
    pairs = near.join(other.hint("merge"), ["mesh_id", *[f"b{c}" for c in AXES]]).where("point_id < other_id").withColumn("d2", d2).where(F.col("d2") <= float(Decimal(str(radius)) ** 2))
    return pairs.groupBy("mesh_id", F.col("point_id").alias("a"), F.col("other_id").alias("b")).agg(F.min("d2").alias("d2"))


def k_nearest(queries: DataFrame, points: DataFrame, k: int, key: str = "point_id", start: float | None = None, same: bool = True) -> DataFrame:
    """mesh_id, key, other_id, d2, rank: the k nearest of ``points`` to each query, ties to the lower id.

    The search is around the place of the points' box that is nearest to the
    query, h away from it: what is farther than r from there is farther than
    sqrt(r^2 + h^2) from the query, so a query far outside meets no more points
    than one inside. The radius starts where about k neighbours are expected
    and doubles for the queries that have not found k yet within it, so no
    query meets all points. ``same`` leaves a point out of its own neighbours.
    Meshes with fewer than k others give what there is.
    """
    from .components import checkpointed

    boxes = points.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("_all"), *[F.min(c).alias(f"_lo{c}") for c in AXES], *[F.max(c).alias(f"_hi{c}") for c in AXES]
    )
    spans = [F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in AXES]
    widest = boxes.agg(F.sum("_all").alias("n"), *[F.max(s).alias(c) for c, s in zip(AXES, spans, strict=True)]).first()
    sides = [widest[c] or 0.0 for c in AXES]
    reach = sum(s * s for s in sides) ** 0.5
    if start is None:
        live = [s for s in sides if s > 0] or [1.0]
        volume = 1.0
        for s in live:
            volume *= s
        start = max((volume * (k + 1) / max(1, widest["n"] or 1)) ** (1 / len(live)), 1e-12)
    inside = {c: F.least(F.greatest(F.col(c), F.col(f"_lo{c}")), F.col(f"_hi{c}")) for c in AXES}
    open_ = (
        queries.select("mesh_id", key, *AXES)
        .join(F.broadcast(boxes), "mesh_id")
        .withColumns({f"_q{c}": F.col(c) for c in AXES})
        .withColumns(inside)
        .withColumn("_h2", squared_distance("", "_q"))
        .withColumn("_need", F.least(F.lit(k), F.col("_all") - (1 if same else 0)))
        .select("mesh_id", key, *AXES, *[f"_q{c}" for c in AXES], "_h2", "_need")
    )
    other = as_other(points)
    out = None
    radius = start
    order = Window.partitionBy("mesh_id", key).orderBy("d2", "other_id")
    while True:
        last = radius > 2 * reach
        found = within(open_, other, radius, ["mesh_id"]).withColumn("d2", squared_distance("_q"))
        if not last:
            found = found.where(F.col("d2") <= radius * radius + F.col("_h2"))
        if same:
            found = found.where(F.col(key) != F.col("other_id"))
        ranked = found.select("mesh_id", key, "other_id", "d2", "_need").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("mesh_id", key)))
        ready = checkpointed((ranked if last else ranked.where(F.col("_n") >= F.col("_need"))).drop("_n", "_need"))
        out = ready if out is None else out.unionAll(ready)
        if last:
            return out
        open_ = checkpointed(open_.join(ready.select("mesh_id", key).distinct(), ["mesh_id", key], "left_anti"))
        if open_.isEmpty():
            return out
        radius *= 2


def nearest(queries: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    """mesh_id, key, other_id, d2 of the nearest point, ties to the lower id."""
    return k_nearest(queries, points, 1, key, same=False).drop("rank")


def interpolate_nearest(target: DataFrame, source: DataFrame, names: list[str]) -> DataFrame:
    """The target points with each array of the nearest source point."""
    found = nearest(target, source).drop("d2")
    values = source.select("mesh_id", F.col("point_id").alias("other_id"), *names)
    return target.join(found, ["mesh_id", "point_id"], "left").join(values, ["mesh_id", "other_id"], "left").drop("other_id")


def match_periodic(slave: DataFrame, master: DataFrame, matrix: list[list[float]], atol: float = 1e-8) -> DataFrame:
    """mesh_id, slave, master: each slave point moved by ``matrix`` and matched to the nearest master within ``atol``, null if none."""
    from .geometry import transform

    moved = transform(slave.select("mesh_id", "point_id", *AXES), matrix)
    pairs = within(moved, as_other(master), atol, ["mesh_id"])
    best = pairs.groupBy("mesh_id", "point_id").agg(F.min(F.struct("d2", "other_id"))["other_id"].alias("master"))
    return slave.select("mesh_id", F.col("point_id").alias("slave")).join(best.withColumnRenamed("point_id", "slave"), ["mesh_id", "slave"], "left")


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each mesh_id: the largest, mean and root mean square distance from a's points to b's, and the other way."""

    def one_way(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        d = F.sqrt("d2")
        return nearest(p, q).groupBy("mesh_id").agg(F.max(d).alias(f"max_{name}"), F.avg(d).alias(f"mean_{name}"), F.sqrt(F.avg("d2")).alias(f"rms_{name}"))

    both = one_way(a, b, "ab").join(one_way(b, a, "ba"), "mesh_id")
    return both.withColumn("hausdorff", F.greatest("max_ab", "max_ba"))


def plane_deviation(origin: tuple[float, float, float], normal: tuple[float, float, float]) -> Column:
    """Signed distance to a plane."""
    n = sum(a * a for a in normal) ** 0.5
    return sum(((F.col(c) - o) * (a / n) for c, o, a in zip(AXES, origin, normal, strict=True)), F.lit(0.0))


def sphere_deviation(centre: tuple[float, float, float], radius: float) -> Column:
    return F.sqrt(sum(((F.col(c) - o) ** 2 for c, o in zip(AXES, centre, strict=True)), F.lit(0.0))) - radius


def cylinder_deviation(origin: tuple[float, float, float], axis: tuple[float, float, float], radius: float) -> Column:
    n = sum(a * a for a in axis) ** 0.5
    u = [a / n for a in axis]
    d = [F.col(c) - o for c, o in zip(AXES, origin, strict=True)]
    along = sum((x * a for x, a in zip(d, u, strict=True)), F.lit(0.0))
    return F.sqrt(F.greatest(sum((x * x for x in d), F.lit(0.0)) - along * along, F.lit(0.0))) - radius


def deviation_report(points: DataFrame, distance: Column, tolerance: float) -> DataFrame:
    """One row for each mesh: statistics of a signed distance; percentiles are interpolated."""
    rows = points.select("mesh_id", distance.alias("d"))
    return rows.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("d").alias("least"),
        F.max("d").alias("greatest"),
        F.avg("d").alias("mean"),
        F.sqrt(F.avg(F.col("d") ** 2)).alias("rms"),
        F.stddev_pop("d").alias("sigma"),
        *[F.percentile("d", p / 100).alias(f"p{p}") for p in (1, 5, 50, 95, 99)],
        (F.count_if(F.abs("d") <= tolerance) / F.count(F.lit(1))).alias("within"),
    )
