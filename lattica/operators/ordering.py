"""Curves, partitions, marking and point budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .components import checkpointed

BITS = 21


def quantised(points: DataFrame, columns: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """qx, qy, qz: coordinates over the box of their mesh, rounded to 21 bits; 0 where the box is flat."""
    box = points.groupBy("mesh_id").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = points.join(F.broadcast(box), "mesh_id")
    top = (1 << BITS) - 1
    for c, q in zip(columns, ("qx", "qy", "qz"), strict=True):
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        value = F.floor((F.col(c) - F.col(f"lo_{c}")) * top / F.when(span > 0, span).otherwise(1.0) + 0.5)
        out = out.withColumn(q, F.when(span > 0, value).otherwise(F.lit(0)).cast("bigint"))
    return out.drop(*[f"{n}_{c}" for c in columns for n in ("lo", "hi")])


def spread(c: Column) -> Column:
    """The 21 bits of a number with two empty bits after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(qx: Column, qy: Column, qz: Column) -> Column:
    return spread(qx).bitwiseOR(F.shiftleft(spread(qy), 1)).bitwiseOR(F.shiftleft(spread(qz), 2))


def with_hilbert(df: DataFrame) -> DataFrame:
    """``hilbert``: the place of (qx, qy, qz) on a Hilbert curve, by transposition of the bits (a fixed number of column steps)."""
    x = [F.col("qx"), F.col("qy"), F.col("qz")]
    names = ("_h0", "_h1", "_h2")
    out = df.withColumns(dict(zip(names, x, strict=True)))
    for b in range(BITS - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(3):
            a, f = F.col(names[0]), F.col(names[i])
            bit = f.bitwiseAND(F.lit(q)) != 0
            swap = a.bitwiseXOR(f).bitwiseAND(F.lit(p))
            changed = {names[0]: F.when(bit, a.bitwiseXOR(F.lit(p))).otherwise(a.bitwiseXOR(swap))}
            if i:
                changed[names[i]] = F.when(bit, f).otherwise(f.bitwiseXOR(swap))
            out = out.withColumns(changed)
    # Gray code
    out = out.withColumn(names[1], F.col(names[1]).bitwiseXOR(F.col(names[0])))
    out = out.withColumn(names[2], F.col(names[2]).bitwiseXOR(F.col(names[1])))
    t = F.lit(0).cast("bigint")
    for b in range(BITS - 1, 0, -1):
        t = t.bitwiseXOR(F.when(F.col(names[2]).bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    out = out.withColumn("_t", t)
    a, b, c = (F.col(n).bitwiseXOR(F.col("_t")) for n in names)
    code = F.shiftleft(spread(a), 2).bitwiseOR(F.shiftleft(spread(b), 1)).bitwiseOR(spread(c))
    return out.withColumn("hilbert", code).drop(*names, "_t")


def numbered(df: DataFrame, order: list[str], name: str, by: str = "mesh_id") -> DataFrame:
    """``name``: the place of each row in its mesh by ``order``, from 0, without gathering a mesh in one task.

    Rows are range-sorted and cut there; a row's number is its place in its
    partition and the sizes of those before, less where its mesh begins. The
    table of sizes has a row for each partition.
    """
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    held = checkpointed(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("_at", F.col("_before") + F.col("_row"))
    starts = placed.groupBy(by).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_count"))
    out = placed.join(starts, by).withColumn(name, (F.col("_at") - F.col("_start")).cast("bigint"))
    return out.drop("_part", "_row", "_before", "_at", "_start").withColumnRenamed("_count", f"{name}_of")


def partition_labels(df: DataFrame, key: str, curve: str, parts: int, weight: str | None = None) -> DataFrame:
    """``part``: equal runs (or runs of equal weight) along a curve, ties by ``key``."""
    if weight is None:
        placed = numbered(df, [curve, key], "_rank")
        return placed.withColumn("part", F.floor(F.col("_rank") * parts / F.col("_rank_of")).cast("int")).drop("_rank", "_rank_of")
    w = Window.partitionBy("mesh_id")
    order = w.orderBy(curve, key)
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    place = F.floor((before + F.col(weight) / 2) * parts / F.sum(weight).over(w))
    return df.withColumn("part", F.least(place, F.lit(parts - 1)).cast("int"))


def mark_absolute(errors: DataFrame, column: str, limit: float) -> DataFrame:
    return errors.withColumn("marked", (finite(F.col(column)) & (F.col(column) >= limit)).cast("int"))


def mark_fraction(errors: DataFrame, column: str, share: float) -> DataFrame:
    """The floor(share N + 0.5) largest, ties by ascending cell; what is not finite is never marked."""
    usable = finite(F.col(column))
    down = F.when(usable, -F.col(column)).otherwise(F.lit(float("inf")))
    placed = numbered(errors.withColumn("_down", down), ["_down", "cell_id"], "_rank")
    take = F.floor(F.lit(share) * F.col("_rank_of") + 0.5)
    return placed.withColumn("marked", (usable & (F.col("_rank") < take)).cast("int")).drop("_down", "_rank", "_rank_of")


def mark_dorfler(errors: DataFrame, column: str, theta: float) -> DataFrame:
    """The largest, until their squares reach theta of all."""
    c = F.when(finite(F.col(column)), F.col(column))
    w = Window.partitionBy("mesh_id")
    before = F.sum(c * c).over(w.orderBy(c.desc_nulls_last(), "cell_id").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(c * c).over(w)
    return errors.withColumn("marked", (c.isNotNull() & (F.coalesce(before, F.lit(0.0)) < theta * total)).cast("int"))


def farthest_points(points: DataFrame, count: int, start: int) -> DataFrame:
    """mesh_id, step, point_id: greedy farthest points of one mesh; ties to the lowest id.

    Each step is one distributed pass with a one-row maximum. ``count`` is a
    budget set by the caller; lineage is cut as it goes.
    """
    spark = points.sparkSession
    state = points.select("mesh_id", "point_id", "x", "y", "z").withColumn("d2", F.lit(float("inf")))
    chosen = []
    at = points.where(F.col("point_id") == start).select("mesh_id", "point_id", "x", "y", "z").first()
    for step in range(count):
        if at is None:
            break
        chosen.append((at["mesh_id"], step, at["point_id"]))
        d = sum(((F.col(c) - F.lit(at[c])) ** 2 for c in "xyz"), F.lit(0.0))
        state = state.withColumn("d2", F.least("d2", d))
        if step % 8 == 7:
            state = checkpointed(state)
        best = state.agg(F.max_by(F.struct("mesh_id", "point_id", "x", "y", "z", "d2"), F.struct("d2", -F.col("point_id"))).alias("b")).first()["b"]
        at = best if best is not None and best["d2"] > 0 else None
    return spark.createDataFrame(chosen, "mesh_id string, step int, point_id bigint")


def grid_points(points: DataFrame, cell: float) -> DataFrame:
    """One point of each lattice cell: the one nearest the cell's middle, ties to the lowest id."""
    at = {f"b{c}": F.floor(F.col(c) / cell).cast("bigint") for c in "xyz"}
    d2 = sum(((F.col(c) - (F.col(f"b{c}") + 0.5) * cell) ** 2 for c in "xyz"), F.lit(0.0))
    return points.withColumns(at).groupBy("mesh_id", "bx", "by", "bz").agg(F.min(F.struct(d2.alias("d2"), "point_id"))["point_id"].alias("point_id"))


def random_points(points: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A draw of ``count`` points by the order of a hash; reruns agree."""
    return points.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "mesh_id", "point_id").cast("binary")), "point_id").limit(count)


def reorder(points: DataFrame, curve: str = "morton") -> DataFrame:
    """point_id and its new number along a curve."""
    q = quantised(points)
    keyed = with_hilbert(q).withColumnRenamed("hilbert", "_key") if curve == "hilbert" else q.withColumn("_key", morton(F.col("qx"), F.col("qy"), F.col("qz")))
    return numbered(keyed.select("mesh_id", "point_id", "_key"), ["_key", "point_id"], "new_id").select("mesh_id", "point_id", "new_id")
