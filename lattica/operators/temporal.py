"""Time steps: bracketing, blending, resampling and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(steps: DataFrame, targets: DataFrame, keys: list[str], time: str = "time", target: str = "target") -> DataFrame:
    """For each target time the last step at or before it and the first at or after: before_*, after_* (time and step).

    Steps and targets are merged and swept once in time order for each key, so
    no pair of them is formed.
    """
    a = steps.select(*keys, F.col(time).alias("_t"), F.col("step"), F.lit(None).cast("double").alias("_target"))
    b = targets.select(*keys, F.col(target).alias("_t"), F.lit(None).cast("bigint").alias("step"), F.col(target).alias("_target"))
    rows = a.withColumn("step", F.col("step").cast("bigint")).unionByName(b)
    s = F.when(F.col("step").isNotNull(), F.struct(F.col("_t").alias("time"), "step"))
    order = Window.partitionBy(*keys).orderBy("_t")
    before = F.last(s, True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(s, True).over(order.rangeBetween(0, Window.unboundedFollowing))
    swept = rows.select(*keys, "_target", before.alias("b"), after.alias("a")).where("_target is not null")
    return swept.select(
        *keys, F.col("_target").alias(target), F.col("b.step").alias("before_step"), F.col("b.time").alias("before_time"), F.col("a.step").alias("after_step"), F.col("a.time").alias("after_time")
    )


def blend_weight(method: str = "linear", outside: str = "clamp", target: str = "target") -> Column:
    """The weight of the later step. Outside the steps: clamp to the nearest, or raise."""
    t, t0, t1 = F.col(target), F.col("before_time"), F.col("after_time")
    inner = F.when(t1 == t0, F.lit(0.0)).otherwise((t - t0) / F.when(t1 == t0, F.lit(1.0)).otherwise(t1 - t0))
    if method == "previous":
        inner = F.when(t == t1, inner).otherwise(F.lit(0.0))
    elif method == "nearest":
        inner = F.when(inner > 0.5, 1.0).otherwise(0.0)
    beyond = F.raise_error(F.lit("a target is outside the steps")).cast("double") if outside == "error" else None
    if beyond is not None:
        return F.when(t0.isNull() | t1.isNull(), beyond).otherwise(inner)
    return F.when(t0.isNull(), F.lit(1.0)).when(t1.isNull(), F.lit(0.0)).otherwise(inner)


def resample(steps: DataFrame, values: list[str], targets: DataFrame, keys: list[str], method: str = "linear", outside: str = "clamp") -> DataFrame:
    """keys, target and the values blended between the bracketing steps; integer columns come from the nearer one."""
    kinds = dict(steps.dtypes)
    plan = bracket(steps, targets, keys).withColumn("w", blend_weight(method, outside))
    early = steps.select(*keys, F.col("step").cast("bigint").alias("before_step"), *[F.col(v).alias(f"b_{v}") for v in values])
    late = steps.select(*keys, F.col("step").cast("bigint").alias("after_step"), *[F.col(v).alias(f"a_{v}") for v in values])
    rows = plan.join(early, [*keys, "before_step"], "left").join(late, [*keys, "after_step"], "left")
    w = F.col("w")
    out = []
    for v in values:
        b, a = F.coalesce(f"b_{v}", f"a_{v}"), F.coalesce(f"a_{v}", f"b_{v}")
        whole = kinds[v] in ("int", "bigint", "smallint", "tinyint")
        out.append((F.when(w > 0.5, a).otherwise(b) if whole else (1 - w) * b + w * a).alias(v))
    return rows.select(*keys, "target", "w", *out)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the values of the last row of ``right`` at or before its time, in one sweep for each key."""
    cols = left.columns
    a = left.select(F.struct(*cols).alias("_l"), *keys, F.col(time).alias("_t"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_r"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *keys, F.col(time).alias("_t"), F.struct(*values).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b).withColumn("_found", F.last("_r", True).over(order)).where("_l is not null")
    return swept.select("_l.*", *[F.col(f"_found.{v}").alias(f"last_{v}") for v in values])


def sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: float) -> DataFrame:
    """keys, session, first, last, n: runs without a gap longer than this."""
    order = Window.partitionBy(*keys).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(order) > gap_seconds, 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
