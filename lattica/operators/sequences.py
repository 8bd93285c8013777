"""Steps in time: ordering files into steps, windows of states, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import natural_key


def expand_steps(files: DataFrame, path: str = "path", times: str | None = None, explicit: dict[str, float] | None = None) -> DataFrame:
    """The files in natural order with step, time and time_source.

    Time is the explicit one of the path, else the first in the column
    ``times`` (one array for each file; a file with several times gives a step
    for each), else the last number of the file name, else the place in order.
    """
    key = natural_key(path)
    rows = files.withColumn("_key", key)
    held = F.col(times) if times else F.lit(None).cast("array<double>")
    known = F.create_map(*[x for k, v in (explicit or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if explicit else F.lit(None).cast("map<string,double>")
    own = F.when(F.size(held) > 0, held).otherwise(F.array(F.lit(None).cast("double")))
    steps = rows.select("*", F.posexplode(own).alias("_k", "_t"))
    order = Window.orderBy("_key", "_k")
    at = F.row_number().over(order) - 1
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.[A-Za-z][A-Za-z0-9]*)+$", "")
    number = F.regexp_extract(name, r"([0-9]+(?:\.[0-9]+)?)[^0-9]*$", 1)
    from_name = F.when(number != "", number.cast("double"))
    fixed = F.when(F.col("_k") == 0, known[F.col(path)])
    time = F.coalesce(fixed, "_t", from_name, at.cast("double"))
    source = F.when(fixed.isNotNull(), "explicit").when(F.col("_t").isNotNull(), "file").when(from_name.isNotNull(), "filename").otherwise("index")
    return steps.select(*files.columns, at.cast("bigint").alias("step"), time.alias("time"), source.alias("time_source"))


def state_windows(states: DataFrame, key: str, order: list[str], value: str, k: int, mode: str = "single_step") -> DataFrame:
    """Windows of ``k`` states of each key, oldest first.

    ``single_step``: key, first (the place of the oldest), states and the next
    value as target, one for each run of k + 1 states. ``one_shot``: one row a
    key, its first k states and all later ones as targets. ``time_conditional``:
    key, first, states, later (how many steps ahead) and target, for each later
    state. Keys with too few states have no row.
    """
    w = Window.partitionBy(key).orderBy(*order)
    if mode == "single_step":
        seen = F.collect_list(value).over(w.rowsBetween(-k, 0))
        rows = states.select(key, (F.row_number().over(w) - 1 - k).cast("bigint").alias("first"), seen.alias("_s")).where(F.size("_s") == k + 1)
        return rows.select(key, "first", F.slice("_s", 1, k).alias("states"), F.element_at("_s", k + 1).alias("target"))
    line = states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_l")).select(key, F.col(f"_l.{value}").alias("_v")).where(F.size("_v") > k)
    if mode == "one_shot":
        return line.select(key, F.slice("_v", 1, k).alias("states"), F.expr(f"slice(_v, {k + 1}, size(_v) - {k})").alias("targets"))
    if mode != "time_conditional":
        raise ValueError(f"{mode!r} is none of single_step, one_shot, time_conditional")
    later = line.select(key, F.slice("_v", 1, k).alias("states"), F.posexplode(F.expr(f"slice(_v, {k + 1}, size(_v) - {k})")).alias("_p", "target"))
    return later.select(key, F.lit(0).cast("bigint").alias("first"), "states", (F.col("_p") + 1).alias("later"), "target")


def window_stats(windows: DataFrame, states: str = "states", target: str | None = None) -> DataFrame:
    """One row: entries, mean and population deviation of all states in the windows, and of the changes from the last state to ``target``."""
    parts = F.explode(states).alias("v")
    whole = windows.select(parts).agg(F.count("v").alias("entries"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    if target is None:
        return whole
    change = F.col(target) - F.element_at(states, -1)
    steps = windows.agg(F.avg(change).alias("change_mean"), F.stddev_pop(change).alias("change_std"))
    return whole.join(F.broadcast(steps))


def paired_check(source: DataFrame, target: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """step, problem: steps (step, time) that only one side has, and those whose times differ by more than ``tolerance``."""
    a = source.select("step", F.col("time").alias("source_time"))
    b = target.select("step", F.col("time").alias("target_time"))
    problem: Column = F.when(F.col("source_time").isNull(), "no source").when(F.col("target_time").isNull(), "no target").when(F.abs(F.col("source_time") - F.col("target_time")) > tolerance, "times differ")
    return a.join(b, "step", "full_outer").withColumn("problem", problem).where("problem is not null").select("step", "problem")
