"""Operators on data arrays: columns of the points or the cells of a mesh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expression import compiled
from ..functions.numbers import clamped, divided, finite, only_finite, or_nan
from ..mesh import CELL_COLUMNS, CELL_KEYS, POINT_COLUMNS, POINT_KEYS, MeshFrame

FIXED = set(POINT_COLUMNS) | set(CELL_COLUMNS)


def arrays_of(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c not in FIXED)


def _known(df: DataFrame, names: list[str], ignore_missing: bool) -> list[str]:
    missing = [n for n in names if n not in arrays_of(df)]
    if missing and not ignore_missing:
        raise KeyError(f"no arrays {missing}; there are {arrays_of(df)}")
    return [n for n in names if n not in missing]


def data_keep(df: DataFrame, names: list[str], ignore_missing: bool = False) -> DataFrame:
    """Only these arrays; an empty list leaves none."""
    kept = _known(df, names, ignore_missing)
    return df.select(*[c for c in df.columns if c in FIXED or c in kept])


def data_drop(df: DataFrame, names: list[str], ignore_missing: bool = False) -> DataFrame:
    return df.drop(*_known(df, names, ignore_missing))


def data_rename(df: DataFrame, renames: dict[str, str], ignore_missing: bool = False) -> DataFrame:
    """All renames at once, so that two names may be swapped; names that meet are an error."""
    known = {o: n for o, n in renames.items() if o in _known(df, list(renames), ignore_missing)}
    result = [known.get(c, c) for c in df.columns]
    if len(set(result)) < len(result):
        raise ValueError(f"names meet: {sorted(n for n in result if result.count(n) > 1)}")
    return df.toDF(*result)


def data_manage(
    df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, ignore_missing: bool = False
) -> DataFrame:
    """Keep, then drop, then rename."""
    if keep is not None:
        df = data_keep(df, keep, ignore_missing)
    if drop:
        df = data_drop(df, drop, ignore_missing)
    return data_rename(df, rename, ignore_missing) if rename else df


def data_calc(df: DataFrame, output: str, expression: str, components: dict[str, int] | None = None, overwrite: bool = False) -> DataFrame:
    """``output`` from an expression over the arrays."""
    if output in df.columns and not overwrite:
        raise ValueError(f"there is an array {output!r}")
    return df.withColumn(output, compiled(expression, df, components))


def data_info(df: DataFrame, location: str, names: list[str] | None = None) -> DataFrame:
    """One row for each array: entries, and of its finite values number, least, greatest and mean."""
    names = names or [n for n in arrays_of(df) if dict(df.dtypes)[n] not in ("string", "timestamp", "date", "boolean")]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("v")) for n in names])).alias("e"))
    v = F.col("e.v")
    good = only_finite(v)
    return long.groupBy(F.col("e.name").alias("name")).agg(
        F.lit(location).alias("location"),
        F.count(F.lit(1)).alias("entries"),
        F.count(good).alias("num_finite"),
        F.count_if(F.isnan(v)).alias("num_nan"),
        F.count_if(~F.isnan(v) & (F.abs(v) == F.lit(float("inf")))).alias("num_inf"),
        F.min(good).alias("least"),
        F.max(good).alias("greatest"),
        F.avg(good).alias("mean"),
    )


def data_condition(df: DataFrame, name: str, mode: str = "clamp", lo: float = 0.0, hi: float = 1.0, output: str | None = None, by: list[str] | None = None) -> DataFrame:
    """clamp, normalize (own finite range onto [lo, hi]; constant gives lo) or standardize (population deviation; none gives 0).

    The statistics are one row for each group of ``by``, joined back by
    broadcast when there is one group.
    """
    output = output or name
    c = F.col(f"`{name}`").cast("double")
    if mode == "clamp":
        return df.withColumn(output, clamped(c, lo, hi))
    good = only_finite(c)
    aggregates = {
        "normalize": [F.min(good).alias("_a"), F.max(good).alias("_b")],
        "standardize": [F.avg(good).alias("_a"), F.stddev_pop(good).alias("_b")],
    }[mode]
    if by:
        out = df.join(df.groupBy(*by).agg(*aggregates), by)
    else:
        out = df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    a, b = F.col("_a"), F.col("_b")
    if mode == "normalize":
        value = F.when(b == a, F.lit(float(lo))).otherwise(lo + (c - a) / F.when(b == a, 1.0).otherwise(b - a) * (hi - lo))
    else:
        value = F.when(b == 0, F.lit(0.0)).otherwise((c - a) / F.when(b == 0, 1.0).otherwise(b))
    return out.withColumn(output, F.when(finite(c), value).otherwise(c)).drop("_a", "_b")


def nan_policy(df: DataFrame, name: str, policy: str = "ignore", replacement: float = 0.0) -> DataFrame:
    """ignore leaves, replace puts a number for what is not finite, fail raises when a row is read."""
    c = F.col(f"`{name}`").cast("double")
    if policy == "ignore":
        return df
    if policy == "replace":
        return df.withColumn(name, F.when(finite(c), c).otherwise(F.lit(float(replacement))))
    return df.withColumn(name, F.when(finite(c), c).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast("double")))


def point_data_to_cell_data(mesh: MeshFrame, names: list[str]) -> DataFrame:
    """Each cell's mean over its own nodes' finite values, repeats counted; NaN where there is none."""
    joined = mesh.incidence().join(mesh.points.select(*POINT_KEYS, *names), POINT_KEYS)
    means = joined.groupBy(*CELL_KEYS).agg(*[or_nan(F.avg(only_finite(F.col(n).cast("double")))).alias(n) for n in names])
    return means


def cell_data_to_point_data(mesh: MeshFrame, names: list[str], weight: str | None = None) -> DataFrame:
    """Each point's mean over its cells, by the absolute ``weight`` if one is named; NaN where there is none."""
    joined = mesh.incidence().join(mesh.cells.select(*CELL_KEYS, *names, *([weight] if weight else [])), CELL_KEYS)
    w = F.abs(F.col(weight).cast("double")) if weight else F.lit(1.0)
    w = F.when(finite(w), w).otherwise(F.lit(1.0))
    out = []
    for n in names:
        v = only_finite(F.col(n).cast("double"))
        out.append(or_nan(divided(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))).alias(n))
    return joined.groupBy(*POINT_KEYS).agg(*out)


def data_integrate(cells: DataFrame, names: list[str], measure: str = "measure", regions: DataFrame | None = None) -> DataFrame:
    """Total, mean and measure of each array over the domain and over every named cell region.

    Regions may overlap, so each is summed on its own; the domain is the row
    whose region is null.
    """
    m = F.abs(F.col(measure).cast("double"))

    def sums(df: DataFrame, keys: list[str]) -> DataFrame:
        parts = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names]
        long = df.select(*keys, m.alias("m"), F.explode(F.array(*parts)).alias("e"))
        v = only_finite(F.col("e.v"))
        return long.groupBy(*keys, F.col("e.name").alias("name")).agg(
            F.sum(v * F.col("m")).alias("total"),
            divided(F.sum(v * F.col("m")), F.sum(F.when(v.isNotNull(), F.col("m")))).alias("mean"),
            F.sum(F.when(v.isNotNull(), F.col("m"))).alias("measure"),
            F.count_if(F.isnan(F.col("e.v"))).alias("num_nan"),
        )

    out = sums(cells, ["mesh_id"]).withColumn("region", F.lit(None).cast("string"))
    if regions is not None:
        entries = regions.where("kind = 'cell'").select("mesh_id", F.col("name").alias("region"), F.col("entity").alias("cell_id"))
        out = out.unionByName(sums(cells.join(entries, CELL_KEYS), ["mesh_id", "region"]))
    return out


def tensor_invariants(df: DataFrame, components: list[str], prefix: str = "") -> DataFrame:
    """von Mises, hydrostatic and principal values (ascending) of symmetric tensors xx yy zz xy yz zx.

    The principal values come from the trigonometric form of the cubic; a
    tensor with a component that is not finite gives NaN.
    """
    names = [f"_t{k}" for k in range(6)]
    out = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, components, strict=True)})
    xx, yy, zz, xy, yz, zx = (F.col(n) for n in names)
    good = reduce(lambda a, b: a & b, [finite(F.col(n)) for n in names])
    out = out.withColumns({"_good": good, "_mean": (xx + yy + zz) / 3, "_off": xy * xy + yz * yz + zx * zx})
    mean, off = F.col("_mean"), F.col("_off")
    a, b, c = xx - mean, yy - mean, zz - mean
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * zx) + zx * (xy * yz - b * zx)
    out = out.withColumns({"_p": F.sqrt((a * a + b * b + c * c + 2 * off) / 6), "_det": det})
    p = F.col("_p")
    r = F.when(p > 0, F.col("_det") / (2 * F.when(p > 0, p).otherwise(F.lit(1.0)) ** 3)).otherwise(F.lit(0.0))
    out = out.withColumn("_angle", F.acos(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))) / 3)
    angle, third = F.col("_angle"), 2 * 3.141592653589793 / 3
    out = out.withColumns({"_high": mean + 2 * p * F.cos(angle), "_low": mean + 2 * p * F.cos(angle + third)})
    mises = F.sqrt(0.5 * ((xx - yy) ** 2 + (yy - zz) ** 2 + (zz - xx) ** 2) + 3 * off)
    nan = F.lit(float("nan"))
    values = {"von_mises": mises, "hydrostatic": mean, "principal_1": F.col("_low"), "principal_2": 3 * mean - F.col("_high") - F.col("_low"), "principal_3": F.col("_high")}
    out = out.withColumns({prefix + k: F.when(F.col("_good"), v).otherwise(nan) for k, v in values.items()})
    return out.drop(*names, "_good", "_mean", "_off", "_p", "_det", "_angle", "_high", "_low")


#: End colours of the maps, red green blue from 0 to 255.
COLOR_ENDS = {"gray": ((0, 0, 0), (255, 255, 255)), "cool": ((0, 255, 255), (255, 0, 255)), "autumn": ((255, 0, 0), (255, 255, 0))}


def colorize(df: DataFrame, name: str, vmin: float, vmax: float, cmap: str = "gray", steps: int = 0, nan_color: tuple[int, int, int] = (128, 128, 128)) -> DataFrame:
    """red, green and blue columns by a linear map of [vmin, vmax]; ``steps`` bands take the colour of their middle."""
    c = F.col(name).cast("double")
    t = F.least(F.greatest((c - vmin) / (vmax - vmin if vmax > vmin else 1.0), F.lit(0.0)), F.lit(1.0))
    if steps:
        t = (F.least(F.floor(t * steps), F.lit(steps - 1)) + 0.5) / steps
    lo, hi = COLOR_ENDS[cmap]
    shade = lambda k: F.when(finite(c), F.floor(lo[k] + t * (hi[k] - lo[k]) + 0.5)).otherwise(F.lit(nan_color[k])).cast("int")
    return df.withColumns({n: shade(k) for k, n in enumerate(("red", "green", "blue"))})


def compare_arrays(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], atol: float = 1e-12, rtol: float = 1e-9) -> DataFrame:
    """For each array: rows on either side only, rows beyond ``atol + rtol |expected|``, and the worst one.

    A difference that is NaN never exceeds, but makes the array inexact.
    """
    left = a.select(*keys, *[F.col(n).cast("double").alias(f"a_{n}") for n in names], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(n).cast("double").alias(f"b_{n}") for n in names], F.lit(True).alias("in_b"))
    both = left.join(right, keys, "full")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"a_{n}").alias("a"), F.col(f"b_{n}").alias("b")) for n in names])
    long = both.select(*keys, "in_a", "in_b", F.explode(rows).alias("e"))
    err = F.abs(F.col("e.b") - F.col("e.a"))
    paired = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    over = paired & ~F.isnan(err) & (err > atol + rtol * F.abs(F.col("e.a")))
    same = paired & ((F.col("e.a") == F.col("e.b")) & ~F.isnan(F.col("e.a")))
    return long.groupBy(F.col("e.name").alias("name")).agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(over).alias("violations"),
        F.count_if(paired & ~same).alias("inexact"),
        F.max(F.when(~F.isnan(err), err)).alias("max_abs_error"),
    )


def verdict(compared: DataFrame) -> DataFrame:
    """One row: identical, equal within tolerance, or different."""
    lone, over, inexact = F.sum(F.col("only_a") + F.col("only_b")), F.sum("violations"), F.sum("inexact")
    return compared.agg(
        F.when((lone > 0) | (over > 0), "different").when(inexact > 0, "equal within tolerance").otherwise("identical").alias("verdict")
    )


def histogram(df: DataFrame, name: str, bins: int = 10, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in equal bins over the finite range, the top edge in the last bin; a range of zero is all in bin 0."""
    rows = df.select(only_finite(F.col(name).cast("double")).alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    low = F.col("lo") if lo is None else F.lit(float(lo))
    span = (F.col("hi") if hi is None else F.lit(float(hi))) - low
    at = F.when(span > 0, F.least(F.greatest(F.floor((F.col("v") - low) / F.when(span > 0, span).otherwise(1.0) * bins), F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
