"""Region algebra: named sets of points, cells or sides, one row for each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["mesh_id", "kind", "entity"]


def region(regions: DataFrame, kind: str, name: str) -> DataFrame:
    return regions.where((F.col("kind") == kind) & (F.col("name") == name))


def find_region(regions: DataFrame, kind: str | None = None, name: str | None = None, tag: int | None = None) -> DataFrame:
    """The one region that fits; reading it raises where several fit."""
    out = regions
    for column, value in (("kind", kind), ("name", name), ("tag", tag)):
        if value is not None:
            out = out.where(F.col(column) == value)
    found = out.select("mesh_id", "kind", "name", "dim", "tag").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("mesh_id"))
    return found.withColumn("ok", F.when(n > 1, F.raise_error(F.lit("several regions fit")).cast("boolean")).otherwise(True)).where("ok").drop("ok")


def combine(regions: DataFrame, operation: str, kind: str, inputs: list[str], output: str, tag: int = 0, keep_inputs: bool = True) -> DataFrame:
    """union, intersection or difference (the first without the others) of regions of one kind, as ``output``.

    One pass: each entry counts the inputs it is in. A region of the same name
    and kind is replaced.
    """
    mine = regions.where((F.col("kind") == kind) & F.col("name").isin(inputs))
    counts = mine.groupBy(*ENTRY).agg(
        F.count_distinct("name").alias("n"), F.max((F.col("name") == inputs[0]).cast("int")).alias("in_first"), F.max("dim").alias("dim")
    )
    test = {"union": F.lit(True), "intersection": F.col("n") == len(set(inputs)), "difference": (F.col("in_first") == 1) & (F.col("n") == 1)}[operation]
    made = counts.where(test).select("mesh_id", "kind", F.lit(output).alias("name"), "dim", F.lit(tag).cast("bigint").alias("tag"), "entity")
    dropped = [output] if keep_inputs else [output, *inputs]
    return regions.where(~((F.col("kind") == kind) & F.col("name").isin(dropped))).unionByName(made)


def rename(regions: DataFrame, kind: str, old: str, new: str) -> DataFrame:
    return regions.withColumn("name", F.when((F.col("kind") == kind) & (F.col("name") == old), F.lit(new)).otherwise(F.col("name")))


def retag(regions: DataFrame, kind: str, name: str, tag: int) -> DataFrame:
    return regions.withColumn("tag", F.when((F.col("kind") == kind) & (F.col("name") == name), F.lit(tag).cast("bigint")).otherwise(F.col("tag")))


def delete(regions: DataFrame, kind: str, names: list[str]) -> DataFrame:
    return regions.where(~((F.col("kind") == kind) & F.col("name").isin(names)))


def edit_regions(regions: DataFrame, edits: list[dict]) -> DataFrame:
    """Edits one after the other, each {op, kind, ...} as the functions above."""
    for e in edits:
        op = e["op"]
        if op in ("union", "intersection", "difference"):
            regions = combine(regions, op, e["kind"], e["inputs"], e["output"], e.get("tag", 0), e.get("keep_inputs", True))
        elif op == "rename":
            regions = rename(regions, e["kind"], e["old"], e["new"])
        elif op == "retag":
            regions = retag(regions, e["kind"], e["name"], e["tag"])
        elif op == "delete":
            regions = delete(regions, e["kind"], e["names"])
        else:
            raise ValueError(f"no edit {op!r}")
    return regions


def sets_to_data(entities: DataFrame, regions: DataFrame, kind: str, names: list[str], output: str, key: str) -> DataFrame:
    """``output``: the place in ``names`` of the last region that holds the entity, -1 for none."""
    place: Column = F.lit(-1)
    for k, n in enumerate(names):
        place = F.when(F.col("name") == n, F.lit(k)).otherwise(place)
    label = (
        regions.where((F.col("kind") == kind) & F.col("name").isin(names))
        .groupBy("mesh_id", F.col("entity").alias(key))
        .agg(F.max(place).alias(output))
    )
    return entities.join(label, ["mesh_id", key], "left").withColumn(output, F.coalesce(output, F.lit(-1)))


def data_to_sets(entities: DataFrame, kind: str, column: str, key: str, names: dict[int, str] | None = None) -> DataFrame:
    """One region for each distinct value of an integer column, named after the array and the value."""
    name = F.concat(F.lit(f"{column}_"), F.col(column).cast("string"))
    for value, text in (names or {}).items():
        name = F.when(F.col(column) == value, F.lit(text)).otherwise(name)
    return entities.where(F.col(column).isNotNull()).select(
        "mesh_id", F.lit(kind).alias("kind"), name.alias("name"), F.lit(None).cast("int").alias("dim"), F.col(column).cast("bigint").alias("tag"), F.col(key).cast("bigint").alias("entity")
    )


def carried(regions: DataFrame, kind: str, mapping: DataFrame) -> DataFrame:
    """The regions of a kind after renumbering by (mesh_id, old, new); entries without a new number go."""
    moved = regions.where(F.col("kind") == kind).join(mapping.select("mesh_id", F.col("old").alias("entity"), "new"), ["mesh_id", "entity"])
    moved = moved.select("mesh_id", "kind", "name", "dim", "tag", F.col("new").alias("entity"))
    return regions.where(F.col("kind") != kind).select(*moved.columns).unionAll(moved)
