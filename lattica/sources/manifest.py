"""Manifests: a catalogue of mesh files with splits, tags and groups, as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, source string, split string, tags array<string>, `group` string"


def parse_manifest(text: str) -> list[tuple]:
    """Entries of a JSON manifest {Version: 1, Entries: [{Id, Source, Split, Tags, Group}]}; identifiers are unique."""
    d = json.loads(text)
    if d.get("Version") != 1 or not isinstance(d.get("Entries"), list):
        raise ValueError("a manifest needs Version 1 and Entries")
    out = []
    for k, e in enumerate(d["Entries"]):
        if not e.get("Id") or not e.get("Source"):
            raise ValueError(f"entry {k} needs Id and Source")
        out.append((e["Id"], e["Source"], e.get("Split"), list(e.get("Tags", [])), e.get("Group")))
    if len({e[0] for e in out}) < len(out):
        raise ValueError("identifiers are repeated")
    return out


def manifest(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_manifest(text), SCHEMA)


def chosen(entries: DataFrame, split: str | None = None, tags: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Entries of a split and group that have all the tags."""
    if split is not None:
        entries = entries.where(F.col("split") == split)
    if group is not None:
        entries = entries.where(F.col("group") == group)
    for t in tags or []:
        entries = entries.where(F.array_contains("tags", t))
    return entries


def with_splits(entries: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Splits by a hash of the group (of the id where there is none), so that a group is never torn."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("group", "id")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    out, end = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        end = sum(v for k, v in shares.items() if list(shares).index(k) <= list(shares).index(name))
        out = F.when(h < end, F.lit(name)).otherwise(out)
    return entries.withColumn("split", out)
