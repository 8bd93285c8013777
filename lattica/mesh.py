"""The mesh as a set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT_KEYS = ["mesh_id", "point_id"]
CELL_KEYS = ["mesh_id", "cell_id"]
POINT_COLUMNS = ["mesh_id", "point_id", "x", "y", "z"]
CELL_COLUMNS = ["mesh_id", "cell_id", "cell_type", "nodes"]
REGION_SCHEMA = "mesh_id string, kind string, name string, dim int, tag bigint, entity bigint"


@dataclass(frozen=True)
class MeshFrame:
    """Any number of meshes, by ``mesh_id``.

    points (mesh_id, point_id, x, y, z, then one column for each array of point
    data), cells (mesh_id, cell_id, cell_type, nodes, then cell data) and
    regions, one row for each entry: (mesh_id, kind, name, dim, tag, entity).
    """

    points: DataFrame
    cells: DataFrame
    regions: DataFrame | None = None
    #: The incidence where a table already has it: it stands in for the exploded nodes until the cells change.
    links: DataFrame | None = None

    def with_(self, **parts: DataFrame) -> MeshFrame:
        if "cells" in parts:
            parts = {"links": None} | parts
        return replace(self, **parts)

    def incidence(self) -> DataFrame:
        """mesh_id, cell_id, local and point_id of every node of every cell."""
        if self.links is not None:
            return self.links
        return self.cells.select(*CELL_KEYS, F.posexplode("nodes").alias("local", "point_id"))

    def with_corners(self, extra: list[str] | None = None) -> DataFrame:
        """The cells with ``corners``, an array of structs (local, x, y, z and ``extra`` point columns) in node order."""
        columns = ["x", "y", "z", *(extra or [])]
        placed = (
            self.incidence()
            .join(self.points.select(*POINT_KEYS, *columns), POINT_KEYS)
            .groupBy(*CELL_KEYS)
            .agg(F.array_sort(F.collect_list(F.struct("local", *columns))).alias("corners"))
        )
        return self.cells.join(placed, CELL_KEYS, "left")

    def point_arrays(self) -> list[str]:
        return [c for c in self.points.columns if c not in POINT_COLUMNS]

    def cell_arrays(self) -> list[str]:
        return [c for c in self.cells.columns if c not in CELL_COLUMNS]
