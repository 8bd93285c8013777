"""One query for each format: the terrain as the bytes of a file, read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources.files import decoded_rows, encoded, mesh_of
from .catalog import query
from .terrain import LAND, terrain

#: Formats that hold triangles in space.
WITH_TRIANGLES = (
    "off", "obj", "stl", "ply", "medit", "gmsh", "vtk", "vtk-binary", "vtu", "vtu-appended", "vtp", "abaqus", "avsucd", "nastran", "ugrid", "mesh-json", "lsdyna", "tecplot", "unv", "xdmf",
    "netgen", "flac3d", "mdpa", "frd", "patran", "ansysInp", "radioss", "gid", "permas", "gltf", "3mf", "dxf", "wkt",
)


def _add(name: str) -> None:
    def run(spark, d):
        mesh = terrain(spark, d)
        bare = mesh.with_(points=mesh.points.drop("u", "w"))
        files = encoded(bare, name)
        back = mesh_of(decoded_rows(files.select("mesh_id", "content"), name), points_only=True)
        return G.centroids(back).select(*[F.round(c, 3).alias(c) for c in ("cx", "cy", "cz")])

    run.__name__ = "format_" + name.replace("-", "_")
    run.__doc__ = f"Middles of the terrain's triangles through {name}."
    query(LAND + "SELECT round((ax + bx + cx) / 3, 3) AS cx, round((ay + by_ + cy) / 3, 3) AS cy, round((az + bz + cz) / 3, 3) AS cz FROM tc")(run)


for _name in WITH_TRIANGLES:
    _add(_name)
