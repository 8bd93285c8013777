"""Mesh files as DataFrames, and back: a file for each task, read through Spark's own file systems."""

from __future__ import annotations

import bz2
import gzip
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import MeshFrame
from . import binary_formats, deck_formats, more_formats, text_formats, vtk_formats  # noqa: F401  (they register their formats)
from .raw import FORMATS, RawMesh, detect

ROW = "mesh_id string, kind string, id bigint, x double, y double, z double, cell_type string, nodes array<bigint>, name string, tag bigint, data map<string, array<double>>"
_SCHEMA = pa.schema(
    [("mesh_id", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("cell_type", pa.string()), ("nodes", pa.list_(pa.int64())), ("name", pa.string()), ("tag", pa.int64()), ("data", pa.map_(pa.string(), pa.list_(pa.float64())))]
)
#: Rows of a batch that a reader hands on.
CHUNK = 20_000


def unpacked(path: str, content: bytes) -> bytes:
    if path.lower().endswith(".gz"):
        return gzip.decompress(content)
    return bz2.decompress(content) if path.lower().endswith(".bz2") else content


def parsed(path: str, content: bytes, format_: str | None = None) -> RawMesh:
    content = unpacked(path, content)
    name = format_ or detect(path, content[:200])
    read = FORMATS[name].read
    if read is None:
        raise ValueError(f"{name} files are not read")
    return read(content)


def rows_of(mesh_id: str, raw: RawMesh, arrays: list[str] | None) -> Iterator[pa.RecordBatch]:
    """The mesh as typed rows; ``arrays`` picks data by name, none with an empty list."""
    wanted = lambda d: {k: v for k, v in d.items() if arrays is None or k in arrays}
    pd, cd = wanted(raw.point_data), wanted(raw.cell_data)

    def batch(kind: str, ids: range | list[int], **columns) -> pa.RecordBatch:
        n = len(ids)
        filled = {"mesh_id": [mesh_id] * n, "kind": [kind] * n, "id": list(ids)} | columns
        return pa.RecordBatch.from_arrays([pa.array(filled.get(f.name, [None] * n), f.type) for f in _SCHEMA], schema=_SCHEMA)

    for lo in range(0, len(raw.points), CHUNK):
        ids = range(lo, min(lo + CHUNK, len(raw.points)))
        p = raw.points[ids.start : ids.stop]
        yield batch("point", ids, x=p[:, 0], y=p[:, 1], z=p[:, 2], data=[[(k, v[i].tolist()) for k, v in pd.items()] for i in ids])
    for lo in range(0, len(raw.cells), CHUNK):
        ids = range(lo, min(lo + CHUNK, len(raw.cells)))
        part = raw.cells[ids.start : ids.stop]
        yield batch("cell", ids, cell_type=[t for t, _ in part], nodes=[n for _, n in part], data=[[(k, v[i].tolist()) for k, v in cd.items()] for i in ids])
    for kind, name, tag, entries in raw.regions:
        yield batch(f"region:{kind}", list(entries), name=[name] * len(entries), tag=[tag] * len(entries))


def decoded_rows(files: DataFrame, format_: str | None = None, arrays: list[str] | None = None) -> DataFrame:
    """Typed rows of the meshes in ``files`` (path or mesh_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from rows_of(path, parsed(path, content.as_py(), format_), arrays)

    return files.mapInArrow(run, ROW)


def read_rows(spark: SparkSession, paths: str | list[str], format_: str | None = None, arrays: list[str] | None = None) -> DataFrame:
    return decoded_rows(spark.read.format("binaryFile").load(paths).select("path", "content"), format_, arrays)


def read_mesh(spark: SparkSession, paths: str | list[str], format_: str | None = None, arrays: list[str] | None = None, points_only: bool = False) -> MeshFrame:
    """Every file as one mesh, ``mesh_id`` its path; data come as the map column ``data``."""
    return mesh_of(read_rows(spark, paths, format_, arrays), points_only)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, place, time and name of the files that a PVD, PVTU or VTM index names, relative ones beside the index."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                folder = own.rsplit("/", 1)[0]
                for k, (ref, time, name) in enumerate(vtk_formats.piece_references(content.as_py())):
                    rows.append((ref if ref.startswith("/") or "://" in ref else f"{folder}/{ref}", k, time, name))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "place", "time", "name"])

    return files.mapInArrow(run, "path string, place bigint, time double, name string")


def read_indexed(spark: SparkSession, path: str, arrays: list[str] | None = None) -> MeshFrame:
    """The files that an index names, each a mesh; the index has a row for each file, so its paths are collected."""
    return read_mesh(spark, [r["path"] for r in read_index(spark, path).orderBy("place").collect()], None, arrays)


def mesh_of(rows: DataFrame, points_only: bool = False) -> MeshFrame:
    """Typed rows as a mesh."""
    points = rows.where("kind = 'point'").select("mesh_id", F.col("id").alias("point_id"), "x", "y", "z", *([] if points_only else ["data"]))
    cells = rows.where("kind = 'cell'").select("mesh_id", F.col("id").alias("cell_id"), "cell_type", "nodes", *([] if points_only else ["data"]))
    regions = rows.where("kind like 'region:%'").select(
        "mesh_id", F.substring_index("kind", ":", -1).alias("kind"), "name", F.lit(None).cast("int").alias("dim"), "tag", F.col("id").alias("entity")
    )
    return MeshFrame(points, cells, regions)


def data_columns(df: DataFrame, components: dict[str, int]) -> DataFrame:
    """The named arrays out of the map: one column for a scalar, name_0, name_1 ... for more."""
    for name, k in components.items():
        for i in range(k):
            df = df.withColumn(name if k == 1 else f"{name}_{i}", F.col("data").getItem(name).getItem(i))
    return df.drop("data")


def read_metadata(spark: SparkSession, paths: str | list[str], format_: str | None = None) -> DataFrame:
    """One row for each file: format, counts, box and array names; no payload leaves the task."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "mesh_id string, format string, num_points bigint, num_cells bigint, lo array<double>, hi array<double>, point_arrays array<string>, cell_arrays array<string>"

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = unpacked(path, content.as_py())
                name = format_ or detect(path, data[:200])
                raw = FORMATS[name].read(data)
                box = (raw.points.min(0).tolist(), raw.points.max(0).tolist()) if len(raw.points) else ([], [])
                rows.append({"mesh_id": path, "format": name, "num_points": len(raw.points), "num_cells": len(raw.cells), "lo": box[0], "hi": box[1], "point_arrays": sorted(raw.point_data), "cell_arrays": sorted(raw.cell_data)})
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string())]
            names = ["mesh_id", "format", "num_points", "num_cells", "lo", "hi", "point_arrays", "cell_arrays"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.mapInArrow(run, schema)


def encoded(mesh: MeshFrame, format_: str) -> DataFrame:
    """mesh_id and content: the bytes of each mesh in a format, one mesh to a group."""
    write = FORMATS[format_].write
    if write is None:
        raise ValueError(f"{format_} files are not written")
    key = F.col("mesh_id")
    arrays = mesh.point_arrays(), mesh.cell_arrays()

    def packed(df: DataFrame, kind: str, order: str, names: list[str], fields: list[str]) -> DataFrame:
        data = F.create_map(*[x for n in names for x in (F.lit(n), F.array(F.col(n).cast("double")))]) if names else F.create_map().cast("map<string,array<double>>")
        cols = {c: F.col(c) if c in fields else F.lit(None) for c in ("x", "y", "z", "cell_type", "nodes")}
        return df.select(key.alias("mesh_id"), F.lit(kind).alias("kind"), F.col(order).alias("id"), *[cols[c].cast(t).alias(c) for c, t in (("x", "double"), ("y", "double"), ("z", "double"), ("cell_type", "string"), ("nodes", "array<bigint>"))], F.to_json(data).alias("data"))

    both = packed(mesh.points, "point", "point_id", arrays[0], ["x", "y", "z"]).unionByName(packed(mesh.cells, "cell", "cell_id", arrays[1], ["cell_type", "nodes"]))

    def one(pdf):
        import pandas as pd

        p = pdf[pdf.kind == "point"].sort_values("id")
        c = pdf[pdf.kind == "cell"].sort_values("id")
        place = {v: k for k, v in enumerate(p.id)}
        read = lambda part, names: {n: np.array([json.loads(d)[n] for d in part.data], float).reshape(len(part), -1) for n in names}
        raw = RawMesh(p[["x", "y", "z"]].to_numpy(), [(t, [place[i] for i in n]) for t, n in zip(c.cell_type, c.nodes, strict=True)], read(p, arrays[0]), read(c, arrays[1]))
        return pd.DataFrame({"mesh_id": [pdf.mesh_id.iloc[0]], "content": [write(raw)]})

    return both.groupBy("mesh_id").applyInPandas(one, "mesh_id string, content binary")


def write_tables(mesh: MeshFrame, path: str, mode: str = "errorifexists") -> None:
    """The mesh as Parquet tables, a folder for each mesh_id; regions too where there are any."""
    for name, df in (("points", mesh.points), ("cells", mesh.cells), ("regions", mesh.regions)):
        if df is not None:
            df.write.mode(mode).partitionBy("mesh_id").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, regions: bool = False) -> MeshFrame:
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return MeshFrame(read("points"), read("cells"), read("regions") if regions else None)


#: Dialects of graph files by extension.
GRAPHS = {".graph": "metis", ".metis": "metis", ".grf": "scotch"}


def graph_format_for_path(path: str) -> str:
    """The dialect that a path's extension names."""
    for extension, name in GRAPHS.items():
        if path.lower().endswith(extension):
            return name
    raise ValueError(f"{path}: graph files end in {', '.join(GRAPHS)}")


def graph_lines(graph: DataFrame, vertices: int, dialect: str = "metis") -> DataFrame:
    """line (from 0) and value: an undirected graph (src, dst both ways, ids from 0) as the lines of a graph file.

    METIS begins with the numbers of vertices and edges and has the neighbours
    of each vertex, from 1. Scotch begins with a version, vertices and arcs, then
    the base and flags, and has each vertex's degree before its neighbours, from 0.
    """
    if dialect not in ("metis", "scotch"):
        raise ValueError(f"{dialect!r} is neither metis nor scotch")
    base = 1 if dialect == "metis" else 0
    spark = graph.sparkSession
    near = graph.groupBy("src").agg(F.array_sort(F.collect_list(F.col("dst") + base)).alias("near"))
    rows = spark.range(vertices).join(near, F.col("id") == F.col("src"), "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    neighbours = F.concat_ws(" ", F.col("near").cast("array<string>"))
    body = neighbours if base else F.concat_ws(" ", F.size("near").cast("string"), F.when(F.size("near") > 0, neighbours))
    arcs = graph.agg(F.count(F.lit(1)).alias("n"))
    if base:
        head = arcs.select(F.lit(0).cast("bigint").alias("line"), F.concat(F.lit(f"{vertices} "), (F.col("n") / 2).cast("bigint").cast("string")).alias("value"))
    else:
        first = F.concat(F.lit(f"{vertices} "), F.col("n").cast("string"))
        head = arcs.select(F.posexplode(F.array(F.lit("0"), first, F.lit("0 000"))).alias("line", "value"))
    return head.unionByName(rows.select((F.col("id") + (1 if base else 3)).alias("line"), body.alias("value")))


def write_graph(graph: DataFrame, vertices: int, path: str, dialect: str | None = None) -> None:
    """``graph_lines`` as text in the order of the lines; the part files of the folder ``path``, one after the other, are the graph file."""
    lines = graph_lines(graph, vertices, dialect or graph_format_for_path(path))
    lines.repartitionByRange("line").sortWithinPartitions("line").select("value").write.text(path)


def natural_key(column: str = "path"):
    """A sort key in which out_2 comes before out_10: digits padded to 12 places."""
    parts = F.regexp_extract_all(column, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")
