import gzip

import numpy as np
import pytest

from lattica.sources.files import detect, encoded, natural_key, read_mesh, read_metadata, write_tables, read_tables
from lattica.sources.raw import FORMATS, RawMesh, sniff

SURFACE = RawMesh(
    [[0, 0, 0], [1, 0, 0], [1, 1, 0.5], [0, 1, 0]], [("triangle", [0, 1, 2]), ("triangle", [0, 2, 3])]
)
PLANE = RawMesh([[0, 0], [1, 0], [1, 1], [0, 1]], [("triangle", [0, 1, 2]), ("triangle", [0, 2, 3])])
SOLID = RawMesh(
    [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1], [0.5, 0.5, 2]],
    [("hexahedron", list(range(8))), ("pyramid", [4, 5, 6, 7, 8]), ("tetra", [0, 1, 2, 4])],
)
SOLIDS = ["medit", "su2", "gmsh", "vtk", "vtu", "abaqus", "avsucd", "nastran", "ugrid", "mesh-json", "lsdyna", "mfem", "xdmf"]
SURFACES = ["tecplot", "unv", "off", "obj", "stl", "ply", "wkt", "dolfin-xml", *SOLIDS]


def same(a: RawMesh, b: RawMesh) -> None:
    """Equal cells by type and coordinates, whatever their order and numbering."""
    key = lambda m: sorted((t, tuple(map(tuple, np.round(m.points[n], 5).tolist()))) for t, n in m.cells)
    assert key(a) == key(b)


@pytest.mark.parametrize("name", SURFACES)
def test_surface_round_trip(name):
    f = FORMATS[name]
    same(SURFACE, f.read(f.write(SURFACE)))


@pytest.mark.parametrize("name", SOLIDS)
def test_solid_round_trip(name):
    f = FORMATS[name]
    same(SOLID, f.read(f.write(SOLID)))


@pytest.mark.parametrize("name", ["freefem"])
def test_plane_round_trip(name):
    f = FORMATS[name]
    same(PLANE, f.read(f.write(PLANE)))


@pytest.mark.parametrize("name", ["xyz", "pcd"])
def test_cloud_round_trip(name):
    f = FORMATS[name]
    assert np.allclose(f.read(f.write(SURFACE)).points, SURFACE.points)


@pytest.mark.parametrize("name", ["gmsh", "vtk", "vtu", "abaqus"])
def test_quadratic_cells(name):
    rng = np.random.default_rng(1)
    cells, at = [], 0
    for kind, n in (("tetra10", 10), ("wedge15", 15), ("hexahedron20", 20), ("quad8", 8), ("triangle6", 6)):
        cells.append((kind, list(range(at, at + n))))
        at += n
    mesh = RawMesh(rng.random((at, 3)), cells)
    same(mesh, FORMATS[name].read(FORMATS[name].write(mesh)))


def test_middle_nodes_stand_on_their_edges():
    """A tetrahedron as another program writes it: its last two middle nodes are swapped."""
    corners = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    theirs = [(0, 1), (1, 2), (2, 0), (3, 0), (2, 3), (3, 1)]
    points = [*corners, *((corners[a] + corners[b]) / 2 for a, b in theirs)]
    text = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n10\n" + "".join(f"{i + 1} {p[0]} {p[1]} {p[2]}\n" for i, p in enumerate(points))
    got = FORMATS["gmsh"].read((text + "$EndNodes\n$Elements\n1\n1 11 2 0 0 " + " ".join(map(str, range(1, 11))) + "\n$EndElements\n").encode())
    from lattica.celltypes import EDGES

    nodes = got.cells[0][1]
    for k, (a, b) in enumerate(EDGES["tetra"]):
        assert np.allclose(got.points[nodes[4 + k]], (got.points[nodes[a]] + got.points[nodes[b]]) / 2)


def test_wedges_in_decks():
    mesh = RawMesh([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [0, 1, 1]], [("wedge", list(range(6)))])
    for name in ("lsdyna", "unv", "xdmf", "mfem", "nastran", "abaqus"):
        same(mesh, FORMATS[name].read(FORMATS[name].write(mesh)))


@pytest.mark.parametrize("name", ["vtk", "vtu", "mesh-json", "avsucd", "xdmf"])
def test_data_round_trip(name):
    mesh = RawMesh(SURFACE.points, SURFACE.cells, {"u": np.arange(4.0).reshape(-1, 1), "v": np.arange(12.0).reshape(4, 3)})
    got = FORMATS[name].read(FORMATS[name].write(mesh))
    assert np.allclose(got.point_data["u"], mesh.point_data["u"]) and np.allclose(got.point_data["v"], mesh.point_data["v"])


def test_faces_only_formats_refuse_solids():
    with pytest.raises(ValueError):
        FORMATS["off"].write(SOLID)


def test_sniff_and_detect():
    assert sniff(b"  OFF\n1 0 0") == ["off"]
    assert sniff(b"nothing known") == []
    assert detect("a.msh", b"$MeshFormat\n2.2 0 8") == "gmsh"
    assert detect("a.msh", b"4 2 4\n") in ("freefem", "gmsh")
    with pytest.raises(ValueError):
        detect("a.unknown", b"nothing known")


def test_regions_and_negative_indices():
    got = FORMATS["obj"].read(b"v 0 0 0\nv 1 0 0\nv 0 1 0\ng top\nf -3 -2 -1\n")
    assert got.cells == [("triangle", [0, 1, 2])] and got.regions == [("cell", "top", 0, [0])]
    deck = b"*NODE\n1,0,0,0\n2,1,0,0\n3,0,1,0\n*ELEMENT, TYPE=S3, ELSET=skin\n7,1,2,3\n*NSET, NSET=a, GENERATE\n1,3,2\n"
    assert FORMATS["abaqus"].read(deck).regions == [("cell", "skin", 0, [0]), ("point", "a", 0, [0, 2])]


def test_read_write_in_spark(spark, tmp_path):
    (tmp_path / "a.off").write_bytes(FORMATS["off"].write(SURFACE))
    (tmp_path / "b.vtk.gz").write_bytes(gzip.compress(FORMATS["vtk"].write(SOLID)))
    mesh = read_mesh(spark, [str(tmp_path / "a.off"), str(tmp_path / "b.vtk.gz")])
    assert mesh.points.count() == 13 and mesh.cells.count() == 5
    assert "data" not in read_mesh(spark, str(tmp_path / "a.off"), points_only=True).points.columns
    meta = {r["format"]: r["num_cells"] for r in read_metadata(spark, str(tmp_path)).collect()}
    assert meta == {"off": 2, "vtk": 3}
    back = {r["mesh_id"]: r["content"] for r in encoded(mesh.with_(points=mesh.points.drop("data"), cells=mesh.cells.drop("data")), "vtk").collect()}
    same(SOLID, FORMATS["vtk"].read(bytes(next(v for k, v in back.items() if "b.vtk" in k))))
    write_tables(mesh, str(tmp_path / "tables"))
    assert read_tables(spark, str(tmp_path / "tables")).cells.count() == 5


def test_natural_order(spark):
    df = spark.createDataFrame([("out_10.vtk",), ("out_2.vtk",)], "path string")
    assert [r[0] for r in df.orderBy(natural_key()).collect()] == ["out_2.vtk", "out_10.vtk"]
