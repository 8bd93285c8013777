"""Formats against bytes written by hand or by struct, and round trips of every writer."""

import base64
import json
import struct
import zipfile
import zlib
from io import BytesIO

import numpy as np
import pytest

from lattica.sources import files  # noqa: F401  registers the formats
from lattica.sources.raw import FORMATS, RawMesh, detect
from lattica.sources.vtk_formats import piece_references

SQUARE = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]], float)
HEX = ("hexahedron", [0, 1, 2, 3, 4, 5, 6, 7])


def read(name, data):
    return FORMATS[name].read(data)


def mesh(*cells, **data):
    return RawMesh(SQUARE + 0.25, list(cells), **data)


CELLS = {
    "netgen": [("tetra", [0, 1, 2, 4]), ("hexahedron", HEX[1]), ("triangle", [0, 1, 2]), ("quad", [0, 1, 2, 3])],
    "flac3d": [HEX, ("tetra", [0, 1, 2, 4]), ("wedge", [0, 1, 2, 4, 5, 6]), ("pyramid", [0, 1, 2, 3, 6]), ("quad", [0, 1, 2, 3])],
    "mdpa": [("triangle", [0, 1, 2]), ("quad", [0, 1, 2, 3]), ("tetra", [0, 1, 2, 4]), HEX, ("line", [0, 1])],
    "z88": [HEX, ("tetra", [0, 1, 2, 4]), ("line", [0, 1])],
    "frd": [HEX, ("tetra", [0, 1, 2, 4]), ("wedge", [0, 1, 2, 4, 5, 6]), ("triangle", [0, 1, 2])],
    "patran": [HEX, ("tetra", [0, 1, 2, 4]), ("quad", [0, 1, 2, 3]), ("line", [0, 1])],
    "ansysInp": [HEX, ("tetra", [0, 1, 2, 4]), ("wedge", [0, 1, 2, 4, 5, 6]), ("pyramid", [0, 1, 2, 3, 6]), ("quad", [0, 1, 2, 3])],
    "radioss": [HEX, ("tetra", [0, 1, 2, 4]), ("quad", [0, 1, 2, 3]), ("triangle", [0, 1, 2])],
    "gid": [HEX, ("tetra", [0, 1, 2, 4]), ("quad", [0, 1, 2, 3])],
    "permas": [HEX, ("tetra", [0, 1, 2, 4]), ("triangle", [0, 1, 2])],
    "vtk-binary": [HEX, ("tetra", [0, 1, 2, 4]), ("line", [0, 1])],
    "vtu-appended": [HEX, ("tetra", [0, 1, 2, 4]), ("line", [0, 1])],
    "vtp": [("vertex", [3]), ("line", [0, 1]), ("triangle", [0, 1, 2]), ("quad", [0, 1, 2, 3])],
    "gltf": [("triangle", [0, 1, 2]), ("triangle", [4, 5, 7])],
    "3mf": [("triangle", [0, 1, 2]), ("triangle", [4, 5, 7])],
}


@pytest.mark.parametrize("name", sorted(CELLS))
def test_round_trip(name):
    want = mesh(*CELLS[name])
    got = read(name, FORMATS[name].write(want))
    assert np.allclose(got.points, want.points, atol=1e-5)
    assert got.cells == want.cells


@pytest.mark.parametrize("name", ["vtk-binary", "vtu-appended", "vtp"])
def test_arrays_come_back(name):
    cells = [("triangle", [0, 1, 2]), ("triangle", [4, 5, 7])]
    want = mesh(*cells, point_data={"u": np.arange(8.0).reshape(-1, 1), "v": np.arange(24.0).reshape(-1, 3)}, cell_data={"m": np.array([[3.0], [4.0]])})
    got = read(name, FORMATS[name].write(want))
    assert np.array_equal(got.point_data["u"], want.point_data["u"]) and np.array_equal(got.point_data["v"], want.point_data["v"])
    assert got.cell_data["m"].ravel().tolist() == [3, 4]


def test_legacy_binary_by_hand():
    head = b"# vtk DataFile Version 3.0\nby hand\nBINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS 4 float\n"
    body = struct.pack(">12f", 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1)
    body += b"\nCELLS 2 9\n" + struct.pack(">9i", 4, 0, 1, 2, 3, 3, 0, 1, 2) + b"\nCELL_TYPES 2\n" + struct.pack(">2i", 10, 5)
    body += b"\nPOINT_DATA 4\nSCALARS t double 1\nLOOKUP_TABLE default\n" + struct.pack(">4d", 1, 2, 3, 10)
    body += b"\nCELL_DATA 2\nVECTORS w float\n" + struct.pack(">6f", 1, 2, 3, 4, 5, 6) + b"\n"
    got = read("vtk", head + body)
    assert got.cells == [("tetra", [0, 1, 2, 3]), ("triangle", [0, 1, 2])] and got.points[3].tolist() == [0, 0, 1]
    assert got.point_data["t"].ravel().tolist() == [1, 2, 3, 10] and got.cell_data["w"].tolist() == [[1, 2, 3], [4, 5, 6]]


def test_legacy_lattices():
    text = "# vtk DataFile Version 3.0\nx\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 3 2 1\nORIGIN 1 2 3\nSPACING 0.5 2 1\nPOINT_DATA 6\nSCALARS u float\nLOOKUP_TABLE default\n0 1 2\n3 4 5\n"
    got = read("vtk", text.encode())
    assert got.points[4].tolist() == [1.5, 4, 3] and got.cells == [("quad", [0, 1, 4, 3]), ("quad", [1, 2, 5, 4])] and got.point_data["u"][4, 0] == 4
    text = "# vtk DataFile Version 3.0\nx\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS 2 2 2\nX_COORDINATES 2 float\n0 1\nY_COORDINATES 2 float\n0 3\nZ_COORDINATES 2 float\n5 7\n"
    got = read("vtk", text.encode())
    assert got.cells == [("hexahedron", [0, 1, 3, 2, 4, 5, 7, 6])] and got.points[7].tolist() == [1, 3, 7]


def appended(encoding, packed):
    """A triangle with its arrays behind the XML."""
    arrays = [struct.pack("<9d", 0, 0, 0, 1, 0, 0, 0, 1, 0), struct.pack("<3q", 0, 1, 2), struct.pack("<q", 3), struct.pack("<B", 5)]
    body, at = b"", []
    for a in arrays:
        at.append(len(body))
        if packed:
            z = zlib.compress(a)
            head = struct.pack("<4I", 1, len(a), 0, len(z))
            body += base64.b64encode(head) + base64.b64encode(z) if encoding == "base64" else head + z
        else:
            part = struct.pack("<I", len(a)) + a
            body += base64.b64encode(part) if encoding == "base64" else part
    comp = ' compressor="vtkZLibDataCompressor"' if packed else ""
    xml = f'''<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian"{comp}><UnstructuredGrid><Piece NumberOfPoints="3" NumberOfCells="1">
<Points><DataArray type="Float64" NumberOfComponents="3" format="appended" offset="{at[0]}"/></Points>
<Cells><DataArray type="Int64" Name="connectivity" format="appended" offset="{at[1]}"/><DataArray type="Int64" Name="offsets" format="appended" offset="{at[2]}"/><DataArray type="UInt8" Name="types" format="appended" offset="{at[3]}"/></Cells>
</Piece></UnstructuredGrid><AppendedData encoding="{encoding}">_'''
    return xml.encode() + body + b"</AppendedData></VTKFile>"


@pytest.mark.parametrize("encoding", ["raw", "base64"])
@pytest.mark.parametrize("packed", [False, True])
def test_appended_arrays(encoding, packed):
    got = read("vtu", appended(encoding, packed))
    assert got.cells == [("triangle", [0, 1, 2])] and got.points[1].tolist() == [1, 0, 0]


def test_xml_lattices():
    vti = '<VTKFile type="ImageData" byte_order="LittleEndian"><ImageData WholeExtent="0 2 0 1 0 0" Origin="1 0 0" Spacing="2 3 1"><Piece Extent="0 2 0 1 0 0"><PointData><DataArray type="Float32" Name="u" format="ascii">0 1 2 3 4 5</DataArray></PointData></Piece></ImageData></VTKFile>'
    got = read("vti", vti.encode())
    assert got.points[5].tolist() == [5, 3, 0] and got.cells[1] == ("quad", [1, 2, 5, 4]) and got.point_data["u"][5, 0] == 5
    axis = lambda v: f'<DataArray type="Float64" format="ascii">{v}</DataArray>'
    vtr = f'<VTKFile type="RectilinearGrid"><RectilinearGrid WholeExtent="0 1 0 1 0 1"><Piece Extent="0 1 0 1 0 1"><Coordinates>{axis("0 2")}{axis("0 3")}{axis("0 5")}</Coordinates></Piece></RectilinearGrid></VTKFile>'
    got = read("vtr", vtr.encode())
    assert got.points[6].tolist() == [0, 3, 5] and got.cells == [("hexahedron", [0, 1, 3, 2, 4, 5, 7, 6])]
    vts = '<VTKFile type="StructuredGrid"><StructuredGrid WholeExtent="0 1 0 1 0 0"><Piece Extent="0 1 0 1 0 0"><Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">0 0 0 1 0 0 0 1 9 1 1 9</DataArray></Points></Piece></StructuredGrid></VTKFile>'
    got = read("vts", vts.encode())
    assert got.cells == [("quad", [0, 1, 3, 2])] and got.points[3].tolist() == [1, 1, 9]


def test_indexes_name_their_files():
    pvd = b'<VTKFile type="Collection"><Collection><DataSet timestep="0.5" part="0" file="a_0.vtu"/><DataSet timestep="1" file="a_1.vtu"/></Collection></VTKFile>'
    assert piece_references(pvd) == [("a_0.vtu", 0.5, "0"), ("a_1.vtu", 1.0, None)]
    assert piece_references(b'<VTKFile type="PUnstructuredGrid"><PUnstructuredGrid><Piece Source="p0.vtu"/><Piece Source="p1.vtu"/></PUnstructuredGrid></VTKFile>') == [("p0.vtu", None, None), ("p1.vtu", None, None)]


def test_decks_by_hand():
    netgen = b"mesh3d\ndimension\n3\ngeomtype\n0\nsurfaceelements\n1\n2 1 1 0 3 1 2 3\nvolumeelements\n1\n7 4 1 3 2 4\npoints\n4\n0 0 0\n1 0 0\n0 1 0\n0 0 1\nendmesh\n"
    got = read("netgen", netgen)
    assert got.cells == [("tetra", [0, 1, 2, 3]), ("triangle", [0, 1, 2])] and got.regions == [("cell", "volume_7", 1, [0])]
    flac = b"* zones\nG 1 0 0 0\nG 2 1 0 0\nG 3 0 1 0\nG 5 0 0 1\nZ T4 9 1 2 3 5\nZGROUP \"rock\"\n 9\n"
    got = read("flac3d", flac)
    assert got.cells == [("tetra", [0, 1, 2, 3])] and got.regions == [("cell", "rock", 1, [0])]
    mdpa = b"Begin Nodes\n 1 0 0 0\n 2 1 0 0 // two\n 3 0 1 0\nEnd Nodes\nBegin Elements SmallDisplacementElement2D3N\n 5 0 1 2 3\nEnd Elements\n"
    assert read("mdpa", mdpa).cells == [("triangle", [0, 1, 2])]
    radioss = b"#RADIOSS STARTER\n/NODE\n# id x y z\n 10 0 0 0\n 11 1 0 0\n 12 1 1 0\n 13 0 1 0\n/SHELL/4\n 1 10 11 12 13\n/END\n"
    got = read("radioss", radioss)
    assert got.cells == [("quad", [0, 1, 2, 3])] and got.regions[0][1] == "part_4"
    cdb = b"/PREP7\nNBLOCK,6,SOLID,8,8\n(3i9,6e21.13e3)\n" + b"".join(b"%9d%9d%9d%21.13E%21.13E%21.13E\n" % (k + 1, 0, 0, *p) for k, p in enumerate(SQUARE.tolist())) + b"N,R5.3,LOC,       -1,\nEBLOCK,19,SOLID,1,1\n(19i9)\n" + b"".join(b"%9d" % v for v in (1, 1, 1, 1, 0, 0, 0, 0, 8, 0, 77, 1, 2, 3, 3, 5, 5, 5, 5)) + b"\n       -1\nCMBLOCK,TIP,ELEM,1\n(8i10)\n        77\nCMBLOCK,BASE,NODE,2\n(8i10)\n         1        -3\n"
    got = read("ansysInp", cdb)
    assert got.cells == [("tetra", [0, 1, 2, 4])] and got.regions == [("cell", "TIP", 1, [0]), ("point", "BASE", 2, [0, 1, 2])]
    frd = "    1C\n    2C                             3                                     1\n" + "".join(f" -1{k:10d}{x:12.5E}{y:12.5E}{z:12.5E}\n" for k, (x, y, z) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0)], 1))
    frd += " -3\n    3C                             1                                     1\n -1         1    7    0    1\n -2         1         2         3\n -3\n"
    frd += "    1PSTEP 1 1 1\n  100CL  101\n -4  DISP        4    1\n -5  D1          1    2    1    0\n" + "".join(f" -1{k:10d}{k:12.5E}{0:12.5E}{-k:12.5E}\n" for k in (1, 2, 3)) + " -3\n 9999\n"
    got = read("frd", frd.encode())
    assert got.cells == [("triangle", [0, 1, 2])] and got.point_data["DISP"].tolist() == [[1, 0, -1], [2, 0, -2], [3, 0, -3]]
    dxf = "0\nSECTION\n2\nENTITIES\n0\n3DFACE\n8\nwall\n10\n0\n20\n0\n30\n0\n11\n1\n21\n0\n31\n0\n12\n1\n22\n1\n32\n0\n13\n1\n23\n1\n33\n0\n0\nLINE\n8\nedge\n10\n0\n20\n0\n30\n0\n11\n1\n21\n1\n31\n0\n0\nENDSEC\n0\nEOF\n"
    got = read("dxf", dxf.encode())
    assert got.cells == [("triangle", [0, 1, 2]), ("line", [0, 2])] and [r[1] for r in got.regions] == ["wall", "edge"]


def test_viewers_by_hand():
    body = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<3H", 0, 1, 2)
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"translation": [0, 0, 5], "scale": [2, 2, 2], "mesh": 0}], "meshes": [{"name": "leaf", "primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
           "buffers": [{"byteLength": 42, "uri": "data:application/octet-stream;base64," + base64.b64encode(body).decode()}], "bufferViews": [{"buffer": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
           "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}]}
    got = read("gltf", json.dumps(doc).encode())
    assert got.points[1].tolist() == [2, 0, 5] and got.cells == [("triangle", [0, 1, 2])] and got.regions[0][1] == "leaf"
    model = '<model xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources><object id="3" name="part"><mesh><vertices><vertex x="0" y="0" z="0"/><vertex x="1" y="0" z="0"/><vertex x="0" y="1" z="0"/></vertices><triangles><triangle v1="0" v2="1" v3="2"/></triangles></mesh></object></resources><build><item objectid="3" transform="1 0 0 0 1 0 0 0 1 10 20 30"/></build></model>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("3D/3dmodel.model", model)
    got = read("3mf", out.getvalue())
    assert got.points[1].tolist() == [11, 20, 30] and got.regions == [("cell", "part", 1, [0])]


def test_drawings():
    flat = RawMesh(SQUARE[:4], [("triangle", [0, 1, 2]), ("line", [0, 3])])
    svg = FORMATS["svg"].write(flat).decode()
    assert svg.count("<path") == 2 and 'viewBox="0.0 0.0 1.0 1.0"' in svg and "M 0.0 1.0 L 1.0 1.0 L 1.0 0.0 Z" in svg
    assert "\\draw (0.0, 0.0) -- (1.0, 0.0) -- (1.0, 1.0) -- cycle;" in FORMATS["tikz"].write(flat).decode()


def test_detection():
    assert detect("a.vol", b"mesh3d") == "netgen" and detect("b.glb", b"glTF") == "gltf" and detect("c.vti", b"<VTKFile") == "vti" and detect("d.vtu", b"<VTKFile") == "vtu"
