"""The VTK family as tools write it: binary legacy files, XML files with appended arrays, lattices, and indexes of pieces."""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable

import numpy as np

from .raw import RawMesh, register
from .text_formats import VTK, polygon, read_vtk, write_vtk, write_vtu

#: Types of XML arrays and of legacy files.
KINDS = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}
LEGACY = {"char": "i1", "unsigned_char": "u1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4", "long": "i8", "unsigned_long": "u8", "vtktypeint64": "i8", "float": "f4", "double": "f8", "vtkidtype": "i8"}


# XML


class XmlArrays:
    """The arrays of an XML file, inline or appended, raw or base64, as they are or in zlib blocks."""

    def __init__(self, data: bytes):
        head, self.appended, self.encoding = data, b"", "raw"
        if (m := re.search(rb"<AppendedData[^>]*encoding=[\"'](\w+)[\"'][^>]*>\s*_", data)) is not None:
            # raw bytes are not XML, so the tree is built without them
            end = data.rfind(b"</AppendedData>")
            self.appended, self.encoding = data[m.end() : end], m[1].decode()
            head = data[: m.start()] + data[end + len(b"</AppendedData>") :]
        self.root = ET.fromstring(head)
        self.order = "<" if self.root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        self.head = np.dtype(self.order + ("u8" if self.root.get("header_type") == "UInt64" else "u4"))
        compressor = self.root.get("compressor")
        if compressor not in (None, "", "vtkZLibDataCompressor"):
            raise ValueError(f"arrays packed by {compressor} are not read")
        self.packed = bool(compressor)

    def values(self, e: ET.Element) -> np.ndarray:
        """One array, as rows where it has several components."""
        dtype = np.dtype(self.order + KINDS[e.get("type")])
        if e.get("format") == "ascii":
            out = np.array((e.text or "").split(), float if dtype.kind == "f" else int)
        elif e.get("format") == "appended":
            at = int(e.get("offset"))
            data = self.appended[at:]
            out = np.frombuffer(self._base64(data) if self.encoding == "base64" else self._raw(data), dtype)
        else:
            out = np.frombuffer(self._base64("".join((e.text or "").split()).encode()), dtype)
        k = int(e.get("NumberOfComponents") or 1)
        return out.reshape(-1, k) if k > 1 else out

    def _sizes(self, data: bytes) -> tuple[list[int], int]:
        """Sizes of the blocks and of the header before them."""
        w = self.head.itemsize
        if not self.packed:
            return [int(np.frombuffer(data, self.head, 1)[0])], w
        n = int(np.frombuffer(data, self.head, 1)[0])
        return np.frombuffer(data, self.head, 3 + n)[3:].astype(int).tolist(), w * (3 + n)

    def _raw(self, data: bytes) -> bytes:
        sizes, at = self._sizes(data)
        out = []
        for s in sizes:
            part = data[at : at + s]
            out.append(zlib.decompress(part) if self.packed else part)
            at += s
        return b"".join(out)

    def _base64(self, text: bytes) -> bytes:
        w = self.head.itemsize
        coded = lambda n: -(-n // 3) * 4
        if not self.packed:
            # header and values are coded together
            n = int(np.frombuffer(base64.b64decode(text[: coded(w)]), self.head, 1)[0])
            return base64.b64decode(text[: coded(w + n)])[w : w + n]
        n = int(np.frombuffer(base64.b64decode(text[: coded(w)]), self.head, 1)[0])
        start = coded(w * (3 + n))
        sizes, _ = self._sizes(base64.b64decode(text[:start]))
        body = base64.b64decode(text[start : start + coded(sum(sizes))])
        out, at = [], 0
        for s in sizes:
            out.append(zlib.decompress(body[at : at + s]))
            at += s
        return b"".join(out)

    def data_of(self, piece: ET.Element, tag: str) -> dict[str, np.ndarray]:
        out = {}
        for e in piece.findall(f"{tag}/DataArray"):
            if e.get("type") in KINDS:
                v = self.values(e)
                out[e.get("Name")] = v.reshape(len(v), -1).astype(float)
        return out


Piece = tuple[np.ndarray, list[tuple[str, list[int]]], dict[str, np.ndarray], dict[str, np.ndarray]]


def _together(pieces: list[Piece]) -> RawMesh:
    """Pieces one after the other; arrays that every piece has are kept."""
    if not pieces:
        return RawMesh(np.zeros((0, 3)))
    cells, base = [], 0
    for p, c, _, _ in pieces:
        cells += [(t, [i + base for i in n]) for t, n in c] if base else c
        base += len(p)

    def joined(k: int) -> dict[str, np.ndarray]:
        names = [n for n in pieces[0][k] if all(n in q[k] for q in pieces)]
        return {n: np.concatenate([q[k][n] for q in pieces]) for n in names}

    return RawMesh(np.concatenate([p[0] for p in pieces]), cells, joined(2), joined(3))


def _runs(ends: np.ndarray) -> list[tuple[int, int]]:
    return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else []


def _unstructured(x: XmlArrays, piece: ET.Element) -> Piece:
    points = x.values(piece.find("Points/DataArray")).reshape(-1, 3).astype(float)
    arrays = {e.get("Name"): x.values(e) for e in piece.findall("Cells/DataArray")}
    con = arrays["connectivity"].astype(int).tolist()
    cells = [(VTK.get(int(t), "polygon"), con[a:b]) for t, (a, b) in zip(arrays["types"], _runs(arrays["offsets"].astype(int)), strict=True)]
    return points, cells, x.data_of(piece, "PointData"), x.data_of(piece, "CellData")


def _poly(x: XmlArrays, piece: ET.Element) -> Piece:
    points = x.values(piece.find("Points/DataArray")).reshape(-1, 3).astype(float)
    cells: list[tuple[str, list[int]]] = []
    for tag in ("Verts", "Lines", "Strips", "Polys"):
        arrays = {e.get("Name"): x.values(e) for e in piece.findall(f"{tag}/DataArray")}
        if not len(arrays.get("offsets", ())):
            continue
        con = arrays["connectivity"].astype(int).tolist()
        for a, b in _runs(arrays["offsets"].astype(int)):
            own = con[a:b]
            if tag == "Verts":
                cells += [("vertex", [i]) for i in own]
            elif tag == "Lines":
                cells += [("line", list(e)) for e in zip(own, own[1:], strict=False)]
            elif tag == "Strips":
                cells += [("triangle", own[k : k + 3] if k % 2 == 0 else [own[k + 1], own[k], own[k + 2]]) for k in range(len(own) - 2)]
            else:
                cells.append((polygon(len(own)), own))
    return points, cells, x.data_of(piece, "PointData"), x.data_of(piece, "CellData")


def lattice_cells(nodes: tuple[int, int, int]) -> list[tuple[str, list[int]]]:
    """Cells of a lattice of that many nodes along x, y and z, x fastest: hexahedra, or quads, lines or a vertex where sides are flat."""
    steps = [1, nodes[0], nodes[0] * nodes[1]]
    live = [a for a in range(3) if nodes[a] > 1]
    kind = ["vertex", "line", "quad", "hexahedron"][len(live)]
    corners = [0]
    for k, a in enumerate(live):
        # the second axis walks back, so that quads go round
        corners = corners + [c + steps[a] for c in (reversed(corners) if k == 1 else corners)]
    spans = [range(max(n - 1, 1)) for n in nodes]
    return [(kind, [i + nodes[0] * (j + nodes[1] * k) + c for c in corners]) for k in spans[2] for j in spans[1] for i in spans[0]]


def _extent(e: ET.Element) -> tuple[list[int], tuple[int, int, int]]:
    v = [int(w) for w in e.get("Extent").split()]
    return v, tuple(v[2 * a + 1] - v[2 * a] + 1 for a in range(3))


def _image(x: XmlArrays, piece: ET.Element) -> Piece:
    grid = next(iter(x.root))
    origin, spacing = ([float(w) for w in grid.get(k, d).split()] for k, d in (("Origin", "0 0 0"), ("Spacing", "1 1 1")))
    turn = np.array([float(w) for w in grid.get("Direction", "1 0 0 0 1 0 0 0 1").split()]).reshape(3, 3)
    v, nodes = _extent(piece)
    axes = [np.arange(v[2 * a], v[2 * a + 1] + 1) * spacing[a] for a in range(3)]
    z, y, xs = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    points = np.stack([xs.ravel(), y.ravel(), z.ravel()], 1) @ turn.T + origin
    return points, lattice_cells(nodes), x.data_of(piece, "PointData"), x.data_of(piece, "CellData")


def _rectilinear(x: XmlArrays, piece: ET.Element) -> Piece:
    _, nodes = _extent(piece)
    axes = [x.values(e).astype(float).ravel() for e in piece.findall("Coordinates/DataArray")]
    z, y, xs = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    return np.stack([xs.ravel(), y.ravel(), z.ravel()], 1), lattice_cells(nodes), x.data_of(piece, "PointData"), x.data_of(piece, "CellData")


def _structured(x: XmlArrays, piece: ET.Element) -> Piece:
    _, nodes = _extent(piece)
    points = x.values(piece.find("Points/DataArray")).reshape(-1, 3).astype(float)
    return points, lattice_cells(nodes), x.data_of(piece, "PointData"), x.data_of(piece, "CellData")


def _xml(make: Callable[[XmlArrays, ET.Element], Piece]) -> Callable[[bytes], RawMesh]:
    def read(data: bytes) -> RawMesh:
        x = XmlArrays(data)
        return _together([make(x, p) for p in x.root.iter("Piece")])

    return read


def write_vtu_appended(mesh: RawMesh) -> bytes:
    """An unstructured grid with raw appended arrays in zlib blocks."""
    from .text_formats import VTK_NUMBER

    body = bytearray()

    def array(name: str, kind: str, values: np.ndarray, k: int = 1) -> str:
        at, data = len(body), np.ascontiguousarray(values).astype("<" + KINDS[kind]).tobytes()
        packed = zlib.compress(data)
        body.extend(np.array([1, len(data), 0, len(packed)], "<u8").tobytes() + packed)
        return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{k}" format="appended" offset="{at}"/>'

    ends = np.cumsum([len(n) for _, n in mesh.cells])
    block = lambda tag, arrays: f"<{tag}>" + "".join(array(n, "Float64", v, v.shape[1]) for n, v in arrays.items()) + f"</{tag}>"
    cells = array("connectivity", "Int64", np.array([i for _, n in mesh.cells for i in n])) + array("offsets", "Int64", ends) + array("types", "UInt8", np.array([VTK_NUMBER[t] for t, _ in mesh.cells]))
    text = (
        '<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64" compressor="vtkZLibDataCompressor"><UnstructuredGrid>'
        f'<Piece NumberOfPoints="{len(mesh.points)}" NumberOfCells="{len(mesh.cells)}"><Points>{array("Points", "Float64", mesh.points, 3)}</Points><Cells>{cells}</Cells>'
        f'{block("PointData", mesh.point_data)}{block("CellData", mesh.cell_data)}</Piece></UnstructuredGrid><AppendedData encoding="raw">_'
    )
    return text.encode() + bytes(body) + b"</AppendedData></VTKFile>\n"


def write_vtp(mesh: RawMesh) -> bytes:
    """Vertices, lines and faces as polydata, inline."""
    groups = {"Verts": ["vertex"], "Lines": ["line"], "Polys": ["triangle", "quad", "polygon"]}
    known = {t for ts in groups.values() for t in ts}
    if bad := sorted({t for t, _ in mesh.cells} - known):
        raise ValueError(f"the format holds vertices, lines and faces only, not {bad}")
    order = [k for ts in groups.values() for k, (t, _) in enumerate(mesh.cells) if t in ts]
    array = lambda name, kind, v, k=1: f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{k}" format="ascii">{" ".join(map(repr, np.asarray(v).ravel().tolist()))}</DataArray>'
    counts, parts = {}, []
    for tag, ts in groups.items():
        own = [n for t, n in mesh.cells if t in ts]
        counts[tag] = len(own)
        parts.append(f"<{tag}>" + array("connectivity", "Int64", np.array([i for n in own for i in n], int)) + array("offsets", "Int64", np.cumsum([len(n) for n in own], dtype=int)) + f"</{tag}>")
    block = lambda tag, arrays, rows: f"<{tag}>" + "".join(array(n, "Float64", v[rows], v.shape[1]) for n, v in arrays.items()) + f"</{tag}>"
    data = block("PointData", mesh.point_data, slice(None)) + block("CellData", mesh.cell_data, order)
    head = f'<Piece NumberOfPoints="{len(mesh.points)}" NumberOfVerts="{counts["Verts"]}" NumberOfLines="{counts["Lines"]}" NumberOfStrips="0" NumberOfPolys="{counts["Polys"]}">'
    return f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian"><PolyData>{head}<Points>{array("Points", "Float64", mesh.points, 3)}</Points>{"".join(parts)}{data}</Piece></PolyData></VTKFile>\n'.encode()


def piece_references(data: bytes) -> list[tuple[str, float | None, str | None]]:
    """(path, time, name) of the files that an index names: a collection, a parallel file or a multiblock one."""
    root = ET.fromstring(data)
    out: list[tuple[str, float | None, str | None]] = []
    for e in root.iter():
        path = e.get("Source") if e.tag == "Piece" else e.get("file") if e.tag == "DataSet" else None
        if path:
            time = e.get("timestep")
            out.append((path, float(time) if time is not None else None, e.get("name") or e.get("part")))
    return out


# Legacy, binary


def read_vtk_any(data: bytes) -> RawMesh:
    """Legacy files of both encodings; lattices as well as grids and polydata."""
    lines = data.split(b"\n", 3)
    if len(lines) > 2 and lines[2].strip().upper() == b"BINARY":
        return _read_binary(lines[3])
    if any(k in data[:400] for k in (b"STRUCTURED_POINTS", b"RECTILINEAR_GRID", b"STRUCTURED_GRID")) and b"UNSTRUCTURED_GRID" not in data[:400]:
        return _read_binary(lines[3], ascii_=True)
    return read_vtk(data)


class _Legacy:
    """A cursor over the keywords and the big-endian values of a legacy file, or over its words."""

    def __init__(self, data: bytes, ascii_: bool):
        self.data, self.at, self.ascii = data, 0, ascii_

    def line(self) -> list[str]:
        while self.at < len(self.data):
            end = self.data.find(b"\n", self.at)
            end = len(self.data) if end < 0 else end
            words = self.data[self.at : end].decode("latin-1").split()
            self.at = end + 1
            if words:
                return words
        return []

    def values(self, n: int, kind: str) -> np.ndarray:
        dtype = np.dtype(">" + LEGACY[kind.lower()])
        if not self.ascii:
            out = np.frombuffer(self.data, dtype, n, self.at)
            self.at += n * dtype.itemsize
            return out
        out: list[str] = []
        while len(out) < n:
            out += self.line()
        return np.array(out[:n], float if dtype.kind == "f" else int)


def _read_binary(data: bytes, ascii_: bool = False) -> RawMesh:
    f = _Legacy(data, ascii_)
    points, cells, kinds = np.zeros((0, 3)), [], None
    nodes, axes, origin, spacing = None, {}, [0.0] * 3, [1.0] * 3
    store: dict[str, dict[str, np.ndarray]] = {"POINT_DATA": {}, "CELL_DATA": {}}
    where, count = None, 0
    while words := f.line():
        head = words[0].upper()
        if head == "DIMENSIONS":
            nodes = tuple(map(int, words[1:4]))
        elif head in ("ORIGIN", "SPACING", "ASPECT_RATIO"):
            v = list(map(float, words[1:4]))
            origin, spacing = (v, spacing) if head == "ORIGIN" else (origin, v)
        elif head.endswith("_COORDINATES"):
            axes[head[0]] = f.values(int(words[1]), words[2]).astype(float)
        elif head == "POINTS":
            points = f.values(3 * int(words[1]), words[2]).reshape(-1, 3).astype(float)
        elif head in ("CELLS", "POLYGONS", "LINES", "VERTICES", "TRIANGLE_STRIPS"):
            n, total = int(words[1]), int(words[2])
            mark = f.at
            following = f.line()
            if following and following[0].upper() == "OFFSETS":
                ends = f.values(n, following[1]).astype(int)
                flat = f.values(total, f.line()[1]).astype(int).tolist()
                rows = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            else:
                f.at = mark
                flat, rows, k = f.values(total, "int").tolist(), [], 0
                while k < total:
                    rows.append(flat[k + 1 : k + 1 + flat[k]])
                    k += 1 + flat[k]
            for r in rows:
                if head == "LINES":
                    cells += [("line", list(e)) for e in zip(r, r[1:], strict=False)]
                elif head == "VERTICES":
                    cells += [("vertex", [i]) for i in r]
                elif head == "TRIANGLE_STRIPS":
                    cells += [("triangle", r[k : k + 3] if k % 2 == 0 else [r[k + 1], r[k], r[k + 2]]) for k in range(len(r) - 2)]
                else:
                    cells.append((polygon(len(r)), r))
        elif head == "CELL_TYPES":
            kinds = [VTK.get(int(t), "polygon") for t in f.values(int(words[1]), "int")]
        elif head in store:
            where, count = head, int(words[1])
        elif head == "SCALARS" and where:
            k = int(words[3]) if len(words) > 3 else 1
            mark = f.at
            if f.line()[0].upper() != "LOOKUP_TABLE":
                f.at = mark
            store[where][words[1]] = f.values(k * count, words[2]).reshape(-1, k).astype(float)
        elif head in ("VECTORS", "NORMALS") and where:
            store[where][words[1]] = f.values(3 * count, words[2]).reshape(-1, 3).astype(float)
        elif head == "TENSORS" and where:
            store[where][words[1]] = f.values(9 * count, words[2]).reshape(-1, 9).astype(float)
        elif head == "FIELD":
            for _ in range(int(words[2])):
                name, k, n, kind = f.line()
                v = f.values(int(k) * int(n), kind).reshape(int(n), int(k)).astype(float)
                if where:
                    store[where][name] = v
    if nodes is not None:
        if not len(points):
            lines = [axes.get(c, np.arange(nodes[a]) * spacing[a] + origin[a]) for a, c in enumerate("XYZ")]
            z, y, x = np.meshgrid(lines[2], lines[1], lines[0], indexing="ij")
            points = np.stack([x.ravel(), y.ravel(), z.ravel()], 1)
        cells = lattice_cells(nodes)
    elif kinds:
        cells = [(k, n) for k, (_, n) in zip(kinds, cells, strict=True)]
    return RawMesh(points, cells, store["POINT_DATA"], store["CELL_DATA"])


def write_vtk_binary(mesh: RawMesh) -> bytes:
    from .text_formats import VTK_NUMBER

    flat = np.array([v for _, n in mesh.cells for v in (len(n), *n)], ">i4")
    out = [f"# vtk DataFile Version 4.2\nwritten by lattica\nBINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS {len(mesh.points)} double\n".encode(), mesh.points.astype(">f8").tobytes()]
    out += [f"\nCELLS {len(mesh.cells)} {len(flat)}\n".encode(), flat.tobytes(), f"\nCELL_TYPES {len(mesh.cells)}\n".encode(), np.array([VTK_NUMBER[t] for t, _ in mesh.cells], ">i4").tobytes()]
    for head, n, arrays in (("POINT_DATA", len(mesh.points), mesh.point_data), ("CELL_DATA", len(mesh.cells), mesh.cell_data)):
        if arrays:
            out.append(f"\n{head} {n}\nFIELD FieldData {len(arrays)}\n".encode())
            for name, v in arrays.items():
                out += [f"{name.replace(' ', '_')} {v.shape[1]} {n} double\n".encode(), v.astype(">f8").tobytes(), b"\n"]
    return b"".join(out) + b"\n"


register("vtk", (".vtk",), read_vtk_any, write_vtk, (b"# vtk",))
register("vtk-binary", (), read_vtk_any, write_vtk_binary)
register("vtu", (".vtu",), _xml(_unstructured), write_vtu)
register("vtu-appended", (), _xml(_unstructured), write_vtu_appended)
register("vtp", (".vtp",), _xml(_poly), write_vtp)
register("vti", (".vti",), _xml(_image))
register("vtr", (".vtr",), _xml(_rectilinear))
register("vts", (".vts",), _xml(_structured))
