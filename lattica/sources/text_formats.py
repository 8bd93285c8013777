"""Text formats, each as a reader from bytes and a writer to bytes."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np

from ..celltypes import EDGES, LINEAR, TYPES
from .raw import RawMesh, register


def _lines(data: bytes, comment: str = "#") -> Iterator[list[str]]:
    for line in data.decode("utf-8", "replace").splitlines():
        words = line.split(comment, 1)[0].split() if comment else line.split()
        if words:
            yield words


def _num(v: float) -> str:
    return repr(float(v))


def _row(values) -> str:
    return " ".join(_num(v) for v in values)


def _text(lines: list[str]) -> bytes:
    return ("\n".join(lines) + "\n").encode()


def polygon(n: int) -> str:
    return {1: "vertex", 2: "line", 3: "triangle", 4: "quad"}.get(n, "polygon")


def faces_of(mesh: RawMesh) -> list[list[int]]:
    bad = {t for t, _ in mesh.cells if t not in ("triangle", "quad", "polygon")}
    if bad:
        raise ValueError(f"the format holds faces only, not {sorted(bad)}")
    return [n for _, n in mesh.cells]


# OFF: counts, points, faces


def read_off(data: bytes) -> RawMesh:
    words = [w for line in _lines(data) for w in line]
    if words and words[0].upper().endswith("OFF"):
        words = words[1:]
    n, m = int(words[0]), int(words[1])
    at = 3 + 3 * n
    points = np.array(words[3:at], float).reshape(n, 3)
    cells = []
    lines = list(_lines(data))
    rows = lines[len(lines) - m :] if m else []
    for r in rows:
        k = int(r[0])
        cells.append((polygon(k), [int(x) for x in r[1 : 1 + k]]))
    return RawMesh(points, cells)


def write_off(mesh: RawMesh) -> bytes:
    faces = faces_of(mesh)
    return _text(["OFF", f"{len(mesh.points)} {len(faces)} 0", *map(_row, mesh.points), *(f"{len(f)} " + " ".join(map(str, f)) for f in faces)])


# OBJ: v, f, l; indices from 1, negative from the end; groups become regions


def read_obj(data: bytes) -> RawMesh:
    points, cells, groups, group = [], [], {}, None
    for w in _lines(data):
        if w[0] == "v":
            points.append([float(x) for x in w[1:4]])
        elif w[0] in ("f", "l"):
            ids = [int(x.split("/")[0]) for x in w[1:]]
            nodes = [i - 1 if i > 0 else len(points) + i for i in ids]
            runs = [nodes] if w[0] == "f" else [list(p) for p in zip(nodes, nodes[1:], strict=False)]
            for r in runs:
                if group:
                    groups.setdefault(group, []).append(len(cells))
                cells.append((polygon(len(r)), r))
        elif w[0] in ("g", "o"):
            group = " ".join(w[1:]) or None
    return RawMesh(points, cells, regions=[("cell", k, 0, v) for k, v in groups.items()])


def write_obj(mesh: RawMesh) -> bytes:
    out = [f"v {_row(p)}" for p in mesh.points]
    for t, n in mesh.cells:
        out.append(("l " if t == "line" else "f ") + " ".join(str(i + 1) for i in n))
    return _text(out)


# XYZ and PTS: a point a line, further columns as data


def read_xyz(data: bytes) -> RawMesh:
    rows = [[float(x) for x in w] for w in (re.sub(r"[,;]", " ", " ".join(l)).split() for l in _lines(data)) if len(w) >= 3]
    width = min((len(r) for r in rows), default=3)
    table = np.array([r[:width] for r in rows]).reshape(-1, width)
    extra = {f"column_{k}": table[:, k : k + 1] for k in range(3, width)}
    return RawMesh(table[:, :3], [("vertex", [i]) for i in range(len(table))], extra)


def write_xyz(mesh: RawMesh) -> bytes:
    return _text([_row(p) for p in mesh.points])


# Tetrahedra and triangles in the block formats

MEDIT = {"Edges": "line", "Triangles": "triangle", "Quadrilaterals": "quad", "Tetrahedra": "tetra", "Prisms": "wedge", "Pyramids": "pyramid", "Hexahedra": "hexahedron"}


def read_medit(data: bytes) -> RawMesh:
    words = iter([w for l in _lines(data) for w in l])
    dim, points, refs, cells, tags = 3, [], [], [], []
    for w in words:
        if w == "Dimension":
            dim = int(next(words))
        elif w == "Vertices":
            for _ in range(int(next(words))):
                points.append([float(next(words)) for _ in range(dim)])
                refs.append(int(next(words)))
        elif w in MEDIT:
            k = TYPES[MEDIT[w]][1]
            for _ in range(int(next(words))):
                cells.append((MEDIT[w], [int(next(words)) - 1 for _ in range(k)]))
                tags.append(int(next(words)))
        elif w == "End":
            break
    return RawMesh(points, cells, {"medit:ref": np.array(refs, float).reshape(-1, 1)}, {"medit:ref": np.array(tags, float).reshape(-1, 1)})


def write_medit(mesh: RawMesh) -> bytes:
    out = ["MeshVersionFormatted 2", "Dimension 3", "Vertices", str(len(mesh.points))]
    ref = mesh.point_data.get("medit:ref")
    out += [f"{_row(p)} {int(ref[i, 0]) if ref is not None else 0}" for i, p in enumerate(mesh.points)]
    tags = mesh.cell_data.get("medit:ref")
    for section, kind in MEDIT.items():
        rows = [(i, n) for i, (t, n) in enumerate(mesh.cells) if t == kind]
        if rows:
            out += [section, str(len(rows)), *(" ".join(str(x + 1) for x in n) + f" {int(tags[i, 0]) if tags is not None else 0}" for i, n in rows)]
    return _text([*out, "End"])


#: VTK numbers, shared by SU2 and VTU.
VTK = {1: "vertex", 3: "line", 5: "triangle", 7: "polygon", 9: "quad", 10: "tetra", 12: "hexahedron", 13: "wedge", 14: "pyramid", 21: "line3", 22: "triangle6", 23: "quad8", 24: "tetra10", 25: "hexahedron20", 26: "wedge15", 28: "quad9"}
VTK_NUMBER = {v: k for k, v in VTK.items()}


def read_su2(data: bytes) -> RawMesh:
    rows = list(_lines(data.replace(b"=", b" = "), "%"))
    dim, points, cells, regions = 3, [], [], []
    at = 0

    def block(n: int) -> list[tuple[str, list[int]]]:
        out = []
        for w in rows[at + 1 : at + 1 + n]:
            kind = VTK[int(w[0])]
            out.append((kind, [int(x) for x in w[1 : 1 + TYPES[kind][1]]]))
        return out

    name = ""
    while at < len(rows):
        w = rows[at]
        key, value = w[0], w[2] if len(w) > 2 else ""
        n = 0
        if key == "NDIME":
            dim = int(value)
        elif key == "NPOIN":
            n = int(value)
            points = [[float(x) for x in r[:dim]] for r in rows[at + 1 : at + 1 + n]]
        elif key == "NELEM":
            n = int(value)
            cells += block(n)
        elif key == "MARKER_TAG":
            name = value
        elif key == "MARKER_ELEMS":
            n = int(value)
            own = block(n)
            regions.append(("cell", name, len(regions) + 1, list(range(len(cells), len(cells) + n))))
            cells += own
        at += 1 + n
    return RawMesh(points, cells, regions=regions)


def write_su2(mesh: RawMesh) -> bytes:
    flat = not np.any(mesh.points[:, 2]) if len(mesh.points) else True
    dim = 2 if flat and all(TYPES[t][0] < 3 for t, _ in mesh.cells) else 3
    marked = {i for _, _, _, e in mesh.regions for i in e}
    body = [c for i, c in enumerate(mesh.cells) if i not in marked]
    line = lambda c: f"{VTK_NUMBER[c[0]]} " + " ".join(map(str, c[1]))
    out = [f"NDIME= {dim}", f"NELEM= {len(body)}", *map(line, body), f"NPOIN= {len(mesh.points)}", *(_row(p[:dim]) for p in mesh.points), f"NMARK= {len(mesh.regions)}"]
    for _, name, _, entries in mesh.regions:
        out += [f"MARKER_TAG= {name}", f"MARKER_ELEMS= {len(entries)}", *(line(mesh.cells[i]) for i in entries)]
    return _text(out)


#: Gmsh numbers.
GMSH = {1: "line", 2: "triangle", 3: "quad", 4: "tetra", 5: "hexahedron", 6: "wedge", 7: "pyramid", 8: "line3", 9: "triangle6", 10: "quad9", 11: "tetra10", 15: "vertex", 16: "quad8", 17: "hexahedron20", 18: "wedge15"}
GMSH_NUMBER = {v: k for k, v in GMSH.items()}
#: Edges in the order of this format's middle nodes, where it is not that of EDGES.
GMSH_EDGES = {
    "tetra10": [(0, 1), (1, 2), (0, 2), (0, 3), (2, 3), (1, 3)],
    "wedge15": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (3, 5), (4, 5)],
    "hexahedron20": [(0, 1), (0, 3), (0, 4), (1, 2), (1, 5), (2, 3), (2, 6), (3, 7), (4, 5), (4, 7), (5, 6), (6, 7)],
}


def _gmsh_order(kind: str) -> list[int]:
    """For each of our nodes its place in this format."""
    if kind not in GMSH_EDGES:
        return list(range(TYPES[kind][1]))
    corners = TYPES[kind][2]
    theirs = [frozenset(e) for e in GMSH_EDGES[kind]]
    return [*range(corners), *(corners + theirs.index(frozenset(e)) for e in EDGES[LINEAR[kind]])]


def _sections(data: bytes) -> dict[str, list[list[str]]]:
    out: dict[str, list[list[str]]] = {}
    name = None
    for w in _lines(data, ""):
        if w[0].startswith("$End"):
            name = None
        elif w[0].startswith("$"):
            name = w[0][1:]
            out.setdefault(name, [])
        elif name:
            out[name].append(w)
    return out


def read_gmsh(data: bytes) -> RawMesh:
    """Version 2.2 and 4.1, ASCII."""
    s = _sections(data)
    version = float(s["MeshFormat"][0][0])
    if s["MeshFormat"][0][1] != "0":
        raise ValueError("binary files of this format are not read")
    ids, points, cells, tags = [], [], [], []
    if version < 4:
        for w in s["Nodes"][1:]:
            ids.append(int(w[0]))
            points.append([float(x) for x in w[1:4]])
        for w in s["Elements"][1:]:
            kind, n = GMSH[int(w[1])], int(w[2])
            tags.append(int(w[3]) if n else 0)
            cells.append((kind, [int(x) for x in w[3 + n :]]))
    else:
        rows = iter(s["Nodes"][1:])
        for head in rows:
            n = int(head[3])
            ids += [int(next(rows)[0]) for _ in range(n)]
            points += [[float(x) for x in next(rows)[:3]] for _ in range(n)]
        rows = iter(s["Elements"][1:])
        for head in rows:
            kind = GMSH[int(head[2])]
            for _ in range(int(head[3])):
                cells.append((kind, [int(x) for x in next(rows)[1:]]))
                tags.append(int(head[1]))
    place = {v: k for k, v in enumerate(ids)}
    cells = [(t, [place[n[k]] for k in _gmsh_order(t)]) for t, n in cells]
    names = {(int(w[0]), int(w[1])): " ".join(w[2:]).strip('"') for w in s.get("PhysicalNames", [])[1:]}
    regions = []
    for (dim, tag), name in names.items():
        entries = [i for i, ((t, _), g) in enumerate(zip(cells, tags, strict=True)) if g == tag and TYPES[t][0] == dim]
        regions.append(("cell", name, tag, entries))
    data_ = {"gmsh:physical": np.array(tags, float).reshape(-1, 1)}
    point_data = {}
    if w := s.get("NodeData"):
        rows = {int(r[0]): [float(x) for x in r[1:]] for r in w[-len(points) :]}
        point_data[" ".join(w[1]).strip('"')] = np.array([rows[i] for i in ids])
    return RawMesh(points, cells, point_data, data_, regions)


def write_gmsh(mesh: RawMesh) -> bytes:
    tags = mesh.cell_data.get("gmsh:physical")
    out = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(len(mesh.points)), *(f"{i + 1} {_row(p)}" for i, p in enumerate(mesh.points)), "$EndNodes", "$Elements", str(len(mesh.cells))]
    for i, (t, n) in enumerate(mesh.cells):
        g = int(tags[i, 0]) if tags is not None else 0
        order = _gmsh_order(t)
        out.append(f"{i + 1} {GMSH_NUMBER[t]} 2 {g} {g} " + " ".join(str(n[order.index(k)] + 1) for k in range(len(n))))
    return _text([*out, "$EndElements"])


# VTK legacy and VTU


def read_vtk(data: bytes) -> RawMesh:
    """Legacy files, ASCII: unstructured grids and polydata, versions to 5.1."""
    if b"\nBINARY" in data[:300]:
        raise ValueError("binary files of this format are not read")
    words = data.decode("latin-1").split("\n", 3)[3].split()
    at = 0
    points, cells, kinds, flat, data_at = np.zeros((0, 3)), [], None, None, None
    sizes = {"POINT_DATA": 0, "CELL_DATA": 0}
    store: dict[str, dict[str, np.ndarray]] = {"POINT_DATA": {}, "CELL_DATA": {}}
    offsets = None

    def take(n: int) -> list[str]:
        nonlocal at
        at += n
        return words[at - n : at]

    while at < len(words):
        w = take(1)[0]
        if w == "POINTS":
            n = int(take(2)[0])
            points = np.array(take(3 * n), float).reshape(n, 3)
        elif w in ("CELLS", "POLYGONS", "LINES"):
            n, total = map(int, take(2))
            if words[at] == "OFFSETS":
                take(2)
                offsets = np.array(take(n), int)
                take(2)
                flat = np.array(take(total), int)
                rows = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
            else:
                flat = np.array(take(total), int)
                rows, k = [], 0
                while k < total:
                    rows.append(flat[k + 1 : k + 1 + flat[k]].tolist())
                    k += 1 + flat[k]
            cells += [(polygon(len(r)) if w != "LINES" else "line", r) for r in rows]
        elif w == "CELL_TYPES":
            kinds = [VTK[int(x)] for x in take(int(take(1)[0]))]
        elif w in sizes:
            data_at, sizes[w] = w, int(take(1)[0])
        elif w == "SCALARS" and data_at:
            name = take(2)[0]
            k = int(take(1)[0]) if words[at].isdigit() else 1
            if words[at] == "LOOKUP_TABLE":
                take(2)
            store[data_at][name] = np.array(take(k * sizes[data_at]), float).reshape(-1, k)
        elif w in ("VECTORS", "NORMALS") and data_at:
            name = take(2)[0]
            store[data_at][name] = np.array(take(3 * sizes[data_at]), float).reshape(-1, 3)
        elif w == "FIELD" and data_at:
            for _ in range(int(take(2)[1])):
                name, k, n, _ = take(4)
                store[data_at][name] = np.array(take(int(k) * int(n)), float).reshape(int(n), int(k))
    if kinds:
        cells = [(k, n) for k, (_, n) in zip(kinds, cells, strict=True)]
    return RawMesh(points, cells, store["POINT_DATA"], store["CELL_DATA"])


def write_vtk(mesh: RawMesh) -> bytes:
    total = sum(len(n) + 1 for _, n in mesh.cells)
    out = ["# vtk DataFile Version 4.2", "written by lattica", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(mesh.points)} double", *map(_row, mesh.points), f"CELLS {len(mesh.cells)} {total}"]
    out += [f"{len(n)} " + " ".join(map(str, n)) for _, n in mesh.cells]
    out += [f"CELL_TYPES {len(mesh.cells)}", *(str(VTK_NUMBER[t]) for t, _ in mesh.cells)]
    for head, n, arrays in (("POINT_DATA", len(mesh.points), mesh.point_data), ("CELL_DATA", len(mesh.cells), mesh.cell_data)):
        if arrays:
            out += [f"{head} {n}", f"FIELD FieldData {len(arrays)}"]
            for name, v in arrays.items():
                out += [f"{name.replace(' ', '_')} {v.shape[1]} {n} double", *map(_row, v)]
    return _text(out)


def read_vtu(data: bytes) -> RawMesh:
    """Unstructured grids with inline ASCII or base64 arrays, all pieces; headers of 4 or 8 bytes, zlib or none."""
    import base64
    import zlib

    root = ET.fromstring(data)
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    head = np.dtype(order + ("u8" if root.get("header_type") == "UInt64" else "u4"))
    kinds = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}
    packed = root.get("compressor") is not None

    def values(e: ET.Element) -> np.ndarray:
        dtype = np.dtype(order + kinds[e.get("type")])
        if e.get("format") == "ascii":
            out = np.array((e.text or "").split(), float if dtype.kind == "f" else int)
        elif e.get("format") == "binary":
            text = "".join((e.text or "").split())
            if packed:
                n = int(np.frombuffer(base64.b64decode(text[:32]), head, 1)[0])
                size = -(-head.itemsize * (3 + n) // 3) * 4
                sizes = np.frombuffer(base64.b64decode(text[:size]), head)[3 : 3 + n]
                body, parts, at = base64.b64decode(text[size:]), [], 0
                for s in sizes.astype(int):
                    parts.append(zlib.decompress(body[at : at + s]))
                    at += s
                out = np.frombuffer(b"".join(parts), dtype)
            else:
                out = np.frombuffer(base64.b64decode(text)[head.itemsize :], dtype)
        else:
            raise ValueError("appended arrays are not read")
        k = int(e.get("NumberOfComponents") or 1)
        return out.reshape(-1, k) if k > 1 else out

    points, cells, pd, cd, base = [], [], {}, {}, 0
    for piece in root.iter("Piece"):
        p = values(piece.find("Points/DataArray")).reshape(-1, 3)
        arrays = {e.get("Name"): values(e) for e in piece.findall("Cells/DataArray")}
        ends = arrays["offsets"].astype(int)
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        con = arrays["connectivity"].astype(int) + base
        cells += [(VTK.get(int(t), "polygon"), con[a:b].tolist()) for t, a, b in zip(arrays["types"], begins, ends, strict=True)]
        for tag, store in (("PointData", pd), ("CellData", cd)):
            for e in piece.findall(f"{tag}/DataArray"):
                v = values(e)
                store.setdefault(e.get("Name"), []).append(v.reshape(len(v), -1))
        points.append(p)
        base += len(p)
    join = lambda d: {k: np.concatenate(v).astype(float) for k, v in d.items()}
    return RawMesh(np.concatenate(points) if points else np.zeros((0, 3)), cells, join(pd), join(cd))


def write_vtu(mesh: RawMesh) -> bytes:
    array = lambda name, kind, text, k=1: f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{k}" format="ascii">{text}</DataArray>'
    block = lambda tag, arrays: f"<{tag}>" + "".join(array(n, "Float64", " ".join(_row(r) for r in v), v.shape[1]) for n, v in arrays.items()) + f"</{tag}>"
    ends = np.cumsum([len(n) for _, n in mesh.cells]).tolist()
    body = [
        '<?xml version="1.0"?>', '<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian"><UnstructuredGrid>',
        f'<Piece NumberOfPoints="{len(mesh.points)}" NumberOfCells="{len(mesh.cells)}">',
        "<Points>" + array("Points", "Float64", " ".join(map(_row, mesh.points)), 3) + "</Points>",
        "<Cells>" + array("connectivity", "Int64", " ".join(str(i) for _, n in mesh.cells for i in n)) + array("offsets", "Int64", " ".join(map(str, ends))) + array("types", "UInt8", " ".join(str(VTK_NUMBER[t]) for t, _ in mesh.cells)) + "</Cells>",
        block("PointData", mesh.point_data), block("CellData", mesh.cell_data), "</Piece></UnstructuredGrid></VTKFile>",
    ]
    return _text(body)


# Decks

ABAQUS = {"T2D2": "line", "T3D3": "line3", "B32": "line3", "S6": "triangle6", "S8": "quad8", "C3D8I": "hexahedron", "DC3D8": "hexahedron", "DC3D4": "tetra", "C3D15": "wedge15", "T3D2": "line", "B31": "line", "S3": "triangle", "CPS3": "triangle", "CPE3": "triangle", "S4": "quad", "S4R": "quad", "CPS4": "quad", "CPE4": "quad", "C3D4": "tetra", "C3D5": "pyramid", "C3D6": "wedge", "C3D8": "hexahedron", "C3D8R": "hexahedron", "C3D10": "tetra10", "C3D20": "hexahedron20"}
ABAQUS_NAME = {"line": "T3D2", "triangle": "S3", "quad": "S4", "tetra": "C3D4", "pyramid": "C3D5", "wedge": "C3D6", "hexahedron": "C3D8", "tetra10": "C3D10", "wedge15": "C3D15", "hexahedron20": "C3D20", "line3": "T3D3", "triangle6": "S6", "quad8": "S8"}


def read_abaqus(data: bytes) -> RawMesh:
    ids, points, cells, cell_ids = [], [], [], []
    sets: dict[tuple[str, str], list[int]] = {}
    mode, options, pending = "", {}, []
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if not line or line.startswith("**"):
            continue
        if line.startswith("*"):
            parts = [p.strip() for p in line[1:].split(",")]
            mode = parts[0].upper()
            options = {k.strip().upper(): v.strip() for k, _, v in (p.partition("=") for p in parts[1:])}
            pending = []
            continue
        values = [v.strip() for v in line.split(",") if v.strip()]
        if mode == "NODE":
            ids.append(int(values[0]))
            points.append([float(x) for x in (values[1:4] + ["0", "0"])[:3]])
        elif mode == "ELEMENT":
            kind = ABAQUS[options["TYPE"].upper()]
            pending += [int(v) for v in values]
            if len(pending) > TYPES[kind][1]:
                cell_ids.append(pending[0])
                cells.append((kind, pending[1:]))
                if "ELSET" in options:
                    sets.setdefault(("cell", options["ELSET"]), []).append(pending[0])
                pending = []
        elif mode in ("NSET", "ELSET"):
            own = sets.setdefault(("point" if mode == "NSET" else "cell", options.get(mode, "")), [])
            if "GENERATE" in options:
                a, b, c = [int(v) for v in (values + ["1"])[:3]]
                own += range(a, b + 1, c)
            else:
                own += [int(v) for v in values if v.lstrip("-").isdigit()]
    p, c = {v: k for k, v in enumerate(ids)}, {v: k for k, v in enumerate(cell_ids)}
    regions = [(kind, name, 0, sorted({m[i] for i in e if i in m})) for (kind, name), e in sets.items() for m in [p if kind == "point" else c]]
    return RawMesh(points, [(t, [p[i] for i in n]) for t, n in cells], regions=regions)


def write_abaqus(mesh: RawMesh) -> bytes:
    out = ["*HEADING", "written by lattica", "*NODE", *(f"{i + 1}, " + ", ".join(map(_num, p)) for i, p in enumerate(mesh.points))]
    last = None
    for i, (t, n) in enumerate(mesh.cells):
        if t != last:
            out.append(f"*ELEMENT, TYPE={ABAQUS_NAME[t]}")
            last = t
        out.append(f"{i + 1}, " + ", ".join(str(x + 1) for x in n))
    for kind, name, _, entries in mesh.regions:
        out += [f"*{'NSET, NSET' if kind == 'point' else 'ELSET, ELSET'}={name}", *(str(e + 1) for e in entries)]
    return _text(out)


NASTRAN = {"CROD": "line", "CBAR": "line", "CTRIA3": "triangle", "CQUAD4": "quad", "CTETRA": "tetra", "CPENTA": "wedge", "CHEXA": "hexahedron", "CPYRA": "pyramid"}


def _nastran_number(text: str) -> float:
    text = text.strip().lower().replace("d", "e")
    return float(re.sub(r"(?<=[0-9.])([+-])(?=[0-9]+$)", r"e\1", text) if "e" not in text else text)


def read_nastran(data: bytes) -> RawMesh:
    """Bulk data in small fields of 8 or free fields; continuations are joined."""
    cards: list[list[str]] = []
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.split("$")[0].rstrip()
        if not line:
            continue
        fields = [f.strip() for f in line.split(",")] if "," in line else [line[i : i + 8].strip() for i in range(0, len(line), 8)]
        if line[0] in "+ " and cards:
            cards[-1] += fields[1:9]
        else:
            cards.append(fields[:9])
    ids, points, cells, tags = [], [], [], []
    for c in cards:
        name = c[0].upper()
        if name == "GRID":
            ids.append(int(c[1]))
            points.append([_nastran_number(x) if x else 0.0 for x in (c[3:6] + ["", "", ""])[:3]])
        elif name in NASTRAN:
            kind = NASTRAN[name]
            cells.append((kind, [int(x) for x in c[3:] if x.isdigit()][: TYPES[kind][1]]))
            tags.append(int(c[2] or 0))
    p = {v: k for k, v in enumerate(ids)}
    return RawMesh(points, [(t, [p[i] for i in n]) for t, n in cells], {}, {"nastran:property": np.array(tags, float).reshape(-1, 1)})


def write_nastran(mesh: RawMesh) -> bytes:
    names = {"line": "CROD", "triangle": "CTRIA3", "quad": "CQUAD4", "tetra": "CTETRA", "wedge": "CPENTA", "hexahedron": "CHEXA", "pyramid": "CPYRA"}
    tags = mesh.cell_data.get("nastran:property")
    out = ["BEGIN BULK", *(f"GRID,{i + 1},,{_num(p[0])},{_num(p[1])},{_num(p[2])}" for i, p in enumerate(mesh.points))]
    for i, (t, n) in enumerate(mesh.cells):
        nodes = [str(x + 1) for x in n]
        out.append(f"{names[t]},{i + 1},{int(tags[i, 0]) if tags is not None else 1}," + ",".join(nodes[:6]))
        if len(nodes) > 6:
            out.append("+," + ",".join(nodes[6:]))
    return _text([*out, "ENDDATA"])


# Further small ones

AVS = {"pt": "vertex", "line": "line", "tri": "triangle", "quad": "quad", "tet": "tetra", "pyr": "pyramid", "prism": "wedge", "hex": "hexahedron"}


def read_avsucd(data: bytes) -> RawMesh:
    rows = list(_lines(data))
    n, m, k = (int(x) for x in rows[0][:3])
    place = {int(r[0]): i for i, r in enumerate(rows[1 : 1 + n])}
    points = [[float(x) for x in r[1:4]] for r in rows[1 : 1 + n]]
    body = rows[1 + n : 1 + n + m]
    cells = [(AVS[r[2]], [place[int(x)] for x in r[3:]]) for r in body]
    pd = {}
    if k:
        at = 1 + n + m
        widths = [int(x) for x in rows[at][1 : 1 + int(rows[at][0])]]
        names = [" ".join(r).split(",")[0].strip() for r in rows[at + 1 : at + 1 + len(widths)]]
        table = np.array([[float(x) for x in r[1:]] for r in rows[at + 1 + len(widths) : at + 1 + len(widths) + n]])
        ends = np.cumsum(widths)
        pd = {name: table[:, e - w : e] for name, w, e in zip(names, widths, ends, strict=True)}
    return RawMesh(points, cells, pd, {"avsucd:material": np.array([[float(r[1])] for r in body]).reshape(-1, 1)})


def write_avsucd(mesh: RawMesh) -> bytes:
    names = {v: k for k, v in AVS.items()}
    width = sum(v.shape[1] for v in mesh.point_data.values())
    out = [f"{len(mesh.points)} {len(mesh.cells)} {width} 0 0", *(f"{i + 1} {_row(p)}" for i, p in enumerate(mesh.points))]
    mat = mesh.cell_data.get("avsucd:material")
    out += [f"{i + 1} {int(mat[i, 0]) if mat is not None else 0} {names[t]} " + " ".join(str(x + 1) for x in n) for i, (t, n) in enumerate(mesh.cells)]
    if width:
        out += [f"{len(mesh.point_data)} " + " ".join(str(v.shape[1]) for v in mesh.point_data.values()), *(f"{k}, none" for k in mesh.point_data)]
        out += [f"{i + 1} " + " ".join(_row(v[i]) for v in mesh.point_data.values()) for i in range(len(mesh.points))]
    return _text(out)


def read_freefem(data: bytes) -> RawMesh:
    rows = list(_lines(data))
    n, m, b = (int(x) for x in rows[0][:3])
    points = [[float(x) for x in r[:2]] for r in rows[1 : 1 + n]]
    refs = [[float(r[2])] for r in rows[1 : 1 + n]]
    body = rows[1 + n : 1 + n + m + b]
    cells = [("triangle" if len(r) == 4 else "line", [int(x) - 1 for x in r[:-1]]) for r in body]
    return RawMesh(points, cells, {"freefem:ref": np.array(refs).reshape(-1, 1)}, {"freefem:ref": np.array([[float(r[-1])] for r in body]).reshape(-1, 1)})


def write_freefem(mesh: RawMesh) -> bytes:
    tri, lines = [n for t, n in mesh.cells if t == "triangle"], [n for t, n in mesh.cells if t == "line"]
    out = [f"{len(mesh.points)} {len(tri)} {len(lines)}", *(f"{_row(p[:2])} 0" for p in mesh.points)]
    return _text(out + [" ".join(str(x + 1) for x in n) + " 0" for n in tri + lines])


def read_dolfin(data: bytes) -> RawMesh:
    root = ET.fromstring(data)
    points = [[float(v.get(c, 0)) for c in "xyz"] for v in root.iter("vertex")]
    cells = []
    for tag in ("interval", "triangle", "tetrahedron"):
        kind, k = {"interval": ("line", 2), "triangle": ("triangle", 3), "tetrahedron": ("tetra", 4)}[tag]
        cells += [(kind, [int(e.get(f"v{i}")) for i in range(k)]) for e in root.iter(tag)]
    return RawMesh(points, cells)


def write_dolfin(mesh: RawMesh) -> bytes:
    kinds = {"line": "interval", "triangle": "triangle", "tetra": "tetrahedron"}
    kind = next(iter({kinds[t] for t, _ in mesh.cells}), "triangle")
    out = ['<?xml version="1.0"?>', f'<dolfin><mesh celltype="{kind}" dim="3">', f'<vertices size="{len(mesh.points)}">']
    out += [f'<vertex index="{i}" x="{_num(p[0])}" y="{_num(p[1])}" z="{_num(p[2])}"/>' for i, p in enumerate(mesh.points)]
    out += ["</vertices>", f'<cells size="{len(mesh.cells)}">']
    out += [f'<{kinds[t]} index="{i}" ' + " ".join(f'v{k}="{x}"' for k, x in enumerate(n)) + "/>" for i, (t, n) in enumerate(mesh.cells)]
    return _text([*out, "</cells></mesh></dolfin>"])


def read_wkt(data: bytes) -> RawMesh:
    """A TIN or a multipolygon; equal coordinates are one point."""
    place: dict[tuple[float, ...], int] = {}
    cells = []
    for ring in re.findall(r"\(\(\s*([^()]+)\)\)|\(\s*\(\s*([^()]+)\)", data.decode()):
        rows = [tuple(float(x) for x in p.split()) for p in (ring[0] or ring[1]).split(",")]
        nodes = [place.setdefault((*r, 0.0)[:3], len(place)) for r in rows[:-1]]
        cells.append((polygon(len(nodes)), nodes))
    return RawMesh(list(place), cells)


def write_wkt(mesh: RawMesh) -> bytes:
    rings = [", ".join(_row(mesh.points[i]) for i in [*n, n[0]]) for n in faces_of(mesh)]
    return _text(["TIN Z (" + ", ".join(f"(({r}))" for r in rings) + ")"])


def read_ugrid(data: bytes) -> RawMesh:
    words = data.split()
    n, tri, quad, tet, pyr, pri, hexa = (int(x) for x in words[:7])
    at = 7 + 3 * n
    points = np.array(words[7:at], float).reshape(n, 3)
    cells: list[tuple[str, list[int]]] = []

    def block(kind: str, count: int) -> None:
        nonlocal at
        k = TYPES[kind][1]
        rows = np.array(words[at : at + count * k], int).reshape(count, k) - 1
        at += count * k
        cells.extend((kind, r.tolist()) for r in rows)

    block("triangle", tri)
    block("quad", quad)
    tags = [float(x) for x in words[at : at + tri + quad]]
    at += tri + quad
    for kind, count in (("tetra", tet), ("pyramid", pyr), ("wedge", pri), ("hexahedron", hexa)):
        block(kind, count)
    tags += [0.0] * (len(cells) - len(tags))
    # its pyramids have the apex third
    cells = [(t, [n[0], n[3], n[4], n[1], n[2]] if t == "pyramid" else n) for t, n in cells]
    return RawMesh(points, cells, {}, {"ugrid:ref": np.array(tags).reshape(-1, 1)})


def write_ugrid(mesh: RawMesh) -> bytes:
    kinds = ("triangle", "quad", "tetra", "pyramid", "wedge", "hexahedron")
    by = {k: [n for t, n in mesh.cells if t == k] for k in kinds}
    out = [f"{len(mesh.points)} " + " ".join(str(len(by[k])) for k in kinds), *map(_row, mesh.points)]
    line = lambda n: " ".join(str(x + 1) for x in n)
    out += [line(n) for k in kinds[:2] for n in by[k]] + ["0"] * (len(by["triangle"]) + len(by["quad"]))
    for k in kinds[2:]:
        out += [line([n[0], n[3], n[4], n[1], n[2]] if k == "pyramid" else n) for n in by[k]]
    return _text(out)


def read_json(data: bytes) -> RawMesh:
    d = json.loads(data)
    arrays = lambda x: {k: np.array(v, float).reshape(len(v), -1) for k, v in x.items()}
    return RawMesh(d["points"], [(t, list(n)) for t, n in d["cells"]], arrays(d.get("point_data", {})), arrays(d.get("cell_data", {})), [tuple(r) for r in d.get("regions", [])])


def write_json(mesh: RawMesh) -> bytes:
    arrays = lambda x: {k: v.tolist() for k, v in x.items()}
    return json.dumps({"points": mesh.points.tolist(), "cells": mesh.cells, "point_data": arrays(mesh.point_data), "cell_data": arrays(mesh.cell_data), "regions": mesh.regions}).encode()


register("off", (".off",), read_off, write_off, (b"OFF", b"COFF", b"NOFF"))
register("obj", (".obj",), read_obj, write_obj)
register("xyz", (".xyz", ".pts", ".asc", ".txt", ".xyzn", ".xyzrgb"), read_xyz, write_xyz)
register("medit", (".mesh",), read_medit, write_medit, (b"MeshVersionFormatted",))
register("su2", (".su2",), read_su2, write_su2, (b"NDIME",))
register("gmsh", (".msh",), read_gmsh, write_gmsh, (b"$MeshFormat",))
register("freefem", (".msh",), read_freefem, write_freefem)
register("vtk", (".vtk",), read_vtk, write_vtk, (b"# vtk",))
register("vtu", (".vtu",), read_vtu, write_vtu)
register("abaqus", (".inp",), read_abaqus, write_abaqus, (b"*HEADING", b"*NODE"))
register("avsucd", (".avs", ".inp"), read_avsucd, write_avsucd)
register("nastran", (".bdf", ".fem", ".nas"), read_nastran, write_nastran, (b"BEGIN BULK", b"SOL "))
register("dolfin-xml", (".xml",), read_dolfin, write_dolfin)
register("wkt", (".wkt",), read_wkt, write_wkt, (b"TIN", b"MULTIPOLYGON"))
register("ugrid", (".ugrid",), read_ugrid, write_ugrid)
register("mesh-json", (".mesh.json",), read_json, write_json)
