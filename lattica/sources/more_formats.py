"""Further text formats."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np

from ..celltypes import TYPES
from .raw import RawMesh, register
from .text_formats import _lines, _num, _row, _text, polygon

# LS-DYNA keyword decks: fixed fields of 8 and 16, or commas

_DYNA = {"*ELEMENT_SHELL": None, "*ELEMENT_SOLID": None, "*ELEMENT_BEAM": "line"}


def _fields(line: str, widths: list[int]) -> list[str]:
    if "," in line:
        return [f.strip() for f in line.split(",")]
    out, at = [], 0
    for w in widths:
        out.append(line[at : at + w].strip())
        at += w
    return out


def read_lsdyna(data: bytes) -> RawMesh:
    ids, points, cells, parts, mode = [], [], [], [], ""
    for line in data.decode("utf-8", "replace").splitlines():
        if line.startswith("$") or not line.strip():
            continue
        if line.startswith("*"):
            mode = line.split()[0].upper()
        elif mode == "*NODE":
            f = _fields(line, [8, 16, 16, 16])
            ids.append(int(f[0]))
            points.append([float(x or 0) for x in (f[1:4] + ["", ""])[:3]])
        elif mode in _DYNA:
            f = [int(x) for x in _fields(line, [8] * 10) if x]
            nodes = list(dict.fromkeys(f[2:10]))
            kind = "line" if mode == "*ELEMENT_BEAM" else polygon(len(nodes)) if mode == "*ELEMENT_SHELL" else {4: "tetra", 5: "pyramid", 6: "wedge", 8: "hexahedron"}[len(nodes)]
            cells.append((kind, nodes[: 2 if kind == "line" else 8]))
            parts.append([float(f[1])])
    p = {v: k for k, v in enumerate(ids)}
    cells = [(t, [p[i] for i in n]) for t, n in cells]
    # a wedge is written as a hexahedron with two edges drawn together: 0 1 4 3 2 2 5 5
    cells = [(t, [n[0], n[1], n[4], n[3], n[2], n[5]] if t == "wedge" else n) for t, n in cells]
    return RawMesh(points, cells, {}, {"lsdyna:part": np.array(parts).reshape(-1, 1)})


def write_lsdyna(mesh: RawMesh) -> bytes:
    part = mesh.cell_data.get("lsdyna:part")
    out = ["*KEYWORD", "*NODE", *(f"{i + 1},{_num(p[0])},{_num(p[1])},{_num(p[2])}" for i, p in enumerate(mesh.points))]
    full = {"tetra": (0, 1, 2, 3, 3, 3, 3, 3), "pyramid": (0, 1, 2, 3, 4, 4, 4, 4), "wedge": (0, 1, 4, 3, 2, 2, 5, 5), "hexahedron": tuple(range(8)), "triangle": (0, 1, 2, 2), "quad": (0, 1, 2, 3), "line": (0, 1)}
    last = ""
    for i, (t, n) in enumerate(mesh.cells):
        head = {1: "*ELEMENT_BEAM", 2: "*ELEMENT_SHELL", 3: "*ELEMENT_SOLID"}[TYPES[t][0]]
        if head != last:
            out.append(head)
            last = head
        out.append(f"{i + 1},{int(part[i, 0]) if part is not None else 1}," + ",".join(str(n[k] + 1) for k in full[t]))
    return _text([*out, "*END"])


# Tecplot: one finite-element zone, point packing

_TEC = {"FETRIANGLE": "triangle", "FEQUADRILATERAL": "quad", "FETETRAHEDRON": "tetra", "FEBRICK": "hexahedron", "FELINESEG": "line", "TRIANGLE": "triangle", "QUADRILATERAL": "quad", "TETRAHEDRON": "tetra", "BRICK": "hexahedron"}


def read_tecplot(data: bytes) -> RawMesh:
    text = data.decode("utf-8", "replace")
    listed = re.search(r"VARIABLES\s*=(.*?)(?=\n\s*ZONE)", text, re.I | re.S)[1]
    names = re.findall(r'"([^"]*)"', listed) or re.findall(r"[^\s,]+", listed)
    zone = re.search(r"ZONE\b([^\n]*(?:\n[^\n]*=[^\n]*)*)\n", text, re.I)
    options = {k.upper(): v.strip().strip('"').upper() for k, v in re.findall(r'(\w+)\s*=\s*("[^"]*"|[^\s,]+)', zone[1])}
    n, m = int(options.get("N", options.get("NODES", 0))), int(options.get("E", options.get("ELEMENTS", 0)))
    kind = _TEC[options.get("ZONETYPE", options.get("ET", ""))]
    words = text[zone.end() :].split()
    k = len(names)
    if options.get("DATAPACKING", options.get("F", "POINT")).endswith("BLOCK"):
        table = np.array(words[: n * k], float).reshape(k, n).T
    else:
        table = np.array(words[: n * k], float).reshape(n, k)
    rows = np.array(words[n * k : n * k + m * TYPES[kind][1]], int).reshape(m, -1) - 1
    axes = [i for i, v in enumerate(names) if v.upper() in ("X", "Y", "Z")]
    extra = {v: table[:, i : i + 1] for i, v in enumerate(names) if i not in axes}
    return RawMesh(table[:, axes], [(kind, r.tolist()) for r in rows], extra)


def write_tecplot(mesh: RawMesh) -> bytes:
    kinds = {t for t, _ in mesh.cells}
    if len(kinds) != 1:
        raise ValueError("a zone holds cells of one type")
    kind = kinds.pop()
    name = next(k for k, v in _TEC.items() if v == kind)
    scalars = {k: v for k, v in mesh.point_data.items() if v.shape[1] == 1}
    head = ["VARIABLES = " + " ".join(f'"{v}"' for v in ("X", "Y", "Z", *scalars)), f"ZONE N={len(mesh.points)}, E={len(mesh.cells)}, DATAPACKING=POINT, ZONETYPE={name}"]
    rows = [_row([*p, *(v[i, 0] for v in scalars.values())]) for i, p in enumerate(mesh.points)]
    return _text(head + rows + [" ".join(str(x + 1) for x in n) for _, n in mesh.cells])


# MFEM 1.0

_MFEM = {0: "vertex", 1: "line", 2: "triangle", 3: "quad", 4: "tetra", 5: "hexahedron", 6: "wedge", 7: "pyramid"}


def read_mfem(data: bytes) -> RawMesh:
    rows = list(_lines(data))
    at = {r[0]: k for k, r in enumerate(rows) if r[0] in ("elements", "boundary", "vertices")}
    cells, tags = [], []
    for section in ("elements", "boundary"):
        k = at[section]
        for r in rows[k + 2 : k + 2 + int(rows[k + 1][0])]:
            tags.append([float(r[0])])
            cells.append((_MFEM[int(r[1])], [int(x) for x in r[2:]]))
    k = at["vertices"]
    n = int(rows[k + 1][0])
    return RawMesh([[float(x) for x in r] for r in rows[k + 3 : k + 3 + n]], cells, {}, {"mfem:attribute": np.array(tags).reshape(-1, 1)})


def write_mfem(mesh: RawMesh) -> bytes:
    number = {v: k for k, v in _MFEM.items()}
    top = max((TYPES[t][0] for t, _ in mesh.cells), default=0)
    line = lambda c: f"1 {number[c[0]]} " + " ".join(map(str, c[1]))
    body, rim = [c for c in mesh.cells if TYPES[c[0]][0] == top], [c for c in mesh.cells if TYPES[c[0]][0] < top]
    return _text(["MFEM mesh v1.0", "", "dimension", str(top), "", "elements", str(len(body)), *map(line, body), "", "boundary", str(len(rim)), *map(line, rim), "", "vertices", str(len(mesh.points)), "3", *map(_row, mesh.points)])


# Universal files: data sets 2411 (nodes) and 2412 (elements)

_UNV = {11: "line", 21: "line", 41: "triangle", 91: "triangle", 44: "quad", 94: "quad", 111: "tetra", 112: "wedge", 115: "hexahedron"}
_UNV_NUMBER = {"line": 11, "triangle": 91, "quad": 94, "tetra": 111, "wedge": 112, "hexahedron": 115}


def read_unv(data: bytes) -> RawMesh:
    lines = [l.split() for l in data.decode("latin-1").splitlines()]
    ids, points, cells = [], [], []
    at = 0
    while at < len(lines):
        if lines[at] == ["-1"] and at + 1 < len(lines) and lines[at + 1] != ["-1"] and len(lines[at + 1]) == 1:
            number = lines[at + 1][0]
            end = next(k for k in range(at + 2, len(lines)) if lines[k] == ["-1"])
            body = lines[at + 2 : end]
            if number == "2411":
                for head, xyz in zip(body[::2], body[1::2], strict=True):
                    ids.append(int(head[0]))
                    points.append([float(x.upper().replace("D", "E")) for x in xyz])
            elif number == "2412":
                k = 0
                while k < len(body):
                    code, n = int(body[k][1]), int(body[k][5])
                    k += 2 if code in (11, 21, 22, 24) else 1
                    nodes: list[int] = []
                    while len(nodes) < n:
                        nodes += [int(x) for x in body[k]]
                        k += 1
                    cells.append((_UNV[code], nodes))
            at = end
        at += 1
    p = {v: k for k, v in enumerate(ids)}
    return RawMesh(points, [(t, [p[i] for i in n]) for t, n in cells])


def write_unv(mesh: RawMesh) -> bytes:
    out = ["-1", "2411"]
    for i, p in enumerate(mesh.points):
        out += [f"{i + 1} 1 1 11", _row(p)]
    out += ["-1", "-1", "2412"]
    for i, (t, n) in enumerate(mesh.cells):
        out.append(f"{i + 1} {_UNV_NUMBER[t]} 1 1 7 {len(n)}")
        if t == "line":
            out.append("0 1 1")
        out.append(" ".join(str(x + 1) for x in n))
    return _text([*out, "-1"])


# XDMF with the data inline

_XDMF = {"polyvertex": "vertex", "polyline": "line", "triangle": "triangle", "quadrilateral": "quad", "tetrahedron": "tetra", "pyramid": "pyramid", "wedge": "wedge", "hexahedron": "hexahedron"}
_XDMF_NUMBER = {4: "triangle", 5: "quad", 6: "tetra", 7: "pyramid", 8: "wedge", 9: "hexahedron"}


def read_xdmf(data: bytes) -> RawMesh:
    grid = next(g for g in ET.fromstring(data).iter("Grid") if g.find("Topology") is not None)

    def item(e: ET.Element) -> np.ndarray:
        d = e.find("DataItem")
        if d.get("Format", "XML") != "XML":
            raise ValueError("data outside the file is not read")
        return np.array((d.text or "").split(), float).reshape([int(x) for x in d.get("Dimensions").split()])

    topology = grid.find("Topology")
    kind, con = topology.get("TopologyType").lower(), item(topology).astype(int)
    cells = []
    if kind == "mixed":
        flat, k = con.ravel().tolist(), 0
        while k < len(flat):
            t = _XDMF_NUMBER.get(flat[k])
            if t is None:
                k += 1
                t = "line" if flat[k - 1] == 2 else "vertex"
            n = TYPES[t][1]
            cells.append((t, flat[k + 1 : k + 1 + n]))
            k += 1 + n
    else:
        n = TYPES[_XDMF[kind]][1]
        cells = [(_XDMF[kind], r) for r in con.reshape(-1, n).tolist()]
    stores: dict[str, dict[str, np.ndarray]] = {"Node": {}, "Cell": {}}
    for a in grid.findall("Attribute"):
        v = item(a)
        stores.setdefault(a.get("Center", "Node"), {})[a.get("Name")] = v.reshape(len(v), -1)
    return RawMesh(item(grid.find("Geometry")), cells, stores["Node"], stores["Cell"])


def write_xdmf(mesh: RawMesh) -> bytes:
    number = {v: k for k, v in _XDMF_NUMBER.items()}
    flat: list[int] = []
    for t, n in mesh.cells:
        flat += [number[t], *n] if t in number else [2 if t == "line" else 1, len(n), *n]
    item = lambda text, dims, kind: f'<DataItem Format="XML" NumberType="{kind}" Dimensions="{dims}">{text}</DataItem>'
    body = [f'<Topology TopologyType="Mixed" NumberOfElements="{len(mesh.cells)}">' + item(" ".join(map(str, flat)), len(flat), "Int") + "</Topology>", '<Geometry GeometryType="XYZ">' + item(" ".join(map(_row, mesh.points)), f"{len(mesh.points)} 3", "Float") + "</Geometry>"]
    for centre, arrays in (("Node", mesh.point_data), ("Cell", mesh.cell_data)):
        body += [f'<Attribute Name="{k}" Center="{centre}">' + item(" ".join(map(_row, v)), f"{v.shape[0]} {v.shape[1]}", "Float") + "</Attribute>" for k, v in arrays.items()]
    return _text(['<?xml version="1.0"?>', '<Xdmf Version="3.0"><Domain><Grid Name="mesh">', *body, "</Grid></Domain></Xdmf>"])


register("lsdyna", (".k", ".key", ".dyn"), read_lsdyna, write_lsdyna, (b"*KEYWORD",))
register("tecplot", (".dat", ".tec"), read_tecplot, write_tecplot, (b"VARIABLES", b"TITLE"))
register("mfem", (".mesh",), read_mfem, write_mfem, (b"MFEM",))
register("unv", (".unv", ".unv2"), read_unv, write_unv)
register("xdmf", (".xdmf", ".xmf"), read_xdmf, write_xdmf)
