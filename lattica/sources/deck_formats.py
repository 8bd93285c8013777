"""Text decks of solvers and mesh generators, and the formats of viewers; readers from bytes, writers to bytes."""

from __future__ import annotations

import base64
import json
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from io import BytesIO

import numpy as np

from .raw import RawMesh, register
from .text_formats import _lines, _row, _text, faces_of, polygon


def _numbered(points: dict[int, list[float]]) -> tuple[np.ndarray, dict[int, int]]:
    """Places in the order of their numbers, and the place of each number."""
    ids = sorted(points)
    return np.array([points[i] for i in ids], float).reshape(-1, 3), {v: k for k, v in enumerate(ids)}


def _regions(names: list[str]) -> list[tuple[str, str, int, list[int]]]:
    """A cell region for each name, in the order in which they come."""
    out: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        out.setdefault(name, []).append(k)
    return [("cell", n, t, e) for t, (n, e) in enumerate(out.items(), 1)]


# Netgen: volume elements, surface elements, points; numbers from 1

NETGEN = {1: "vertex", 2: "line", 3: "triangle", 4: "quad", 6: "triangle6", 8: "quad8"}
NETGEN_SOLID = {4: "tetra", 5: "pyramid", 6: "wedge", 8: "hexahedron", 10: "tetra10"}


def read_netgen(data: bytes) -> RawMesh:
    lines = list(_lines(data))
    at, solids, faces, points, tags = 0, [], [], [], []
    while at < len(lines):
        head = lines[at][0]
        at += 1
        if head == "volumeelements":
            n = int(lines[at][0])
            for r in lines[at + 1 : at + 1 + n]:
                k = int(r[1])
                solids.append((NETGEN_SOLID[k], [int(v) - 1 for v in r[2 : 2 + k]]))
                tags.append(int(r[0]))
            at += 1 + n
        elif head.startswith("surfaceelements"):
            n = int(lines[at][0])
            for r in lines[at + 1 : at + 1 + n]:
                k = int(r[4])
                faces.append((NETGEN[k], [int(v) - 1 for v in r[5 : 5 + k]]))
            at += 1 + n
        elif head == "points":
            n = int(lines[at][0])
            points = [[float(v) for v in r[:3]] for r in lines[at + 1 : at + 1 + n]]
            at += 1 + n
    # Netgen winds tetrahedra the other way round
    turned = [(t, [n[0], n[2], n[1], n[3]] if t == "tetra" else n) for t, n in solids]
    return RawMesh(np.array(points, float).reshape(-1, 3), turned + faces, {}, {}, _regions([f"volume_{t}" for t in tags]))


def write_netgen(mesh: RawMesh) -> bytes:
    size = {v: k for k, v in NETGEN_SOLID.items()}
    flat = {v: k for k, v in NETGEN.items()}
    solids = [(t, n) for t, n in mesh.cells if t in size]
    faces = [(t, n) for t, n in mesh.cells if t in ("triangle", "quad", "triangle6", "quad8")]
    one = lambda n: " ".join(str(i + 1) for i in n)
    out = ["mesh3d", "dimension", "3", "geomtype", "0", "surfaceelements", str(len(faces)), *(f"1 1 0 0 {flat[t]} {one(n)}" for t, n in faces)]
    out += ["volumeelements", str(len(solids)), *(f"1 {size[t]} {one([n[0], n[2], n[1], n[3]] if t == 'tetra' else n)}" for t, n in solids)]
    return _text([*out, "points", str(len(mesh.points)), *map(_row, mesh.points), "endmesh"])


# FLAC3D: G number x y z, Z type number nodes, ZGROUP

FLAC = {"T4": "tetra", "P5": "pyramid", "W6": "wedge", "B8": "hexahedron", "T3": "triangle", "Q4": "quad"}
#: Node order of a zone by the order of ours.
FLAC_ORDER = {"tetra": (0, 1, 2, 3), "pyramid": (0, 1, 3, 4, 2), "wedge": (0, 1, 3, 2, 4, 5), "hexahedron": (0, 1, 3, 4, 2, 7, 5, 6), "triangle": (0, 1, 2), "quad": (0, 1, 2, 3)}


def read_flac3d(data: bytes) -> RawMesh:
    points: dict[int, list[float]] = {}
    cells, numbers, groups = [], [], []
    name: tuple[str, list[int]] | None = None
    for r in _lines(data, "*"):
        if r[0] == "G":
            points[int(r[1])] = [float(v) for v in r[2:5]]
        elif r[0] in ("Z", "F"):
            kind = FLAC[r[1]]
            own = [int(v) for v in r[3:]]
            order = FLAC_ORDER[kind]
            cells.append((kind, [own[order.index(k)] for k in range(len(order))]))
            numbers.append((r[0], int(r[2])))
        elif r[0] in ("ZGROUP", "FGROUP"):
            name = (r[0][0], [])
            groups.append((r[1].strip('"'), name))
        elif name is not None:
            name[1].extend(int(v) for v in r if v.isdigit())
    p, place = _numbered(points)
    at = {v: k for k, v in enumerate(numbers)}
    regions = [("cell", n, t, [at[(kind, v)] for v in own if (kind, v) in at]) for t, (n, (kind, own)) in enumerate(groups, 1)]
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells], {}, {}, regions)


def write_flac3d(mesh: RawMesh) -> bytes:
    name = {v: k for k, v in FLAC.items()}
    out = ["* FLAC3D grid", *(f"G {k} {_row(p)}" for k, p in enumerate(mesh.points, 1))]
    for k, (t, n) in enumerate(mesh.cells, 1):
        out.append(f"{'F' if t in ('triangle', 'quad') else 'Z'} {name[t]} {k} " + " ".join(str(n[i] + 1) for i in FLAC_ORDER[t]))
    return _text(out)


# MDPA: Begin Nodes, Begin Elements name, Begin Conditions name; the size of the name tells the type

MDPA = {("Line", 2): "line", ("Triangle", 3): "triangle", ("Quadrilateral", 4): "quad", ("Tetrahedra", 4): "tetra", ("Prism", 6): "wedge", ("Hexahedra", 8): "hexahedron", ("Pyramid", 5): "pyramid"}


def read_mdpa(data: bytes) -> RawMesh:
    points: dict[int, list[float]] = {}
    cells, groups, block, kind = [], [], "", ""
    for r in _lines(data, "//"):
        if r[0] == "Begin":
            block, kind = r[1], r[2] if len(r) > 2 else ""
        elif r[0] == "End":
            block = ""
        elif block == "Nodes":
            points[int(r[0])] = [float(v) for v in r[1:4]]
        elif block in ("Elements", "Conditions", "Geometries"):
            own = [int(v) for v in (r[1:] if block == "Geometries" else r[2:])]
            name = next((t for (word, n), t in MDPA.items() if n == len(own) and word.lower()[:4] in kind.lower()), None)
            if name is None:
                three = "3D" in kind or block == "Geometries"
                name = {1: "vertex", 2: "line", 3: "triangle", 4: "tetra" if three and block == "Elements" else "quad", 5: "pyramid", 6: "wedge", 8: "hexahedron"}[len(own)]
            cells.append((name, own))
            groups.append(kind or block)
    p, place = _numbered(points)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells], {}, {}, _regions(groups))


def write_mdpa(mesh: RawMesh) -> bytes:
    word = {v: f"{k[0]}3D{k[1]}" for k, v in MDPA.items()}
    out = ["Begin ModelPartData", "End ModelPartData", "", "Begin Properties 0", "End Properties", "", "Begin Nodes", *(f"{k} {_row(p)}" for k, p in enumerate(mesh.points, 1)), "End Nodes"]
    last = None
    for k, (t, n) in enumerate(mesh.cells, 1):
        if t != last:
            out += [*(["End Elements"] if last else []), "", f"Begin Elements {word[t]}"]
            last = t
        out.append(f"{k} 0 " + " ".join(str(i + 1) for i in n))
    return _text([*out, *(["End Elements"] if last else [])])


# Z88: counts, points with their freedoms, elements in two lines

Z88 = {1: ("hexahedron", 8), 2: ("line", 2), 3: ("triangle6", 6), 4: ("line", 2), 5: ("line", 2), 7: ("quad8", 8), 10: ("hexahedron20", 20), 16: ("tetra10", 10), 17: ("tetra", 4), 14: ("triangle6", 6), 20: ("quad8", 8)}
Z88_NUMBER = {"hexahedron": 1, "line": 4, "triangle6": 14, "quad8": 20, "hexahedron20": 10, "tetra10": 16, "tetra": 17}


def read_z88(data: bytes) -> RawMesh:
    lines = list(_lines(data, "#"))
    n, m = int(lines[0][1]), int(lines[0][2])
    points = {int(r[0]): [float(v) for v in r[2:5]] for r in lines[1 : 1 + n]}
    p, place = _numbered(points)
    cells = []
    for k in range(m):
        head, own = lines[1 + n + 2 * k], lines[2 + n + 2 * k]
        kind, size = Z88[int(head[1])]
        cells.append((kind, [place[int(v)] for v in own[:size]]))
    return RawMesh(p, cells)


def write_z88(mesh: RawMesh) -> bytes:
    out = [f"3 {len(mesh.points)} {len(mesh.cells)} {3 * len(mesh.points)} 0", *(f"{k} 3 {_row(p)}" for k, p in enumerate(mesh.points, 1))]
    for k, (t, n) in enumerate(mesh.cells, 1):
        out += [f"{k} {Z88_NUMBER[t]}", " ".join(str(i + 1) for i in n)]
    return _text(out)


# CalculiX results: 2C nodes, 3C elements; fixed columns

FRD = {1: "hexahedron", 2: "wedge", 3: "tetra", 4: "hexahedron20", 5: "wedge15", 6: "tetra10", 7: "triangle", 8: "triangle6", 9: "quad", 10: "quad8", 11: "line", 12: "line3"}


def read_frd(data: bytes) -> RawMesh:
    """Nodes and elements, and the last step of every nodal result."""
    points: dict[int, list[float]] = {}
    raw, block, name, results, parts = [], "", "", {}, 0
    for line in data.decode("latin-1").splitlines():
        key = line[:6].strip()
        if key.startswith("2C"):
            block = "2C"
        elif key.startswith("3C"):
            block = "3C"
        elif line[:5].strip() == "-4":
            block, name, parts = "R", line[5:13].strip(), 0
            results[name] = {}
        elif line[:5].strip() == "-5" and block == "R":
            parts += 1
        elif line[:3] == " -3":
            block = ""
        elif line[:3] == " -1":
            if block == "2C":
                points[int(line[3:13])] = [float(line[13 + 12 * k : 25 + 12 * k]) for k in range(3)]
            elif block == "3C":
                raw.append((FRD[int(line[13:18])], []))
            elif block == "R":
                body = line[13:]
                results[name][int(line[3:13])] = [float(body[k : k + 12]) for k in range(0, len(body.rstrip()), 12)]
        elif line[:3] == " -2" and block == "3C":
            raw[-1][1].extend(int(v) for v in line[3:].split())
    p, place = _numbered(points)
    ids = sorted(points)
    data_ = {}
    for name, rows in results.items():
        width = max((len(v) for v in rows.values()), default=0)
        data_[name] = np.array([(rows.get(i, []) + [np.nan] * width)[:width] for i in ids], float).reshape(len(ids), width)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in raw], {k: v for k, v in data_.items() if v.size})


def write_frd(mesh: RawMesh) -> bytes:
    number = {v: k for k, v in FRD.items()}
    out = ["    1C", f"    2C{len(mesh.points):30d}{'1':>38}"]
    out += [f" -1{k:10d}" + "".join(f"{v:12.5E}" for v in p) for k, p in enumerate(mesh.points, 1)]
    out += [" -3", f"    3C{len(mesh.cells):30d}{'1':>38}"]
    for k, (t, n) in enumerate(mesh.cells, 1):
        out.append(f" -1{k:10d}{number[t]:5d}{0:5d}{1:5d}")
        for lo in range(0, len(n), 10):
            out.append(" -2" + "".join(f"{i + 1:10d}" for i in n[lo : lo + 10]))
    return _text([*out, " -3", " 9999"])


# Patran neutral: packets of a header card and its lines

PATRAN = {2: {2: "line", 3: "line3"}, 3: {3: "triangle", 6: "triangle6"}, 4: {4: "quad", 8: "quad8"}, 5: {4: "tetra", 10: "tetra10"}, 7: {6: "wedge", 15: "wedge15"}, 8: {8: "hexahedron", 20: "hexahedron20"}}


def read_patran(data: bytes) -> RawMesh:
    lines = data.decode("latin-1").splitlines()
    points: dict[int, list[float]] = {}
    cells, at = [], 0
    while at < len(lines):
        head = lines[at].split()
        if not head:
            at += 1
            continue
        packet, number, shape, cards = (int(v) for v in (head + ["0"] * 4)[:4])
        body = lines[at + 1 : at + 1 + cards]
        if packet == 99:
            break
        if packet == 1:
            points[number] = [float(body[0][16 * k : 16 * k + 16]) for k in range(3)]
        elif packet == 2:
            count = int(body[0].split()[0])
            own = [int(v) for line in body[1:] for v in line.split()][:count]
            cells.append((PATRAN[shape][count], own))
        at += 1 + cards
    p, place = _numbered(points)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells])


def write_patran(mesh: RawMesh) -> bytes:
    shape = {t: (s, n) for s, sizes in PATRAN.items() for n, t in sizes.items()}
    card = lambda *v: "".join(f"{x:8d}" for x in v)
    out = ["25" + card(0, 0, 1)[2:], "lattica", "26" + card(0, 0, 1)[2:], "lattica"]
    for k, p in enumerate(mesh.points, 1):
        out += [f"{1:2d}{k:8d}{0:8d}{2:8d}", "".join(f"{v:16.9E}" for v in p), "0G       6       0       0  000000"]
    for k, (t, n) in enumerate(mesh.cells, 1):
        s, size = shape[t]
        rows = [n[lo : lo + 10] for lo in range(0, size, 10)]
        out += [f"{2:2d}{k:8d}{s:8d}{1 + len(rows):8d}", f"{size:8d}{0:8d}{1:8d}", *(card(*(i + 1 for i in r)) for r in rows)]
    return _text([*out, f"{99:2d}{0:8d}{0:8d}{1:8d}"])


# ANSYS archives: NBLOCK and EBLOCK in fixed columns

def read_cdb(data: bytes) -> RawMesh:
    """Nodes, solid and shell elements (repeated nodes tell wedges, pyramids, tetrahedra and triangles), and components."""
    lines = data.decode("latin-1").splitlines()
    points: dict[int, list[float]] = {}
    raw, numbers, sets, at = [], [], {}, 0

    def shape(n: list[int]) -> tuple[str, list[int]] | None:
        own = list(dict.fromkeys(n))
        if len(n) >= 8 and len(own) <= 8:
            # degenerate bricks: i j k k m m m m is a tetrahedron, i j k l m m m m a pyramid, i j k k m n o o a wedge
            return {8: ("hexahedron", own), 4: ("tetra", own), 5: ("pyramid", own), 6: ("wedge", own)}.get(len(own))
        return {2: ("line", own), 3: ("triangle", own), 4: ("quad", own), 10: ("tetra10", own), 15: ("wedge15", own), 20: ("hexahedron20", own)}.get(len(own))

    while at < len(lines):
        line = lines[at].strip()
        up = line.upper()
        if up.startswith("NBLOCK"):
            form = re.search(r"([0-9]*)i([0-9]+),[0-9]*[eg]([0-9]+)", lines[at + 1].lower())
            count, ints, width = (int(form[1] or 3), int(form[2]), int(form[3])) if form else (3, 8, 16)
            at += 2
            while at < len(lines) and not lines[at].strip().startswith(("N,R5", "-1")):
                own, rest = int(lines[at][:ints]), lines[at][ints * count :]
                v = [rest[k * width : (k + 1) * width].strip() for k in range(3)]
                points[own] = [float(x) if x else 0.0 for x in v]
                at += 1
        elif up.startswith("EBLOCK"):
            at += 2
            while at < len(lines) and not lines[at].strip().startswith("-1"):
                r = [int(v) for v in lines[at].split()]
                count, nodes = r[8], r[11:]
                while len(nodes) < count:
                    at += 1
                    nodes += [int(v) for v in lines[at].split()]
                if (found := shape(nodes[:count])) is not None:
                    raw.append(found)
                    numbers.append(r[10])
                at += 1
        elif up.startswith("CMBLOCK"):
            parts = [w.strip() for w in line.split(",")]
            own: list[int] = []
            at += 2
            while at < len(lines) and len(own) < int(parts[3].split("!")[0]):
                own += [int(v) for v in lines[at].split()]
                at += 1
            full: list[int] = []
            for v in own:
                full += range(full[-1] + 1, -v + 1) if v < 0 else [v]
            sets[parts[1]] = ("cell" if parts[2].upper().startswith("ELEM") else "point", full)
            continue
        at += 1
    p, place = _numbered(points)
    where = {v: k for k, v in enumerate(numbers)}
    regions = [(kind, name, t, [(where if kind == "cell" else place)[v] for v in own if v in (where if kind == "cell" else place)]) for t, (name, (kind, own)) in enumerate(sets.items(), 1)]
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in raw], {}, {}, regions)


def write_cdb(mesh: RawMesh) -> bytes:
    full = {"hexahedron": (0, 1, 2, 3, 4, 5, 6, 7), "tetra": (0, 1, 2, 2, 3, 3, 3, 3), "pyramid": (0, 1, 2, 3, 4, 4, 4, 4), "wedge": (0, 1, 2, 2, 3, 4, 5, 5)}
    out = ["/PREP7", f"NBLOCK,6,SOLID,{len(mesh.points)},{len(mesh.points)}", "(3i9,6e21.13e3)"]
    out += [f"{k:9d}{0:9d}{0:9d}" + "".join(f"{v:21.13E}" for v in p) for k, p in enumerate(mesh.points, 1)]
    out += ["N,R5.3,LOC,       -1,", f"EBLOCK,19,SOLID,{len(mesh.cells)},{len(mesh.cells)}", "(19i9)"]
    for k, (t, n) in enumerate(mesh.cells, 1):
        own = [n[i] + 1 for i in full.get(t, range(len(n)))]
        out.append("".join(f"{v:9d}" for v in (1, 1, 1, 1, 0, 0, 0, 0, len(own), 0, k, *own[:8])))
        if own[8:]:
            out.append("".join(f"{v:9d}" for v in own[8:]))
    return _text([*out, "       -1", "FINISH"])


# Radioss starter: /NODE, /BRICK, /TETRA4, /SHELL, /SH3N

RADIOSS = {"/BRICK": ("hexahedron", 8), "/TETRA4": ("tetra", 4), "/TETRA10": ("tetra10", 10), "/SHELL": ("quad", 4), "/SH3N": ("triangle", 3), "/PENTA6": ("wedge", 6), "/TRUSS": ("line", 2), "/BEAM": ("line", 2)}


def read_radioss(data: bytes) -> RawMesh:
    points: dict[int, list[float]] = {}
    cells, names, block, pending = [], [], "", []
    for line in data.decode("latin-1").splitlines():
        if not line.strip() or line[0] in "#$":
            continue
        if line.startswith("/"):
            block, pending = line.strip(), []
            continue
        key = "/" + block.split("/")[1] if block.count("/") else ""
        r = line.split()
        if key == "/NODE":
            points[int(r[0])] = [float(v) for v in r[1:4]]
        elif key in RADIOSS:
            kind, size = RADIOSS[key]
            pending += [int(v) for v in r]
            if len(pending) > size:
                cells.append((kind, pending[1 : 1 + size]))
                names.append("part_" + block.split("/")[2] if block.count("/") > 1 else "part")
                pending = []
    p, place = _numbered(points)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells], {}, {}, _regions(names))


def write_radioss(mesh: RawMesh) -> bytes:
    key = {}
    for k, (t, _) in RADIOSS.items():
        key.setdefault(t, k)
    out = ["#RADIOSS STARTER", "/NODE", *(f"{k:10d}" + "".join(f"{v:20.12E}" for v in p) for k, p in enumerate(mesh.points, 1))]
    last = None
    for k, (t, n) in enumerate(mesh.cells, 1):
        if t != last:
            out.append(f"{key[t]}/1")
            last = t
        out.append(f"{k:10d}" + "".join(f"{i + 1:10d}" for i in n))
    return _text([*out, "/END"])


# GiD: MESH ... ElemType, Coordinates, Elements

GID = {("Linear", 2): "line", ("Triangle", 3): "triangle", ("Triangle", 6): "triangle6", ("Quadrilateral", 4): "quad", ("Quadrilateral", 8): "quad8", ("Tetrahedra", 4): "tetra", ("Tetrahedra", 10): "tetra10", ("Hexahedra", 8): "hexahedron", ("Hexahedra", 20): "hexahedron20", ("Prism", 6): "wedge", ("Pyramid", 5): "pyramid", ("Point", 1): "vertex"}


def read_gid(data: bytes) -> RawMesh:
    points: dict[int, list[float]] = {}
    cells, names, block, kind, name = [], [], "", "", ""
    for r in _lines(data):
        low = [w.lower() for w in r]
        if low[0] == "mesh":
            at = low.index("elemtype")
            kind = next(t for (word, n), t in GID.items() if word.lower() == low[at + 1] and n == int(r[low.index("nnode") + 1]))
            name = r[1].strip('"') if low[1] != "dimension" else kind
        elif low[0] in ("coordinates", "elements"):
            block = low[0]
        elif low[0] == "end":
            block = ""
        elif block == "coordinates":
            points[int(r[0])] = ([float(v) for v in r[1:4]] + [0.0, 0.0])[:3]
        elif block == "elements":
            size = next(n for (_, n), t in GID.items() if t == kind)
            cells.append((kind, [int(v) for v in r[1 : 1 + size]]))
            names.append(name)
    p, place = _numbered(points)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells], {}, {}, _regions(names))


def write_gid(mesh: RawMesh) -> bytes:
    word = {t: k for k, t in GID.items()}
    out, first = [], True
    for kind in dict.fromkeys(t for t, _ in mesh.cells):
        name, size = word[kind]
        out += [f'MESH "{kind}" dimension 3 ElemType {name} Nnode {size}', "Coordinates", *((f"{k} {_row(p)}" for k, p in enumerate(mesh.points, 1)) if first else ()), "End Coordinates", "Elements"]
        out += [f"{k} " + " ".join(str(i + 1) for i in n) for k, (t, n) in enumerate(mesh.cells, 1) if t == kind]
        out.append("End Elements")
        first = False
    return _text(out)


# PERMAS: $COOR, $ELEMENT TYPE = ...

PERMAS = {"PLOT1": "vertex", "FLA2": "line", "PLOTL2": "line", "BECOC": "line", "TRIA3": "triangle", "TRIM3": "triangle", "TRIA6": "triangle6", "QUAD4": "quad", "QUAMS4": "quad", "QUAM8": "quad8", "TET4": "tetra", "TET10": "tetra10", "PENTA6": "wedge", "HEXE8": "hexahedron", "HEXE20": "hexahedron20", "PYRA5": "pyramid"}


def read_permas(data: bytes) -> RawMesh:
    points: dict[int, list[float]] = {}
    cells, block, kind = [], "", ""
    for line in data.decode("latin-1").splitlines():
        line = line.split("!", 1)[0].strip()
        if not line:
            continue
        if line.startswith("$"):
            block = line.split()[0].upper()
            if block == "$ELEMENT":
                kind = PERMAS[line.split("=")[1].split()[0].strip().upper()]
        elif block == "$COOR":
            r = line.split()
            points[int(r[0])] = [float(v) for v in r[1:4]]
        elif block == "$ELEMENT":
            cells.append((kind, [int(v) for v in line.split()[1:]]))
    p, place = _numbered(points)
    return RawMesh(p, [(t, [place[i] for i in n]) for t, n in cells])


def write_permas(mesh: RawMesh) -> bytes:
    name = {}
    for k, t in PERMAS.items():
        name.setdefault(t, k)
    out = ["$ENTER COMPONENT NAME = DFLT_COMP", "$STRUCTURE", "$COOR", *(f"{k} {_row(p)}" for k, p in enumerate(mesh.points, 1))]
    for kind in dict.fromkeys(t for t, _ in mesh.cells):
        out += [f"$ELEMENT TYPE = {name[kind]}", *(f"{k} " + " ".join(str(i + 1) for i in n) for k, (t, n) in enumerate(mesh.cells, 1) if t == kind)]
    return _text([*out, "$END STRUCTURE", "$EXIT COMPONENT", "$FIN"])


# Viewers: glTF, 3MF, DXF, SVG, TikZ

GLTF = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def _gltf(doc: dict, binary: bytes | None) -> RawMesh:
    def buffer(k: int) -> bytes:
        uri = doc["buffers"][k].get("uri")
        if uri is None:
            return binary or b""
        if not uri.startswith("data:"):
            raise ValueError("buffers in other files are not read")
        return base64.b64decode(uri.split(",", 1)[1])

    def accessor(k: int) -> np.ndarray:
        a = doc["accessors"][k]
        dtype, width = np.dtype(GLTF[a["componentType"]]), WIDTH[a["type"]]
        view = doc["bufferViews"][a["bufferView"]]
        at, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or width * dtype.itemsize
        data = buffer(view["buffer"])
        rows = [np.frombuffer(data, dtype, width, at + i * stride) for i in range(a["count"])] if stride != width * dtype.itemsize else [np.frombuffer(data, dtype, width * a["count"], at)]
        return np.concatenate(rows).reshape(-1, width) if rows else np.zeros((0, width))

    def matrix(node: dict) -> np.ndarray:
        if "matrix" in node:
            return np.array(node["matrix"], float).reshape(4, 4).T
        x, y, z, w = node.get("rotation", [0, 0, 0, 1])
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = r * np.array(node.get("scale", [1, 1, 1])), node.get("translation", [0, 0, 0])
        return out

    points, cells, names, base = [], [], [], 0

    def primitive(p: dict, m: np.ndarray, name: str) -> None:
        nonlocal base
        v = accessor(p["attributes"]["POSITION"]).astype(float) @ m[:3, :3].T + m[:3, 3]
        ids = accessor(p["indices"]).ravel().astype(int).tolist() if "indices" in p else list(range(len(v)))
        mode = p.get("mode", 4)
        if mode == 0:
            own = [("vertex", [i]) for i in ids]
        elif mode == 1:
            own = [("line", ids[k : k + 2]) for k in range(0, len(ids) - 1, 2)]
        elif mode in (2, 3):
            own = [("line", list(e)) for e in zip(ids, ids[1:] + (ids[:1] if mode == 2 else []), strict=False)]
        elif mode == 4:
            own = [("triangle", ids[k : k + 3]) for k in range(0, len(ids) - 2, 3)]
        elif mode == 5:
            own = [("triangle", ids[k : k + 3] if k % 2 == 0 else [ids[k + 1], ids[k], ids[k + 2]]) for k in range(len(ids) - 2)]
        else:
            own = [("triangle", [ids[0], ids[k], ids[k + 1]]) for k in range(1, len(ids) - 1)]
        cells.extend((t, [i + base for i in n]) for t, n in own)
        names.extend([name] * len(own))
        points.append(v)
        base += len(v)

    def walk(k: int, above: np.ndarray) -> None:
        node = doc["nodes"][k]
        m = above @ matrix(node)
        if "mesh" in node:
            held = doc["meshes"][node["mesh"]]
            for p in held["primitives"]:
                primitive(p, m, held.get("name", f"mesh_{node['mesh']}"))
        for child in node.get("children", []):
            walk(child, m)

    if "scenes" in doc:
        for k in doc["scenes"][doc.get("scene", 0)].get("nodes", []):
            walk(k, np.eye(4))
    else:
        for k, held in enumerate(doc.get("meshes", [])):
            for p in held["primitives"]:
                primitive(p, np.eye(4), held.get("name", f"mesh_{k}"))
    return RawMesh(np.concatenate(points) if points else np.zeros((0, 3)), cells, {}, {}, _regions(names))


def read_gltf(data: bytes) -> RawMesh:
    """glTF 2 as JSON with embedded buffers, or as one binary file; the nodes' transforms are applied."""
    if data[:4] != b"glTF":
        return _gltf(json.loads(data), None)
    at, doc, binary = 12, {}, None
    while at < len(data):
        size, kind = struct.unpack("<II", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == 0x4E4F534A:
            doc = json.loads(body)
        elif kind == 0x004E4942:
            binary = body
        at += 8 + size
    return _gltf(doc, binary)


def write_glb(mesh: RawMesh) -> bytes:
    """Faces as triangles in one binary file."""
    faces = [[n[0], n[k], n[k + 1]] for n in faces_of(mesh) for k in range(1, len(n) - 1)]
    p, i = mesh.points.astype("<f4"), np.array(faces, "<u4").ravel()
    body = p.tobytes() + i.tobytes()
    doc = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}]}],
        "buffers": [{"byteLength": len(body)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": p.nbytes}, {"buffer": 0, "byteOffset": p.nbytes, "byteLength": i.nbytes}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(0).tolist() if len(p) else [0, 0, 0], "max": p.max(0).tolist() if len(p) else [0, 0, 0]},
            {"bufferView": 1, "componentType": 5125, "count": len(i), "type": "SCALAR"},
        ],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body
    return struct.pack("<III", 0x46546C67, 2, 12 + len(chunks)) + chunks


_3MF = "{http://schemas.microsoft.com/3dmanufacturing/core/2015/02}"


def read_3mf(data: bytes) -> RawMesh:
    """The objects of a 3MF package that are built, each a region, with their transforms; components are followed."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(".model"))
        root = ET.fromstring(z.read(name))
    objects = {o.get("id"): o for o in root.iter(f"{_3MF}object")}
    points, cells, names, base = [], [], [], 0

    def matrix(text: str | None) -> np.ndarray:
        out = np.eye(4)
        if text:
            out[:, :3] = np.array(text.split(), float).reshape(4, 3)
        return out  # rows multiply from the left

    def add(key: str, m: np.ndarray) -> None:
        nonlocal base
        o = objects[key]
        if (held := o.find(f"{_3MF}mesh")) is not None:
            v = np.array([[float(p.get(c)) for c in "xyz"] for p in held.iter(f"{_3MF}vertex")]).reshape(-1, 3)
            own = [[int(t.get(k)) + base for k in ("v1", "v2", "v3")] for t in held.iter(f"{_3MF}triangle")]
            points.append(v @ m[:3, :3] + m[3, :3])
            cells.extend(("triangle", n) for n in own)
            names.extend([o.get("name") or f"object_{key}"] * len(own))
            base += len(v)
        for c in o.iter(f"{_3MF}component"):
            add(c.get("objectid"), matrix(c.get("transform")) @ m)

    for item in root.iter(f"{_3MF}item"):
        add(item.get("objectid"), matrix(item.get("transform")))
    return RawMesh(np.concatenate(points) if points else np.zeros((0, 3)), cells, {}, {}, _regions(names))


def write_3mf(mesh: RawMesh) -> bytes:
    faces = [[n[0], n[k], n[k + 1]] for n in faces_of(mesh) for k in range(1, len(n) - 1)]
    v = "".join(f'<vertex x="{x!r}" y="{y!r}" z="{z!r}"/>' for x, y, z in mesh.points.tolist())
    t = "".join(f'<triangle v1="{a}" v2="{b}" v3="{c}"/>' for a, b, c in faces)
    model = f'<?xml version="1.0"?><model unit="millimeter" xmlns="{_3MF[1:-1]}"><resources><object id="1" type="model"><mesh><vertices>{v}</vertices><triangles>{t}</triangles></mesh></object></resources><build><item objectid="1"/></build></model>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>')
        z.writestr("3D/3dmodel.model", model)
    return out.getvalue()


def read_dxf(data: bytes) -> RawMesh:
    """3DFACE, LINE, POINT and LWPOLYLINE entities of ASCII files; equal corners are one point, layers are regions."""
    words = [w.strip() for w in data.decode("latin-1").splitlines()]
    pairs = list(zip(words[::2], words[1::2], strict=False))
    place: dict[tuple[float, ...], int] = {}
    cells, names = [], []
    node = lambda p: place.setdefault(tuple(p), len(place))
    start = next((k for k, (c, v) in enumerate(pairs) if c == "2" and v == "ENTITIES"), len(pairs))
    k = start + 1
    while k < len(pairs) and pairs[k][1] != "ENDSEC":
        kind, own = pairs[k][1], []
        k += 1
        while k < len(pairs) and pairs[k][0] != "0":
            own.append(pairs[k])
            k += 1
        last = dict(own)
        layer = last.get("8", "0")
        at = lambda i: [float(last.get(f"{c}{i}", 0)) for c in "123"]
        made: list[tuple[str, list[int]]] = []
        if kind == "3DFACE":
            ring = list(dict.fromkeys(node(at(i)) for i in range(4)))
            made = [(polygon(len(ring)), ring)]
        elif kind == "LINE":
            made = [("line", [node(at(0)), node(at(1))])]
        elif kind == "POINT":
            made = [("vertex", [node(at(0))])]
        elif kind == "LWPOLYLINE":
            xs, ys = ([float(v) for c, v in own if c == code] for code in ("10", "20"))
            ids = [node([x, y, float(last.get("38", 0))]) for x, y in zip(xs, ys, strict=True)]
            made = [("line", list(e)) for e in zip(ids, ids[1:] + (ids[:1] if int(last.get("70", 0)) & 1 else []), strict=False)]
        cells += made
        names += [layer] * len(made)
    return RawMesh(np.array(list(place), float).reshape(-1, 3), cells, {}, {}, _regions(names))


def write_dxf(mesh: RawMesh) -> bytes:
    out = ["0", "SECTION", "2", "ENTITIES"]
    for t, n in mesh.cells:
        if t in ("triangle", "quad"):
            ring = [*n, n[-1]][:4]
            out += ["0", "3DFACE", "8", "0", *(w for k, i in enumerate(ring) for c, v in zip("123", mesh.points[i], strict=True) for w in (f"{c}{k}", repr(float(v))))]
        elif t == "line":
            out += ["0", "LINE", "8", "0", *(w for k, i in enumerate(n) for c, v in zip("123", mesh.points[i], strict=True) for w in (f"{c}{k}", repr(float(v))))]
        else:
            raise ValueError(f"the format holds lines and faces only, not {t}")
    return _text([*out, "0", "ENDSEC", "0", "EOF"])


def _outline(mesh: RawMesh) -> list[list[int]]:
    return [n for t, n in mesh.cells if t in ("line", "triangle", "quad", "polygon")]


def write_svg(mesh: RawMesh) -> bytes:
    """Plane cells and lines as paths, y upwards."""
    p = mesh.points
    lo, hi = (p.min(0), p.max(0)) if len(p) else (np.zeros(3), np.ones(3))
    width = max(hi[0] - lo[0], hi[1] - lo[1], 1e-300)
    path = lambda n: "M " + " L ".join(f"{p[i, 0]!r} {lo[1] + hi[1] - p[i, 1]!r}".replace("np.float64(", "").replace(")", "") for i in n) + ("" if len(n) == 2 else " Z")
    body = "".join(f'<path d="{path(n)}"/>' for n in _outline(mesh))
    box = " ".join(repr(float(v)) for v in (lo[0], lo[1], hi[0] - lo[0], hi[1] - lo[1]))
    return f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" viewBox="{box}"><g fill="#c8c5bd" stroke="#000080" stroke-width="{float(width) / 500!r}">{body}</g></svg>\n'.encode()


def write_tikz(mesh: RawMesh) -> bytes:
    """Plane cells and lines as a picture."""
    draw = [f"\\draw {' -- '.join(f'({float(mesh.points[i, 0])!r}, {float(mesh.points[i, 1])!r})' for i in n)}{'' if len(n) == 2 else ' -- cycle'};" for n in _outline(mesh)]
    return _text(["\\documentclass{standalone}", "\\usepackage{tikz}", "\\begin{document}", "\\begin{tikzpicture}", *draw, "\\end{tikzpicture}", "\\end{document}"])


register("netgen", (".vol",), read_netgen, write_netgen, (b"mesh3d",))
register("flac3d", (".f3grid",), read_flac3d, write_flac3d, (b"* FLAC3D",))
register("mdpa", (".mdpa",), read_mdpa, write_mdpa, (b"Begin ModelPartData",))
register("z88", (".z88",), read_z88, write_z88)
register("frd", (".frd",), read_frd, write_frd)
register("patran", (".out", ".pat", ".neu"), read_patran, write_patran)
register("ansysInp", (".cdb", ".ans"), read_cdb, write_cdb)
register("radioss", (".rad", "_0000.rad"), read_radioss, write_radioss, (b"#RADIOSS",))
register("gid", (".post.msh", ".gid.msh"), read_gid, write_gid)
register("permas", (".post", ".dato"), read_permas, write_permas, (b"$ENTER",))
register("gltf", (".gltf", ".glb"), read_gltf, write_glb, (b"glTF",))
register("3mf", (".3mf",), read_3mf, write_3mf)
register("dxf", (".dxf",), read_dxf, write_dxf)
register("svg", (".svg",), None, write_svg)
register("tikz", (".tex",), None, write_tikz)
