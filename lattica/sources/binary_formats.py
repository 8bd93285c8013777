"""Binary formats, and those that come in both kinds."""

from __future__ import annotations

import numpy as np

from .raw import RawMesh, register
from .text_formats import _row, _text, faces_of, polygon

# STL: triangles by coordinates; equal ones are one point

_STL = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])


def _shared(corners: np.ndarray) -> RawMesh:
    points, index = np.unique(corners.reshape(-1, 3), axis=0, return_inverse=True)
    return RawMesh(points, [("triangle", t) for t in index.reshape(-1, 3).tolist()])


def read_stl(data: bytes) -> RawMesh:
    n = int(np.frombuffer(data, "<u4", 1, 80)[0]) if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        return _shared(np.frombuffer(data, _STL, n, 84)["corners"].astype(float))
    rows = [l.split()[1:4] for l in data.decode("latin-1").splitlines() if l.strip().startswith("vertex")]
    return _shared(np.array(rows, float).reshape(-1, 3, 3))


def write_stl(mesh: RawMesh) -> bytes:
    faces = faces_of(mesh)
    triangles = np.array([[f[0], a, b] for f in faces for a, b in zip(f[1:], f[2:], strict=False)], int).reshape(-1, 3)
    corners = mesh.points[triangles]
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    out = np.zeros(len(triangles), _STL)
    out["normal"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
    out["corners"] = corners
    return b"written by lattica".ljust(80) + np.uint32(len(triangles)).tobytes() + out.tobytes()


# PLY

_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(data: bytes) -> RawMesh:
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for w in (l.split() for l in data[:end].decode("latin-1").splitlines()):
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], None, _PLY[w[1]]) if w[1] != "list" else (w[-1], _PLY[w[2]], _PLY[w[3]]))
    order = ">" if "big" in kind else "<"
    words = body.split() if kind == "ascii" else []
    at = 0
    tables: dict[str, dict] = {}
    for name, n, properties in elements:
        plain = all(c is None for _, c, _ in properties)
        if plain and kind != "ascii":
            dtype = np.dtype([(p, order + t) for p, _, t in properties])
            rows = np.frombuffer(body, dtype, n, at)
            at += dtype.itemsize * n
            tables[name] = {p: rows[p].astype(float) for p, _, _ in properties}
        elif plain:
            k = len(properties)
            rows = np.array(words[at : at + n * k], float).reshape(n, k)
            at += n * k
            tables[name] = {p: rows[:, j] for j, (p, _, _) in enumerate(properties)}
        else:
            out: dict[str, list] = {p: [] for p, _, _ in properties}
            for _ in range(n):
                for p, c, t in properties:
                    if kind == "ascii":
                        k = int(words[at]) if c else 1
                        at += bool(c)
                        v = [float(x) for x in words[at : at + k]]
                        at += k
                    else:
                        k = int(np.frombuffer(body, order + c, 1, at)[0]) if c else 1
                        at += np.dtype(c).itemsize if c else 0
                        v = np.frombuffer(body, order + t, k, at).tolist()
                        at += np.dtype(t).itemsize * k
                    out[p].append(v)
            tables[name] = out
    v = tables["vertex"]
    points = np.stack([v[c] for c in "xyz"], 1)
    extra = {k: a.reshape(-1, 1) for k, a in v.items() if k not in "xyz"}
    face = tables.get("face", {})
    lists = face.get("vertex_indices") or face.get("vertex_index") or []
    return RawMesh(points, [(polygon(len(f)), [int(i) for i in f]) for f in lists], extra)


def write_ply(mesh: RawMesh) -> bytes:
    faces = faces_of(mesh)
    scalars = {k: v for k, v in mesh.point_data.items() if v.shape[1] == 1}
    head = ["ply", "format ascii 1.0", f"element vertex {len(mesh.points)}", *(f"property double {c}" for c in "xyz"), *(f"property double {k.replace(' ', '_')}" for k in scalars)]
    head += [f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    rows = [_row([*p, *(v[i, 0] for v in scalars.values())]) for i, p in enumerate(mesh.points)]
    return _text(head + rows + [f"{len(f)} " + " ".join(map(str, f)) for f in faces])


# PCD


def read_pcd(data: bytes) -> RawMesh:
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        w = data[at:end].decode("latin-1").split()
        at = end + 1
        if w and not w[0].startswith("#"):
            head[w[0]] = w[1:]
    fields, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(fields))]
    if head["DATA"] == ["ascii"]:
        table = np.array(data[at:].split(), float).reshape(n, sum(counts))
        columns = {f: table[:, s : s + c] for f, c, s in zip(fields, counts, np.cumsum([0, *counts]), strict=False)}
    elif head["DATA"] == ["binary"]:
        kinds = {"F": "f", "I": "i", "U": "u"}
        dtype = np.dtype([(f"{k}_{f}", f"<{kinds[t]}{s}", (c,)) for k, (f, t, s, c) in enumerate(zip(fields, head["TYPE"], head["SIZE"], counts, strict=True))])
        rows = np.frombuffer(data, dtype, n, at)
        columns = {f: rows[f"{k}_{f}"].astype(float) for k, f in enumerate(fields)}
    else:
        raise ValueError("compressed files of this format are not read")
    points = np.concatenate([columns.pop(c) for c in "xyz"], 1)
    return RawMesh(points, [("vertex", [i]) for i in range(n)], {k: v for k, v in columns.items() if k != "_"})


def write_pcd(mesh: RawMesh) -> bytes:
    n = len(mesh.points)
    head = ["VERSION 0.7", "FIELDS x y z", "SIZE 8 8 8", "TYPE F F F", "COUNT 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    return _text(head + [_row(p) for p in mesh.points])


register("stl", (".stl",), read_stl, write_stl, (b"solid",))
register("ply", (".ply",), read_ply, write_ply, (b"ply",))
register("pcd", (".pcd",), read_pcd, write_pcd, (b"# .PCD", b"VERSION"))
