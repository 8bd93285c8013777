"""Fixed values of the cell types: dimension, node count, edges, facets, simplices.

Local node numbers, corners first. Facets of solids wind outwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (dimension, nodes, corners)
TYPES = {
    "vertex": (0, 1, 1), "line": (1, 2, 2), "line3": (1, 3, 2),
    "triangle": (2, 3, 3), "triangle6": (2, 6, 3), "quad": (2, 4, 4), "quad8": (2, 8, 4), "quad9": (2, 9, 4),
    "tetra": (3, 4, 4), "tetra10": (3, 10, 4), "pyramid": (3, 5, 5), "wedge": (3, 6, 6), "wedge15": (3, 15, 6),
    "hexahedron": (3, 8, 8), "hexahedron20": (3, 20, 8),
}
#: Linear type on the corners.
LINEAR = {"line3": "line", "triangle6": "triangle", "quad8": "quad", "quad9": "quad", "tetra10": "tetra", "wedge15": "wedge", "hexahedron20": "hexahedron"}
#: Quadratic type with one node more for each edge, in the order of EDGES.
ELEVATED = {"line": "line3", "triangle": "triangle6", "quad": "quad8", "tetra": "tetra10", "wedge": "wedge15", "hexahedron": "hexahedron20"}
EDGES = {
    "line": [(0, 1)],
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "quad": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "tetra": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    "pyramid": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    "wedge": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    "hexahedron": [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
}
FACETS = {
    "line": [(0,), (1,)],
    "triangle": [(0, 1), (1, 2), (2, 0)],
    "quad": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "tetra": [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)],
    "pyramid": [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
    "wedge": [(0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    "hexahedron": [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
}
SIMPLICES = {
    "line": [(0, 1)],
    "triangle": [(0, 1, 2)],
    "quad": [(0, 1, 2), (0, 2, 3)],
    "tetra": [(0, 1, 2, 3)],
    "pyramid": [(0, 1, 2, 4), (0, 2, 3, 4)],
    "wedge": [(0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)],
    "hexahedron": [(0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)],
}
SIMPLEX_TYPE = {1: "line", 2: "triangle", 3: "tetra"}
#: Node order that turns a cell inside out, node 0 kept.
FLIPPED = {
    "line": (1, 0), "triangle": (0, 2, 1), "quad": (0, 3, 2, 1), "tetra": (0, 2, 1, 3), "pyramid": (0, 3, 2, 1, 4),
    "wedge": (0, 2, 1, 3, 5, 4), "hexahedron": (0, 3, 2, 1, 4, 7, 6, 5),
}


def by_type(cell_type: Column, values: dict, make, other: Column) -> Column:
    """``make(values[type])`` for the type in ``cell_type``, ``other`` for types without an entry."""
    out = other
    for name, value in values.items():
        out = F.when(cell_type == name, make(value)).otherwise(out)
    return out


def dimension(cell_type: Column) -> Column:
    return by_type(cell_type, {k: v[0] for k, v in TYPES.items()}, F.lit, F.lit(None).cast("int"))


def corner_count(cell_type: Column) -> Column:
    return by_type(cell_type, {k: v[2] for k, v in TYPES.items()}, F.lit, F.lit(None).cast("int"))


def tuples(cell_type: Column, nodes: Column, table: dict) -> Column:
    """array<array<bigint>>: the node ids of each entry of ``table`` for the cell's (linear) type."""

    def make(entries):
        return F.array(*[F.array(*[nodes.getItem(i) for i in e]) for e in entries])

    full = table | {q: table[l] for q, l in LINEAR.items() if l in table}
    return by_type(cell_type, full, make, F.array().cast("array<array<bigint>>"))
