"""A mesh as it stands in one file, and the registry of formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class RawMesh:
    """Points (n x 3), cells as (type, node list) in file order, data by name (n x k), and regions (kind, name, tag, entities)."""

    points: np.ndarray
    cells: list[tuple[str, list[int]]] = field(default_factory=list)
    point_data: dict[str, np.ndarray] = field(default_factory=dict)
    cell_data: dict[str, np.ndarray] = field(default_factory=dict)
    regions: list[tuple[str, str, int, list[int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        p = np.asarray(self.points, float).reshape(len(self.points), -1) if len(self.points) else np.zeros((0, 3))
        self.points = np.pad(p, ((0, 0), (0, 3 - p.shape[1]))) if p.shape[1] < 3 else p[:, :3]


Reader = Callable[[bytes], RawMesh]
Writer = Callable[[RawMesh], bytes]


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    read: Reader | None
    write: Writer | None
    starts: tuple[bytes, ...] = ()


FORMATS: dict[str, Format] = {}


def register(name: str, extensions: tuple[str, ...], read: Reader | None = None, write: Writer | None = None, starts: tuple[bytes, ...] = ()) -> None:
    """Adds a format, or replaces one of the same name; this is how callers add their own."""
    FORMATS[name] = Format(name, extensions, read, write, starts)


def by_path(path: str) -> list[str]:
    """Formats whose extension the path has, the longest extension first."""
    low = path.lower().removesuffix(".gz").removesuffix(".bz2")
    found = [(len(e), f.name) for f in FORMATS.values() for e in f.extensions if low.endswith(e)]
    return [n for _, n in sorted(found, reverse=True)]


def sniff(head: bytes) -> list[str]:
    """Formats that start as the content does; none where the content can't tell."""
    head = head.lstrip()
    return [f.name for f in FORMATS.values() if any(head[: len(s)].lower() == s.lower() for s in f.starts)]


def detect(path: str, head: bytes) -> str:
    """The format of a file: by extension, among several by content; an error if none fits."""
    named, seen = by_path(path), sniff(head)
    both = [n for n in named if n in seen]
    silent = [n for n in named if not FORMATS[n].starts]  # that have no opening of their own
    found = both or silent or named or seen
    if not found:
        raise ValueError(f"the format of {path} is not known")
    return found[0]
