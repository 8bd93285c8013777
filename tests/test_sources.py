import json

import pytest

from lattica.__main__ import main
from lattica.operators import generate as N
from lattica.operators import topology as Y
from lattica.sources.files import read_tables, write_graph
from lattica.sources.manifest import chosen, manifest, parse_manifest, with_splits
from lattica.sources.raw import FORMATS, RawMesh, register

TEXT = json.dumps({"Version": 1, "Entries": [{"Id": f"c{k}", "Source": f"m_{k}.vtu", "Split": "train" if k % 3 else "test", "Tags": ["a"] if k % 2 else ["a", "b"], "Group": f"g{k // 2}"} for k in range(12)]})


def test_manifest(spark):
    m = manifest(spark, TEXT)
    assert chosen(m, split="test").count() == 4 and chosen(m, tags=["a", "b"]).count() == 6 and chosen(m, group="g0").count() == 2
    split = with_splits(m, {"train": 0.6, "test": 0.4}, 3)
    assert split.select("group", "split").distinct().count() == 6
    assert sorted(map(str, split.collect())) == sorted(map(str, with_splits(m, {"train": 0.6, "test": 0.4}, 3).collect()))
    for bad in ({"Version": 2, "Entries": []}, {"Version": 1}, {"Version": 1, "Entries": [{"Id": "a"}]}, {"Version": 1, "Entries": [{"Id": "a", "Source": "x"}] * 2}):
        with pytest.raises(ValueError):
            parse_manifest(json.dumps(bad))


def test_graph_file(spark, tmp_path):
    mesh = N.grid(spark, (2, 1))
    write_graph(Y.adjacency(mesh.cells), 6, str(tmp_path / "g.graph"))
    parts = sorted((tmp_path / "g.graph").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines == ["6 7", "2 4", "1 3 5", "2 6", "1 5", "2 4 6", "3 5"]


def test_a_format_of_ones_own(spark):
    register("dots", (".dots",), lambda data: RawMesh([[float(data), 0, 0]]), None)
    try:
        assert FORMATS["dots"].read(b"2.5").points.tolist() == [[2.5, 0.0, 0.0]]
    finally:
        del FORMATS["dots"]


def test_command_line(spark, tmp_path, capsys):
    mesh = RawMesh([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], [("quad", [0, 1, 2, 3])])
    (tmp_path / "a.off").write_bytes(FORMATS["off"].write(mesh))
    (tmp_path / "s.json").write_text(json.dumps({"steps": [{"op": "simplexify"}]}))
    main(["info", str(tmp_path / "a.off")])
    assert "off" in capsys.readouterr().out
    main(["run", str(tmp_path / "a.off"), str(tmp_path / "out"), str(tmp_path / "s.json")])
    assert read_tables(spark, str(tmp_path / "out")).cells.count() == 2
    main(["convert", str(tmp_path / "a.off"), str(tmp_path / "vtk"), "--to", "vtk"])
    assert b"UNSTRUCTURED_GRID" in bytes(spark.read.parquet(str(tmp_path / "vtk")).first()["content"])
