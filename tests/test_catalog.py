"""Every mesh query against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from lattica.plans import formats  # noqa: F401  adds its queries and those of the terrain
from lattica.plans.catalog import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    if name not in SQL:
        assert rows
        return
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cur.fetchall())
    assert rows == want
