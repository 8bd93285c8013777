import duckdb
import pytest

from lattica.llm.catalog import oracle_sql, queries

TABLES = ["documents", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries()[name](spark, small)
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(str([fix(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in cur.fetchall())
    assert sorted(str([fix(r[c]) for c in sorted(columns)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(queries()))
def test_one_row_for_each_document(spark, small, name):
    got = queries()[name](spark, small)
    assert "doc_id" in got.columns
    if name != "op3_decontamination":
        ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
        assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
