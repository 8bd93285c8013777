import pytest
from hostile import documents, empty

from lattica.llm.mixing import mix, mixed_documents, position


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if level[s] > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | level
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    rows = [(k, " ".join(["w"] * (k % 17)), f"s{k % 5}" if k % 7 else None) for k in range(400)]
    rows += [(1000 + k, "w " * 90, "s0") for k in range(40)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)


def test_sources_are_read_as_often_as_the_cap_allows(spark):
    rows = [(k, "w w w", "a" if k < 4 else "b") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, weights=(9.0, 1.0), share=1.2, cap=3.5).collect()
    a = [r for r in got if r["source"] == "a"]
    want = targets({"a": 12, "b": 24}, (9, 1), 1.2, 3.5)
    assert want["a"] > 24 and sum(r["taken"] for r in a) == round(want["a"]) and max(r["taken"] for r in a) <= 12
    full = mixed_documents(docs, weights=(9.0, 1.0), share=1.2, cap=3.5).collect()
    assert sum(r["words"] for r in full if r["source"] == "a") == round(want["a"]) and {r["copy"] for r in full} >= {0, 1, 2}


def test_rows_that_share_an_identifier_keep_an_order(spark):
    rows = [(1, "w " * (k + 1), "a") for k in range(9)] + [(2, "x", "b")]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string").repartition(3)
    same = lambda r: sorted(str((x["doc_id"], x["size"], x["taken"], x["position"])) for x in mix(df(r), share=0.7).collect())
    assert same(rows) == same(rows[::-1])


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for g in (-0.8, 0.0, 0.8):
        df = spark.range(101).select((F.col("id") / 100).alias("q"), position(F.col("id") / 100, F.lit(g)).alias("t"))
        for q, t in df.collect():
            assert (1 - g) * t + g * t * t == pytest.approx(q, abs=1e-9)


def test_hostile_documents_and_clashing_columns(spark):
    docs = documents(spark)
    got = mix(docs)
    assert got.count() == docs.count()
    full = mixed_documents(docs)
    assert full.columns[: len(docs.columns)] == docs.columns
    assert {"copy", "_words", "_position"} <= set(full.columns)
    total = sum(r["size"] for r in got.collect())
    assert abs(sum(r["taken"] for r in got.collect()) - 1.5 * total) <= 3
    again = mix(documents(spark)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.collect()))


def test_empty(spark):
    assert mix(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(df).collect()] == [0, 0]
