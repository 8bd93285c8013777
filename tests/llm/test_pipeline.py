import corpus_pipeline
from hostile import documents, empty
from pyspark.sql import functions as F

from lattica.llm.common import written


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def bench(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    d = bench(spark, tmp_path)
    text = "der hund lief durch den wald und sah viele grosse alte baeume am rand des weges stehen bis es nacht wurde"
    leak = "vorher ging es um anderes alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron und danach auch"
    copy = text.replace("nacht", "dunkel") + " " + " ".join(f"wort{k}" for k in range(60))
    base = text + " " + " ".join(f"wort{k}" for k in range(60))
    docs = documents(spark, [base, copy, leak, base + " \n", "un deux trois quatre cinq six sept huit neuf dix"]).where("doc_id >= 10")
    got = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, d)
        if name != "mix_sources":
            assert out.columns == docs.columns
        docs = written(out, name)
        got[name] = sorted({r["doc_id"] for r in docs.collect()})
    assert 10 not in got["exact_dedup"] and 13 in got["exact_dedup"]
    assert 13 not in got["near_dedup"] and 11 in got["near_dedup"]
    assert 12 not in got["decontaminate"]


def test_hostile_and_empty_tables(spark, tmp_path):
    d = bench(spark, tmp_path)
    for docs in (documents(spark), empty(spark)):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, d)
            assert out.count() <= 2 * docs.count()
            if name != "mix_sources":
                assert out.columns == docs.columns


def test_repeated_rows_are_not_multiplied(spark, tmp_path):
    d = bench(spark, tmp_path)
    text = "ein satz der sich nicht veraendert und lang genug ist"
    rows = [(7, text, "a"), (7, text, "a"), (7, text, "a"), (7, "another text under the same identifier", "a"), (None, text, "a"), (None, "nobody knows me", "b"), (3, "alone", "b")]
    docs = spark.createDataFrame([(k, t, "de", s, 1) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stage("exact_dedup")(spark, docs, d)
    want = [(3, "alone"), (7, "another text under the same identifier"), (7, text), (None, "nobody knows me")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    mixed = stage("mix_sources")(spark, docs, d).collect()
    taken = sum(r["words"] for r in mixed)
    assert len(mixed) <= 2 * len(rows) and abs(taken - 1.5 * sum(len(t.split()) for _, t, _ in rows)) <= 2
    assert sorted(map(str, stage("mix_sources")(spark, docs, d).collect())) == sorted(map(str, mixed))


def test_exact_dedup_keeps_what_brute_force_keeps(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bodies = {}
    for r in docs.collect():
        body = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        bodies.setdefault(body, []).append((-len(r["text"] or ""), r["doc_id"]))
    want = sorted(min(v)[1] for v in bodies.values())
    got = sorted(r["doc_id"] for r in stage("exact_dedup")(spark, docs, "").select("doc_id").collect())
    assert got == want


def test_run_gives_every_kept_document(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.select("doc_id", "copy", "words", F.col("position")).collect()
    assert rows and all(r["words"] > 0 for r in rows)
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
