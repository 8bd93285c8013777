import numpy as np
import pytest
from hostile import documents, empty

from lattica.llm.language_id import fold
from lattica.llm.quality import Rules, fit, lasso_logistic, learn, score, statistics, with_statistics


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rules = learn(docs, labels.where(fold(5) != 0))
    got = score(docs.join(labels.where(fold(5) == 0), "doc_id", "left_semi"), rules).join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    assert len(rules.rules) < 200


def test_column_equals_numpy(spark):
    docs = documents(spark)
    names = list(statistics())
    table = with_statistics(docs.where("doc_id is not null")).toPandas()
    rng = np.random.default_rng(0)
    x = rng.random((400, len(names)))
    rules = fit(x, (x[:, 0] + x[:, 3] > 1).astype(float), names)
    got = score(docs.where("doc_id is not null"), rules).toPandas()
    want = rules.predict(table[names].to_numpy(float), names)
    assert np.allclose(np.sort(got.score), np.sort(want))


def test_lasso_drops_noise():
    rng = np.random.default_rng(1)
    a = rng.random((2000, 30)) < 0.5
    y = (rng.random(2000) < np.where(a[:, 4], 0.9, 0.1)).astype(float)
    w, _ = lasso_logistic(a, y, 0.02)
    assert np.argmax(np.abs(w)) == 4 and (np.abs(w) > 1e-6).sum() < 8


def test_hostile_documents(spark):
    docs = documents(spark)
    got = score(docs, Rules([(("upper", ">", 0.1),)], [2.0], -1.0)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = learn(documents(spark), labels)
    assert score(documents(spark), rules).first()["score"] == pytest.approx(0.5)
    assert score(empty(spark), rules).count() == 0
