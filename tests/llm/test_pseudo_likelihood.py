import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hostile import documents, empty

from lattica.llm import pseudo_likelihood as L
from lattica.llm.common import plain_words


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.where("doc_id % 5 <> 0")
    vocab = L.vocabulary(rows)
    return docs.where("doc_id % 5 = 0"), vocab, L.fit(L.encoded(rows, vocab), vocab)


def test_better_than_shares_and_lower_when_shuffled(trained):
    held, vocab, net = trained
    texts = [r["text"] for r in held.collect()]
    mean = lambda n, t: (lambda a: a[1].sum() / a[0].sum())(L.score_texts(t, vocab, n))
    rng = random.Random(1)
    shuffled = [" ".join(rng.sample(w := t.split(), len(w))) for t in texts]
    assert mean(net, texts) > mean(L.Network.start(vocab.log_share), texts) + 0.1
    assert mean(net, texts) > mean(net, shuffled)


def test_probabilities_sum_to_one(trained):
    _, vocab, net = trained
    around = np.array([[3, 7, vocab.size, 11]])
    total = sum(float(np.exp(net.log_probabilities(around, np.array([k])))[0]) for k in range(vocab.size))
    assert total == pytest.approx(1, abs=1e-3)


def test_sums_against_one_token_at_a_time(trained):
    _, vocab, net = trained
    text = "The cat; sat on THE mat zzqzz 42"
    ids = vocab.ids(plain_words(text))
    want = 0.0
    for i, t in enumerate(ids):
        near = [[ids[i + o] if 0 <= i + o < len(ids) else vocab.size for o in L.OFFSETS]]
        want += net.log_probabilities(np.array(near), np.array([t]))[0] + vocab.inside[t]
    n, sums = L.score_texts([text, "", text], vocab, net)
    assert n.tolist() == [len(ids), 0, len(ids)] and sums[0] == pytest.approx(want, rel=1e-4) and sums[2] == pytest.approx(want, rel=1e-4)


def test_counts_cover_every_word(spark):
    docs = documents(spark)
    got = {r["word"]: r["n"] for r in L.word_counts(docs).collect()}
    want = {}
    for r in docs.collect():
        for w in plain_words(r["text"]):
            want[w] = want.get(w, 0) + 1
    assert got == want


def test_every_token_is_the_centre_of_one_window():
    ids = [np.arange(k, k + n, dtype="<i2") for k, n in ((0, 7), (100, 1), (200, 0), (300, 30))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])
    centres = np.concatenate([L.training_windows(batch, 999, k, 3)[:, L.RADIUS] for k in range(3)])
    assert sorted(centres.tolist()) == np.concatenate(ids).tolist()


def test_a_text_scores_alike_in_any_company(trained):
    held, vocab, net = trained
    texts = [r["text"] for r in held.limit(60).collect()]
    alone = [L.score_texts([t], vocab, net)[1][0] for t in texts]
    assert L.score_texts(texts, vocab, net)[1].tolist() == alone
    assert L.score_texts(texts[::-1], vocab, net)[1].tolist() == alone[::-1]


def test_words_are_runs_of_letters_and_digits():
    texts = ["The cat; sat_on ½ THE mat☆☆ don't", "☆☆ ¿? — …", "Größe 3,5 日本語。中文", "a" * 300 + "".join(map(chr, range(0x2000, 0x2100))) + "b c"]
    for t in texts:
        assert plain_words(t) == re.findall(r"[^\W_]+", t.lower())


def test_averaging_tree_adds_all_models():
    flat = np.arange(5)
    batches = [L._model_batch(flat * k, k) for k in (1, 2, 3)]
    out = next(L._add_models(iter(batches)))
    assert np.array_equal(np.frombuffer(out.column(0)[0].as_py(), np.int64), flat * 6) and out.column(1)[0].as_py() == 6


def test_hostile_documents(spark):
    docs = documents(spark)
    got = L.pseudo_likelihood(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    none = [r for r in rows if r["doc_id"] in (0, 1, 2, 8)]
    assert all(r["n_tokens"] == 0 and r["log_likelihood"] == 0 and r["mean_log_probability"] is None for r in none)
    assert len({r["log_likelihood"] for r in rows if r["doc_id"] == 4}) == 1
    assert L.pseudo_likelihood(empty(spark)).count() == 0
