import random

import numpy as np
from hostile import documents, empty

from lattica.llm.decontamination import find_leaks, lcs, pieces_of

VOCABULARY = [f"{a}{b}" for a in "ka lo mi ne pu ra si to va zu".split() for b in "bel dor fin gam hul jet kis lop".split()]


def texts(n, length, seed):
    rng = random.Random(seed)
    return [[rng.choice(VOCABULARY) for _ in range(rng.randint(*length))] for _ in range(n)]


def planted(seed=1):
    rng = random.Random(seed)
    items = texts(20, (18, 55), seed)
    clean = texts(150, (40, 400), seed + 1)
    docs = [(k, " ".join(t)) for k, t in enumerate(clean)]
    truth = set()
    for k, item in enumerate(items):
        for change in (0.0, 0.12):
            host = list(clean[rng.randrange(len(clean))])
            at = rng.randrange(len(host))
            host[at:at] = [rng.choice(VOCABULARY) if rng.random() < change else w for w in item]
            docs.append((1000 + len(docs), " ".join(host)))
            truth.add((docs[-1][0], k))
    return docs, [(k, " ".join(t)) for k, t in enumerate(items)], truth


def test_copies_and_paraphrases_and_nothing_else(spark):
    docs, items, truth = planted()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert not {d for d, _ in got} - {d for d, _ in truth}


def test_recall_against_a_full_scan(spark):
    """Candidates by cosine, against the subsequence test on every window."""
    docs, items, _ = planted(7)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()}
    want = set()
    for p in pieces_of(items):
        masks = p.masks()
        for d, t in docs:
            w = t.split()
            if any(lcs(masks, len(p.words), w[i : i + 48]) >= 0.7 * len(p.words) for i in range(0, max(1, len(w) - 8), 8)):
                want.add((d, p.item_id))
    assert len(got & want) >= 0.9 * len(want)


def test_every_verbatim_copy_in_real_documents_is_found(spark):
    """More than 128 pieces, hosts and items of the tables."""
    rng = random.Random(1)
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    items = bench.orderBy("item_id").collect()
    hosts = [w for w in (r[0].split() for r in docs.where("length(text) > 600").orderBy("doc_id").select("text").collect()) if len(w) >= 100]
    rows = []
    for k in range(5 * len(items)):
        host = rng.choice(hosts)[: rng.randint(60, 200)]
        at = rng.randrange(len(host))
        rows.append((10**9 + k, " ".join(host[:at] + items[k // 5]["text"].split() + host[at:])))
    assert len(pieces_of([(r[0], r[1]) for r in items])) > 128
    found = find_leaks(docs.unionAll(spark.createDataFrame(rows, docs.schema)), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert [k for k in range(len(rows)) if (10**9 + k, items[k // 5]["item_id"]) not in got] == []


def test_lcs_against_dynamic_programming():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        masks = pieces_of([(0, " ".join(a))])[0].masks()
        assert lcs(masks, len(a), b) == row[-1]


def test_hostile_tables(spark):
    bench = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "one", 0), (3, "the cat sat on the mat and the dog", 0), (None, "x", 0)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(documents(spark), bench).collect()}
    assert (4, 3) in got and (5, 3) in got and all(d not in (0, 1, 2, 8) for d, _ in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents(spark), none).count() == 0 and find_leaks(empty(spark), bench).count() == 0


def test_the_space_is_that_of_all_passages(spark):
    """The products of the fit, against one dense matrix of every passage of 4000 documents."""
    from lattica.llm import decontamination as D

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.1 else f"z{rng.randrange(9)}" for _ in range(70)) for _ in range(4000)]
    numbers = {w: k for k, w in enumerate(sorted(vocabulary))}
    coded = D.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), numbers)
    n, df = D.document_frequency(coded, len(numbers))
    assert n == 4000 and df.tolist() == [sum(w in t.split() for t in texts) for w in sorted(vocabulary)]
    idf, basis = np.linspace(1, 2, 60).astype(np.float32), np.random.default_rng(1).normal(size=(60, 5)).astype(np.float32)
    a = np.zeros((4000 * 3, 60))
    for d, t in enumerate(texts):
        for k, w in enumerate(t.split()):
            if w in numbers:
                a[d * 3 + k // 32, numbers[w]] += idf[numbers[w]]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    got = sum(np.frombuffer(r[0], "<i8").reshape(60, 5) for r in coded.select("ids").mapInArrow(D._summed(np.append(np.arange(60), -1), idf, basis), "z binary").collect())
    assert np.allclose(got / (1 << D.SUMMED), a.T @ (a @ basis), rtol=1e-4, atol=1e-2)


def test_one_sum_reaches_the_driver(spark, monkeypatch):
    """Sums of 12 tasks are added before they are collected, in both power steps."""
    from lattica.llm import decontamination as D

    docs, items, _ = planted(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    numbers = {w: k for k, w in enumerate(VOCABULARY)}
    coded = D.encoded(df, numbers).repartition(12)
    rows = []
    collect = type(df).collect

    def counted(frame):
        out = collect(frame)
        if frame.columns == ["z"]:
            rows.append(len(out))
        return out

    monkeypatch.setattr(type(df), "collect", counted)
    assert D.fit(coded, pieces_of(items), numbers) is not None
    assert rows == [1] * D.POWERS


def test_candidates_without_half_the_words_are_ruled_out_by_table(spark, monkeypatch):
    """Masks are made for exactly the pieces that have half their words within reach of a passage, whatever is held at a time."""
    from lattica.llm import decontamination as D

    docs, items, _ = planted(9)
    pieces = pieces_of(items + [(100 + k, " ".join(VOCABULARY[k : k + 12] + [f"x{k}y{i}" for i in range(20)])) for k in range(20)])
    numbers = {w: k for k, w in enumerate(sorted({w for p in pieces for w in (*p.words, *p.answer)}))}
    space = D.fit(D.encoded(spark.createDataFrame(docs[:60], "doc_id long, text string"), numbers), pieces, numbers)
    split = [np.array([numbers.get(w, -1) for w in t.split()], "<i4") for _, t in docs[:60]] + [np.zeros(0, "<i4")]
    want = set()
    for ids in split:
        for at in range(0, len(ids), D.BLOCK):
            near = set(ids[max(0, at - 8) : at + 56].tolist())
            want |= {tuple(w) for w in space.words if sum(x in near for x in w) >= D.ANSWERED * len(w)}
    made, masks = [], D.word_masks
    monkeypatch.setattr(D, "word_masks", lambda words: made.append(tuple(words)) or masks(words))
    monkeypatch.setattr(D, "MIN_COSINE", -2.0)
    found = D.search(list(range(61)), split, space)
    assert set(made) == want and 0 < len(want) < len(space.words)
    monkeypatch.setattr(D, "HELD", 3 * len(space.feature))
    monkeypatch.setattr(D, "TESTED", 7)
    assert sorted(x[:2] + x[3:] for x in D.search(list(range(61)), split, space)) == sorted(x[:2] + x[3:] for x in found)
