import random
import re

import numpy as np
import pytest
import xxhash
from hostile import documents, empty

from lattica.llm.simhash import BKTree, near_duplicates, simhash_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def fingerprint(text, width):
    w = words(text)
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def variants(n, seed):
    """Texts and copies of them with words changed."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 200]))]
        for _ in range(rng.randint(1, 4)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.005, 0.02]) else w for w in base]
            out.append(" ".join(copy))
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("limit", [2048, 3])
def test_components_against_all_pairs(spark, limit):
    rows = [*variants(250, 1), (9001, None), (9002, ""), (9003, "One Two"), (9004, "one two")]
    got = {r[0]: (r[1], r[2]) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()}
    fps = {d: fingerprint(t, 3) for d, t in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = components(fps, near)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize("limit", [2048, 3])
def test_near_duplicates_against_all_pairs(spark, limit):
    rows = [*variants(200, 2), (9001, None), (9002, "")]
    got = {r[0]: r[1] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()}
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    alike = lambda a, b: (len(a & b) >= 0.8 * len(a | b)) if a or b else True
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    wrong = [d for d in sets if got.get(d, d) != want[d]]
    assert wrong == []


def crowd(n, seed, share):
    """Copies of one text of 200 words, each with ``share`` of its words changed."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(200)]
    return [(k, " ".join(f"x{rng.random()}" if rng.random() < share else w for w in base)) for k in range(n)]


@pytest.mark.parametrize("rows", [variants(200, 2), variants(200, 5), crowd(300, 6, 0.018)])
def test_crowded_shards_link_through_every_member(spark, rows):
    got = {r[0]: r[1] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=3).collect()}
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert [d for d in sets if got.get(d, d) != want[d]] == []


def test_repeats_do_not_part_equal_sets(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        text = " ".join(f"w{rng.randrange(4000)}" for _ in range(300))
        line = " ".join(f"l{rng.randrange(4000)}" for _ in range(8))
        rows += [(2 * k, f"{text} " + " ".join([line] * 2)), (2 * k + 1, f"{text} " + " ".join([line] * 60))]
    got = {r[0]: r[1] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(20) if got.get(2 * k + 1) != 2 * k] == []


def test_tree_against_a_scan():
    rng = np.random.default_rng(0)
    values = [int(v) for v in rng.integers(0, 1 << 63, 300)]
    values += [v ^ (1 << int(rng.integers(64))) for v in values[:150]]
    for radius in (0, 3, 20):
        tree = BKTree()
        for k, v in enumerate(values):
            assert sorted(tree.add(v, radius)) == [j for j in range(k) if (values[j] ^ v).bit_count() <= radius]


def test_hostile_documents(spark):
    docs = documents(spark)
    got = {r[0]: r for r in simhash_components(docs).collect()}
    assert got[0]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 0
    assert got[4]["component_id"] == got[5]["component_id"] == 4
    assert simhash_components(docs).count() == docs.count()
    groups = {r[0]: r[1] for r in near_duplicates(docs).collect()}
    assert groups[5] == 4 and groups[2] == 0
    assert simhash_components(empty(spark)).count() == 0 and near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [5, 60])
def test_shards_of_sets_are_searched_by_their_fingerprints(monkeypatch, n):
    from lattica.llm import simhash as S

    added, hits = [], []

    class Watched(BKTree):
        def add(self, value, radius):
            found = super().add(value, radius)
            added.append(value)
            hits.extend(found)
            return found

    monkeypatch.setattr(S, "BKTree", Watched)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    hashes = [np.unique(np.where(rng.random(200) < 0.02 * (k % 7), rng.integers(0, 1 << 63, 200, dtype=np.uint64), base)) for k in range(n)]
    sets, prints = [np.unique(h.astype(np.uint32)) for h in hashes], [S.fingerprint(h) for h in hashes]
    got = dict(enumerate(S.local_roots(sets, prints, 0.8)))
    want = components(range(n), [(i, j) for j in range(n) for i in range(j) if S.alike(sets[i], sets[j], 0.8)])
    assert got == {k: want[k] for k in range(n)} and added == prints and hits
