import hashlib
import random
import re

import numpy as np
import pytest
from hostile import documents, empty

from lattica.llm.substring_dedup import common_words, deep_nodes, remove_repeats


def brute(rows, window):
    seen, out = {}, {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for d in sorted(split):
        w = split[d]
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            else:
                seen[key] = (d, i)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [16384, 2])
@pytest.mark.parametrize("alphabet", [2, 30, 2000])
def test_against_brute_force(spark, limit, alphabet):
    rng = random.Random(alphabet)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(120):
        body = [f"w{rng.randrange(alphabet)}" for _ in range(rng.choice([0, 5, 19, 20, 21, 80]))]
        if k % 3 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        rows.append((k, " \n".join(body)))
    rows += [(500 + k, rows[k][1]) for k in range(0, 40, 3)] + [(900, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit)
    assert {r[0]: (r[1], r[2], r[3]) for r in got.drop("kept").collect()} == brute(rows, 20)


def test_nodes_against_all_prefixes():
    rng = random.Random(7)
    for alphabet in (1, 2, 3):
        suffixes = sorted([rng.randrange(alphabet) for _ in range(5)] for _ in range(40))
        common = common_words(np.array(suffixes))
        for depth in (1, 3, 5):
            want = []
            for prefix in sorted({tuple(s[:depth]) for s in suffixes}):
                own = [k for k, s in enumerate(suffixes) if tuple(s[:depth]) == prefix]
                if len(own) > 1:
                    want.append((own[0], own[-1]))
            assert list(zip(*(x.tolist() for x in deep_nodes(common, depth)), strict=True)) == want


def test_few_bits_in_the_filter_change_nothing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(60))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(9)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=1 << 15)
    assert {r[0]: (r[1], r[2], r[3]) for r in got.drop("kept").collect()} == brute(rows, 20)


def test_rows_that_share_an_identifier(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, first), (1, first), (1, f"x {first} {second}"), (2, second)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    n = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got)
    # the two equal rows are one document; which of the texts under 1 comes first is up to their hashes
    assert n in ([(1, 30, 0), (1, 30, 0), (1, 61, 30), (2, 30, 30)], [(1, 30, 30), (1, 30, 30), (1, 61, 0), (2, 30, 30)])


def test_hostile_documents(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = remove_repeats(docs)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 20)
    assert {r[0]: (r[1], r[2], r[3]) for r in got.drop("kept").collect()} == want
    assert remove_repeats(documents(spark)).count() == documents(spark).count()
    assert remove_repeats(empty(spark)).count() == 0
