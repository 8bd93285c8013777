import hashlib
import random
import re

import pytest
from hostile import documents, empty
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import lsm_dedup, sha256


def brute(rows):
    groups = {}
    for doc, text in rows:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc is None, doc or 0, doc))
    out = {}
    for body, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        for m in members:
            out.setdefault(m[3], []).append((keep, len(members), m[3] == keep, hashlib.sha256(body.encode()).hexdigest()))
    return {k: sorted(v, key=str) for k, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"], r["digest"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_hostile_documents(spark):
    docs = documents(spark)
    assert found(lsm_dedup(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_random_texts_and_ties(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("ab \n\x0b") for _ in range(rng.randint(0, 5)))) for k in range(300)]
    assert found(lsm_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("weak", [lambda c: F.substring(c, 1, 1), lambda c: F.lit("same")])
def test_byte_verification_splits_collisions(spark, weak):
    rows = [(k, t) for k, t in enumerate(["a b", "ab", "ac", "a c ", "b", "", None, "b"])]
    got = {k: v[0][:3] for k, v in found(lsm_dedup(spark.createDataFrame(rows, "doc_id long, text string"), weak)).items()}
    assert got == {k: v[0][:3] for k, v in brute(rows).items()}


def test_empty(spark):
    assert lsm_dedup(empty(spark), sha256).count() == 0
