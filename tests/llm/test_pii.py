import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hostile import documents, empty

from lattica.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_table())


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b-", "_", "12", "0", "255", " ", "-", "+1", "4111111111111111", " (", ".com", "é", "+", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s, pii.KINDS.index(k), e) for s, e, k in pii.base_spans(text)] == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def test_viterbi_against_all_paths(model):
    rng = np.random.default_rng(0)
    chains = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 2, 4, 3)]
    for x, got in zip(chains, model.decode(chains), strict=True):
        score = lambda p: model.first[p[0]] + sum(x[t, y] for t, y in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(x)), key=score)
        assert tuple(got) == best


def test_held_out_rows(model):
    table = pii.labelled_table(200, seed=77)
    right = sum(list(model.decode([model.scores(w)])[0]) == y for w, y in map(pii._gold, table))
    assert right > 0.9 * len(table)


def test_spans_beyond_the_patterns(model):
    texts = {
        "bitte call (743) 555-3824 today": (11, 25, "phone"),
        "nur +1 (826) 555-4081 190.137.2 dann": (4, 21, "phone"),
        "write to ana.mi [at] leon.com please": (9, 29, "email"),
    }
    for (base, every), want in zip(pii.find(list(texts), model), texts.values(), strict=True):
        assert base == [] and every == [want]


def test_base_spans_stay_and_plain_numbers_are_left_alone(model):
    text = "In 1999 order 2390409500648960 costs 12.50, see 3.14.15 and 4471-22"
    assert pii.find([text], model)[0] == ([], [])
    base, every = pii.find(["a.b@c.example.com 129.38.82.176"], model)[0]
    assert [s for s in every if s in base] == base and len(base) == 2


def test_hostile_documents(spark, model):
    docs = documents(spark)
    got = pii.find_pii(docs, model).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        want = brute(texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert pii.find_pii(empty(spark), model).count() == 0
