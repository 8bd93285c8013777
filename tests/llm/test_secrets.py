import base64
import hashlib
import math
import random
import re

from hostile import documents, empty

from lattica.llm import secrets


def brute(text):
    out = []
    key = r"(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    for m in re.finditer(key.replace("_?", "_?") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


QUOTES = "\"'"
KINDS = list(secrets.PATTERNS)


def check(docs):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute(t)).encode()).hexdigest()) for d, t in texts)
    got = secrets.find_secrets(docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    return got


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(3)
    parts = ["password", "Token", "secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "é", "😀", "deadbeef", "_", "-", ".", "\n"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_random_keys_are_found_and_names_are_not(spark):
    rng = random.Random(4)
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(60)]
    names = ["thisisaverylongidentifier_name", "some/path/to/a/file/in/the/tree1", "a" * 34, "TheQuickBrownFoxJumpsOverTheLazyDog", "internationalization-and-localization", "1234567890" * 4] * 10
    rows = [(k, f"le {t} fin") for k, t in enumerate(keys + names)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] for k in range(60)) >= 54
    assert sum(got[k] for k in range(60, 120)) == 0


def test_random_keys_are_found_after_signs_and_quotes(spark):
    rng = random.Random(5)
    before = ["KEY=", "AccountKey=", "?sig=", "AWS_SECRET_ACCESS_KEY=", "key:", 'KEY="', "KEY='", "KEY= ", "key: "]
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(20 * len(before))]
    rows = [(k, f"le {before[k // 20]}{t}{before[k // 20][-1] if before[k // 20][-1] in QUOTES else ''} fin") for k, t in enumerate(keys)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = [t.index(keys[k]) for k, t in rows]
    found = [f"random:{at[k]}:{at[k] + len(keys[k])}" in got[k] for k, _ in rows]
    assert [b for n, b in enumerate(before) if sum(found[20 * n : 20 * n + 20]) < 17] == []


def test_places_of_very_many_matches(spark):
    n = 5 * secrets.CHUNK + 7
    got = secrets.find_secrets(spark.createDataFrame([(1, "é " + "0123456789abcdef " * n)], "doc_id long, text string")).first()
    assert got["n_hex"] == n
    assert got["spans"] == ",".join(f"hex:{2 + 17 * k}:{18 + 17 * k}" for k in range(n))


def test_line_bounds_lost_keys_and_false_alarms():
    rng = random.Random(6)
    binned = lambda p: min(int(-math.log10(max(p, 1e-30)) * secrets.BINS_EACH), secrets.FLOOR * secrets.BINS_EACH)
    for words in (0, 200, 2000):
        keys = [binned(rng.random()) for _ in range(1000)]
        text = [binned(10 ** -rng.uniform(0.5, 12)) for _ in range(words)]
        histogram = {}
        for b in keys + text:
            histogram[b] = histogram.get(b, 0) + 1
        at = secrets.line(histogram)
        told, wrong = sum(b < at for b in keys), sum(b < at for b in text)
        assert wrong <= 0.1 * (told + wrong), (words, told, wrong)
        assert told >= (990 if words == 0 else 600), (words, told)
    assert secrets.line({binned(1e-9): 1}) <= binned(1e-9) and secrets.line({binned(0.3): 1}) > binned(0.3)


def test_battery_against_plain_python(spark):
    from pyspark.sql import functions as F

    key = "aB3xZ9qLmN0pR7sT2vW5yC8d"
    alphabet = secrets.ALPHABETS["base64"]
    counts = [key.count(c) for c in alphabet]
    n, k = len(key), len(alphabet)
    square = sum((c - n / k) ** 2 / (n / k) for c in counts)
    x = [alphabet.index(c) for c in key]
    high = sum(v >= k / 2 for v in x)
    runs = 1 + sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:], strict=False))
    mu = 2 * high * (n - high) / n + 1
    z1 = (runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1))
    m = sum(x) / n
    r = sum((a - m) * (b - m) for a, b in zip(x, x[1:], strict=False)) / sum((a - m) ** 2 for a in x)
    z2 = (r + 1 / n) * math.sqrt(n)
    c = 2 / (9 * (k - 1))
    z0 = ((square / (k - 1)) ** (1 / 3) - (1 - c)) / math.sqrt(c)
    p = [0.5 * math.erfc(z0 / math.sqrt(2)), math.erfc(abs(z1) / math.sqrt(2)), math.erfc(abs(z2) / math.sqrt(2))]
    half = -sum(map(math.log, p))
    fisher = math.exp(-half) * (1 + half + half * half / 2)
    found = spark.createDataFrame([(key,)], "t string").select(F.inline(secrets.candidates(F.col("t")))).first()
    name = found["encoding"]
    assert name in ("base58", "base64")
    if name == "base64":
        assert found["bin"] == math.floor(-math.log10(fisher) * secrets.BINS_EACH)


def test_hostile_documents(spark):
    check(documents(spark, ["token = '0123456789abcdef0123'", "AKIA" * 30]))
    assert secrets.find_secrets(empty(spark)).count() == 0
