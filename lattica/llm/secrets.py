"""Secret scans: fixed patterns, and a battery of tests for randomness.

Main path: DataFrame operations only.

The patterns give the base spans. Beside them, every unbroken run of characters
that keys are written in is a candidate. Its encoding is inferred from the
characters it uses (hexadecimal, base 32, base 58 or base 64), and under the
hypothesis that its characters are drawn at random from that alphabet it takes
three tests:

* chi-squared: all characters are equally likely;
* runs: those above and below the middle of the alphabet alternate by chance;
* serial correlation: neighbours are independent.

The three p-values are combined by Fisher's method. Words, paths and numbers
fail; keys do not. The line is drawn for the whole corpus, apart for each
encoding and band of length, since the power of the tests depends on both, and
it controls both errors:

* candidates found non-random are so at a false-discovery rate of RATE
  (Benjamini and Hochberg), which bounds the keys that are lost;
* the p-values of random keys are even between 0 and 1, so those above 1/2
  tell how many keys there are (Storey). At a line t, a share 1 - t of them is
  reported, and what is reported beyond that is not random. The line rises
  until that is at most RATE of all that is reported, which bounds false alarms.

What is above the line is added where it overlaps no base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Fixed patterns by kind, in the order in which kinds are listed, and the least length they need.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
LEAST_VALUE = 12
#: The least length at which the battery has any power; shorter keys are for the fixed patterns.
LEAST_KEY = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_KEY},}}+={{0,2}}+(?![A-Za-z0-9+/_=-])"

#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Bins of p on a log scale, BINS_EACH to a power of ten down to 10^-FLOOR, and the false-discovery rate.
BINS_EACH, FLOOR, RATE = 20, 30, 0.05
#: Matches whose places are added up at a time.
CHUNK = 64


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches give the places. Texts without a match are
    searched once.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    one = "struct<start:int,end:int,hit:string>"
    empty = F.array().cast(f"array<{one}>")

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["hit"])
        found = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    def chunk(acc: Column, pairs: Column) -> Column:
        part = F.aggregate(pairs, F.struct(acc["at"].alias("at"), empty.alias("found")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["found"], F.array(part["found"])).alias("found"))

    # in chunks, so that a text of very many matches does not copy all of them for each
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(CHUNK))
    chunks = F.transform(firsts, lambda k: F.slice(pairs, k, F.lit(CHUNK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("found"))
    all_found = F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["found"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), all_found).otherwise(empty)


def tail(z: Column) -> Column:
    """P(|N| > |z|) for a standard normal N, within 2e-7 (a rational approximation)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by the cube-root transform."""
    c = 2.0 / (9.0 * df)
    z = (F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - c)) / F.sqrt(c)
    return F.when(z > 0, tail(z) / 2).otherwise(1 - tail(z) / 2)


def encoding(key: Column) -> Column:
    """The first alphabet that has all characters of the key; null if none.

    Keys without a digit or without a letter are left to the reader: names in
    mixed case look as random as short keys do.
    """
    out = F.lit(None).cast("string")
    for name, alphabet in reversed(ALPHABETS.items()):
        # what is left of the key without the alphabet's characters
        out = F.when(F.translate(key, alphabet, "") == "", F.lit(name)).otherwise(out)
    return F.when(key.rlike("[0-9]") & key.rlike("[A-Za-z]"), out)


def with_fields(found: Column, make) -> Column:
    """Each struct of ``found`` with the fields that ``make`` gives for it.

    The battery is a chain of such steps, so that a step reads what an earlier
    one computed once.
    """

    def step(c: Column) -> Column:
        for name, value in make(c).items():
            c = c.withField(name, value)
        return c

    return F.transform(found, step)


def _prepared(c: Column) -> dict[str, Column]:
    alphabet = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(c["encoding"] == name, F.lit(letters)).otherwise(alphabet)
    return {"alphabet": alphabet, "n": F.length(c["key"]).cast("double")}


def _digits(c: Column) -> dict[str, Column]:
    return {
        "size": F.length(c["alphabet"]).cast("double"),
        "digits": F.transform(F.split(c["key"], ""), lambda x: F.instr(c["alphabet"], x).cast("double") - 1),
        "counts": F.transform(
            F.split(c["alphabet"], ""), lambda x: c["n"] - F.length(F.replace(c["key"], x, F.lit(""))).cast("double")
        ),
    }


def _sums(c: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "squares": F.aggregate(c["counts"], zero, lambda acc, x: acc + x * x),
        "high": F.aggregate(c["digits"], zero, lambda acc, x: acc + F.when(x >= c["size"] / 2, 1.0).otherwise(0.0)),
        "mean": F.aggregate(c["digits"], zero, lambda acc, x: acc + x) / c["n"],
        "pairs": F.zip_with(
            F.slice(c["digits"], 1, F.size(c["digits"]) - 1),
            F.slice(c["digits"], 2, F.size(c["digits"]) - 1),
            lambda x, y: F.struct(x.alias("x"), y.alias("y")),
        ),
    }


def _moments(c: Column) -> dict[str, Column]:
    zero, half, mean = F.lit(0.0), c["size"] / 2, c["mean"]
    return {
        "turns": F.aggregate(
            c["pairs"], F.lit(1.0), lambda acc, p: acc + F.when((p["x"] >= half) != (p["y"] >= half), 1.0).otherwise(0.0)
        ),
        "spread": F.aggregate(c["digits"], zero, lambda acc, x: acc + (x - mean) * (x - mean)),
        "lagged": F.aggregate(c["pairs"], zero, lambda acc, p: acc + (p["x"] - mean) * (p["y"] - mean)),
        "runs": 2 * c["high"] * (c["n"] - c["high"]) / c["n"] + 1,
    }


def _tests(c: Column) -> dict[str, Column]:
    n = c["n"]
    runs = F.when(
        (c["high"] > 0) & (c["high"] < n),
        tail((c["turns"] - c["runs"]) / F.sqrt(F.greatest((c["runs"] - 1) * (c["runs"] - 2) / (n - 1), F.lit(1e-9)))),
    ).otherwise(F.greatest(F.pow(F.lit(2.0), 1 - n), F.lit(1e-300)))
    serial = F.when(c["spread"] > 0, tail((c["lagged"] / c["spread"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-300))
    uniform = chi_tail(c["squares"] * c["size"] / n - n, c["size"] - 1)
    return {"half": -(F.log(uniform) + F.log(runs) + F.log(serial))}


def _binned(c: Column) -> Column:
    p = F.exp(-c["half"]) * (1 + c["half"] + c["half"] * c["half"] / 2)
    scaled = F.floor(-F.log10(F.greatest(p, F.lit(10.0**-FLOOR))) * BINS_EACH)
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["encoding"].alias("encoding"),
        F.least(F.floor(F.log2(c["n"] / 16.0)), F.lit(6)).cast("int").alias("band"),
        F.least(scaled, F.lit(FLOOR * BINS_EACH)).cast("int").alias("bin"),
    )


def candidates(text: Column) -> Column:
    """array<struct<start, end, encoding, band, bin>> of the runs that may be keys.

    ``bin`` is the p-value on a log scale, ``band`` the length doubled from 16 (20 to 31, 32 to 63, ...).
    """

    def judged(hit: Column) -> Column:
        key = F.rtrim(hit["hit"], F.lit("="))
        return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), key.alias("key"), encoding(key).alias("encoding"))

    found = F.filter(F.transform(spans(text, CANDIDATE), judged), lambda c: c["encoding"].isNotNull())
    for make in (_prepared, _digits, _sums, _moments, _tests):
        found = with_fields(found, make)
    return F.transform(found, _binned)


def cutoffs(rows: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """The bin from which on a candidate is not reported, for each encoding and band.

    ``rows`` has the array ``candidates``. The histogram has at most encodings
    x bands x bins rows, whatever the input, and is all that is collected.
    """
    counts = (
        rows.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.encoding").alias("encoding"), F.col("c.band").alias("band"), F.col("c.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells: dict[tuple[str, int], dict[int, int]] = {}
    for name, band, at, n in counts.collect():
        cells.setdefault((name, band), {})[at] = n
    return {cell: line(histogram, rate) for cell, histogram in cells.items()}


def line(histogram: dict[int, int], rate: float = RATE) -> int:
    """The first bin that is not reported, from the number of candidates in each bin of p."""
    upper = lambda b: 10.0 ** (-b / BINS_EACH)
    total = sum(histogram.values())
    worst_first = sorted(histogram, reverse=True)
    # Benjamini and Hochberg: the largest p at which enough candidates are as small
    out, so_far = FLOOR * BINS_EACH + 1, 0
    for b in worst_first:
        so_far += histogram[b]
        if upper(b) <= rate * so_far / total:
            out = b
    # Storey: keys are twice the candidates above 1/2, one more than seen, so that few candidates are not judged by chance
    half = math.log10(2) * BINS_EACH
    keys = 2 * (sum(n for b, n in histogram.items() if b + 1 <= half) + 1)
    reported = sum(n for b, n in histogram.items() if b < out)
    for b in worst_first:
        if b >= out:
            continue
        if reported - keys * (1 - upper(b + 1)) <= rate * reported:
            break
        out, reported = b, reported - histogram[b]
    return out


def ranked(found: Column, rank: int) -> Column:
    """array<struct<start, rank, end>>, in which order spans are sorted."""
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end")))


def base(text: Column) -> Column:
    """array<struct<start, rank, end>> of the fixed patterns, by start, then by kind as listed."""
    parts = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        hits = spans(text, pattern)
        if kind == "assign":
            hits = F.filter(hits, lambda h: F.length(F.regexp_replace(h["hit"], _VALUE, "")) >= LEAST_VALUE)
        parts.append(ranked(hits, rank))
    return F.array_sort(F.concat(*parts))


def joined(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in (*PATTERNS, "random")])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each row.

    Places are code points, ends exclusive. Null text counts as empty and has
    no spans. Texts are read whole; keys of any length are tested. Repeated
    rows give repeated rows and count as often in the false-discovery control.
    Columns other than doc_id and text are not read. No rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body"))
    # the only pass over the texts; what it leaves is small
    found = written(texts.select("doc_id", base(F.col("body")).alias("base"), candidates(F.col("body")).alias("candidates")), "candidates")
    limits = cutoffs(found, rate)
    limit = F.lit(FLOOR * BINS_EACH + 1)

    def random_enough(c: Column) -> Column:
        out = limit
        for (name, band), b in sorted(limits.items()):
            out = F.when((c["encoding"] == name) & (c["band"] == band), F.lit(b)).otherwise(out)
        return c["bin"] < out

    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = ranked(F.filter("candidates", lambda c: random_enough(c) & free(c)), len(PATTERNS))
    count = lambda r: F.size(F.filter("base", lambda b: b["rank"] == r)).cast("long")
    return found.select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(PATTERNS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
