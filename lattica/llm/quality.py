"""Quality scores by a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts, each from the errors
the former ones leave. Every path from a root to a node is a rule: a
conjunction of comparisons. A logistic model with a lasso penalty weighs the
rules; those with a weight of zero are dropped, and the rest are compiled into
one Spark column expression, so that scoring runs inside the query plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

#: The bounded sample of labelled rows that is fitted, by hash order.
SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 3
CUTS = 24
SHRINKAGE = 0.2
LASSO = 0.002
STEPS = 1500

Condition = tuple[str, str, float]


def statistics() -> dict[str, Column]:
    """Statistics of the whole text in ``body`` and its words in ``words``."""
    body = F.col("body")
    chars = F.greatest(F.char_length(body), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("double")
    n_words = F.greatest(F.size("words"), F.lit(1)).cast("double")
    return {
        "words_log": F.log1p(F.size("words").cast("double")),
        "chars_each": F.char_length(body) / n_words,
        "upper": count("[A-Z]") / chars,
        "digits": count("[0-9]") / chars,
        "marks": count(r"[^\p{L}0-9\s]") / chars,
        "odd_marks": count(r"[#$%&*|<>{}\[\]\\^~=_@]") / chars,
        "shouts": count("!") / chars,
        "distinct": F.size(F.array_distinct("words")) / n_words,
        "pair_repeats": F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)\x20\1(?![^\x20\x09-\x0D])")) / n_words,
        "sentence": count("[.!?]") / n_words,
        "short": F.size(F.filter("words", lambda w: F.length(w) <= 3)) / n_words,
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, body and one double column for each statistic."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")).withColumn(
        "words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    )
    return base.select("doc_id", *[v.cast("double").alias(k) for k, v in statistics().items()])


@dataclass
class Rules:
    """Conjunctions and their weights, with the intercept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The score between 0 and 1 as an expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for name, op, cut in rule:
                test = test & (F.col(name) <= F.lit(cut) if op == "<=" else F.col(name) > F.lit(cut))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * holds(rule, x, names)
        return 1 / (1 + np.exp(-z))


def holds(rule: tuple[Condition, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        out &= v <= cut if op == "<=" else v > cut
    return out


def _grow(x, target, hess, rows, names, cuts, depth, path, out):
    """Appends the rules of one tree; gives the fitted value of each of ``rows``."""
    g, h = target[rows].sum(), hess[rows].sum()
    value = np.full(len(rows), g / (h + 1.0))
    if depth == 0 or len(rows) < 20:
        return value
    base, best = g * g / (h + 1.0), (1e-6, None)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        slot = np.searchsorted(edges, x[rows, j], side="left")
        gs = np.cumsum(np.bincount(slot, target[rows], len(edges) + 1))[:-1]
        hs = np.cumsum(np.bincount(slot, hess[rows], len(edges) + 1))[:-1]
        ns = np.cumsum(np.bincount(slot, minlength=len(edges) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - base
        gain[(ns < 8) | (len(rows) - ns < 8)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (j, float(edges[k])))
    if best[1] is None:
        return value
    j, cut = best[1]
    left = x[rows, j] <= cut
    for side, op in ((left, "<="), (~left, ">")):
        rule = (*path, (names[j], op, cut))
        out.append(rule)
        value[side] = _grow(x, target, hess, rows[side], names, cuts, depth - 1, rule, out)
    return value


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[tuple[Condition, ...]]:
    """All paths of boosted trees, each half of the rows by turns, without repeats."""
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])) for v in x.T]
    rng = np.random.default_rng(7)
    z = np.zeros(len(x))
    out: list[tuple[Condition, ...]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(x))[: max(1, len(x) // 2)])
        made: list[tuple[Condition, ...]] = []
        _grow(x, y - p, p * (1 - p), rows, names, cuts, DEPTH, (), made)
        out += made
        # the tree's fitted values on all rows: those of its leaves
        leaves = [r for r in made if not any(len(o) > len(r) and o[: len(r)] == r for o in made)]
        for r in leaves:
            mask = holds(r, x, names)
            z[mask] += SHRINKAGE * (y - p)[mask].sum() / ((p * (1 - p))[mask].sum() + 1.0)
    return list(dict.fromkeys(out))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is free."""
    n, m = a.shape
    a = a.astype(np.float64)
    mean = a.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    b = (a - mean) / spread
    v = np.random.default_rng(3).normal(size=m)
    for _ in range(30):
        v = b.T @ (b @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * (np.linalg.norm(b @ v) ** 2 / n) + 0.25)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, c = np.zeros(m), float(np.log(share / (1 - share)))
    u, d, t = w, c, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(b @ u + d))) - y
        w2 = u - rate * (b.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        c2 = d - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, d = w2 + (t - 1) / t2 * (w2 - w), c2 + (t - 1) / t2 * (c2 - c)
        w, c, t = w2, c2, t2
    return w / spread, float(c - (w / spread) @ mean)


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    """Rules from labelled statistics; no rows give the constant 1/2."""
    if not len(y):
        return Rules()
    y = y.astype(np.float64)
    rules = tree_rules(x, y, names)
    if not rules:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        return Rules(intercept=float(np.log(share / (1 - share))))
    weights, intercept = lasso_logistic(np.stack([holds(r, x, names) for r in rules], 1), y)
    kept = [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return Rules([r for r, _ in kept], [w for _, w in kept], intercept)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Rules:
    """Rules fitted to at most ``rows`` labelled documents, those whose ids hash lowest.

    ``labels`` has doc_id and quality. The sample of ids is drawn first (a
    top-k that each task reduces), then only its texts are read.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    names = list(statistics())
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    found = with_statistics(texts).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *names)
    table = found.toPandas().sort_values(["doc_id", *names])
    return fit(table[names].to_numpy(float), (table["quality"].to_numpy() > 0).astype(float), names)


def score(docs: DataFrame, rules: Rules, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) for each row of ``docs``.

    Null texts count as empty, and empty texts are scored by their statistics
    like any other. Ties and repeated rows score alike. Columns other than
    doc_id and text are not read. No rows give no rows.
    """
    scored = with_statistics(docs).select("doc_id", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
