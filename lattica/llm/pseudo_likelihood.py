"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the RADIUS tokens on either side, itself left
out; the sum of the conditional log-probabilities scores the document.

* Counts of all words of all documents give the vocabulary: the most frequent
  words, and for the others BUCKETS classes by their ending, inside which all
  words seen are equally likely.
* The network adds one vector for each neighbour (by its place), takes the
  hyperbolic tangent, and predicts a class of tokens and the token inside it.
* Every token of every document is the centre of one training window, in one of
  ROUNDS rounds. Each task runs stochastic gradient steps in numpy over its own
  windows; the weights are averaged in a tree of tasks after each round, as
  whole numbers of 2^-AVERAGED, so that the order of adding changes nothing. The
  driver receives a fixed number of models.
* Scores take weights and hidden values in steps of 2^-STEP. Products and sums
  of these are exact in single precision, whatever the shape of the block that
  a token is scored in, and log-probabilities are summed in steps of 2^-SUMMED:
  equal texts score alike to the last bit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_rows, plain_words, written

WORDS, BUCKETS, CLASS = 4096, 256, 68
RADIUS, WIDTH = 2, 24
ROUNDS, BATCH, RATE = 2, 8192, 0.16
#: Binary places of averaged weights, of scoring weights (up to LARGEST) and hidden values, and of log-probabilities.
AVERAGED, STEP, SUMMED = 16, 8, 20
LARGEST = 8.0
#: Tokens scored at a time, and rows of logits.
BLOCK, CHUNK = 65_536, 4096
#: Models summed by one task of the averaging tree, and distinct words counted at a time.
FAN_IN, COUNTED = 16, 200_000

OFFSETS = tuple(k for k in range(-RADIUS, RADIUS + 1) if k)


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """word, bucket and n over all documents; each task sends a word once for COUNTED distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counts)
            arrays = [pa.array(words, pa.string()), pa.array(map(bucket, words), pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "bucket", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for text in batch.column("text").slice(i, SLICE).to_pylist():
                    counts.update(plain_words(text))
                    if len(counts) > COUNTED:
                        yield flush()
        yield flush()

    rows = docs.select("text").mapInArrow(run, "word string, bucket int, n long")
    return rows.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


class Numbering(dict):
    """Identifiers of words; those of rare words are worked out once and kept, at most COUNTED of them."""

    def __init__(self, index: dict[str, int]):
        super().__init__(index)
        self.index = index

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self.index) + bucket(word)
        return found

    def trim(self) -> None:
        if len(self) > len(self.index) + COUNTED:
            self.clear()
            self.update(self.index)


@dataclass
class Vocabulary:
    """Identifiers of the frequent words, log-shares of all tokens, and what a word of a bucket costs."""

    index: dict[str, int]
    log_share: np.ndarray
    inside: np.ndarray

    @property
    def size(self) -> int:
        return len(self.log_share)

    def numbering(self) -> Numbering:
        return Numbering(self.index)

    def ids(self, words: list[str], numbers: Numbering | None = None) -> np.ndarray:
        numbers = self.numbering() if numbers is None else numbers
        numbers.trim()
        return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def vocabulary(docs: DataFrame, words: int = WORDS) -> Vocabulary:
    counts = written(word_counts(docs), "words")
    top = counts.orderBy(F.col("n").desc(), "word").limit(words)
    found = [(r[0], r[1]) for r in top.select("word", "n").collect()]
    found.sort(key=lambda x: (-x[1], x[0]))
    index = {w: k for k, (w, _) in enumerate(found)}
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti")
    totals, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n, different in rest.groupBy("bucket").agg(F.sum("n"), F.count(F.lit(1))).collect():
        totals[b], kinds[b] = n, different
    n = np.concatenate((np.array([x[1] for x in found], float), totals)) + 0.5
    inside = np.concatenate((np.zeros(len(found)), -np.log(kinds + 1)))
    return Vocabulary(index, np.log(n / n.sum()), inside)


class Network:
    """Weights, kept as one flat vector so that models can be averaged."""

    def __init__(self, size: int, flat: np.ndarray | None = None):
        self.size, self.classes = size, -(-size // CLASS)
        shapes = [(len(OFFSETS), size + 1, WIDTH), (WIDTH,), (WIDTH, self.classes), (self.classes,), (self.classes, WIDTH, CLASS), (self.classes, CLASS)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.flat = np.zeros(int(ends[-1]), np.float32) if flat is None else flat
        parts = np.split(self.flat, ends[:-1])
        self.near, self.bias, self.out, self.out_bias, self.inner, self.inner_bias = (p.reshape(s) for p, s in zip(parts, shapes, strict=True))

    @classmethod
    def start(cls, log_share: np.ndarray) -> Network:
        """Small random vectors, and biases that give each token its share."""
        net = cls(len(log_share))
        rng = np.random.default_rng(9)
        for w in (net.near, net.out, net.inner):
            w[:] = rng.normal(scale=0.1, size=w.shape)
        net.near[:, -1] = 0
        share = np.full(net.classes * CLASS, -30.0)
        share[: net.size] = log_share
        share = share.reshape(net.classes, CLASS)
        net.inner_bias[:] = share
        top = share.max(1)
        net.out_bias[:] = top + np.log(np.exp(share - top[:, None]).sum(1))
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.tile(self.bias, (len(around), 1))
        for k in range(len(OFFSETS)):
            h += self.near[k][around[:, k]]
        return np.tanh(h)

    def settled(self) -> Network:
        """The network with the weights of scoring."""
        net = Network(self.size, self.flat.copy())
        for w in (net.out, net.inner):
            np.clip(_stepped(w), -LARGEST, LARGEST, out=w)
        return net

    def by_class(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits inside the class of each row, which come by class; the classes that occur and where each begins."""
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        seen = group[first]
        ends = np.append(first[1:], len(group))
        logits = np.empty((len(h), CLASS), np.float32)
        for c, lo, hi in zip(seen.tolist(), first.tolist(), ends.tolist(), strict=True):
            np.matmul(h[lo:hi], self.inner[c], out=logits[lo:hi])
        logits += self.inner_bias[group]
        return logits, seen, np.append(first, len(group))

    def log_probabilities(self, around: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Of each centre, given the tokens around it; ``size`` stands for none."""
        order = _order(centre // CLASS)
        out = np.empty(len(around))
        for lo in range(0, len(order), CHUNK):
            part = order[lo : lo + CHUNK]
            group, place = np.divmod(centre[part], CLASS)
            h = _stepped(self.hidden(around[part]))
            own = _picked(h @ self.out + self.out_bias, group).astype(np.float64)
            out[part] = own + _picked(self.by_class(h, group)[0], place)
        return out

    def train(self, windows: np.ndarray, rate: float, squares: np.ndarray) -> None:
        """One pass of Adagrad steps; ``squares`` is the running sum for each weight."""
        adapted = Network(self.size, squares)

        def move(weight: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
            seen += grad * grad
            weight -= rate * grad / (np.sqrt(seen) + 1e-6)

        sides = [k for k in range(2 * RADIUS + 1) if k != RADIUS]
        for lo in range(0, len(windows), BATCH):
            part = windows[lo : lo + BATCH]
            part = part[_order(part[:, RADIUS])]
            n = len(part)
            every = np.arange(n)
            around = part[:, sides]
            group, place = np.divmod(part[:, RADIUS], CLASS)
            h = self.hidden(around)
            g = _softmax(h @ self.out + self.out_bias)
            g[every, group] -= 1
            g /= n
            dh = g @ self.out.T
            move(self.out, adapted.out, h.T @ g)
            move(self.out_bias, adapted.out_bias, g.sum(0))
            g, seen, cuts = self.by_class(h, group)
            g = _softmax(g)
            g[every, place] -= 1
            g /= n
            grad = np.empty((len(seen), WIDTH, CLASS), np.float32)
            for k, c in enumerate(seen.tolist()):
                own = slice(cuts[k], cuts[k + 1])
                dh[own] += g[own] @ self.inner[c].T
                np.matmul(h[own].T, g[own], out=grad[k])
            grads = ((self.inner, adapted.inner, grad), (self.inner_bias, adapted.inner_bias, np.add.reduceat(g, cuts[:-1], axis=0)))
            for weight, squared, grad in grads:
                squared[seen] += grad * grad
                weight[seen] -= rate * grad / (np.sqrt(squared[seen]) + 1e-6)
            dh *= 1 - h * h
            move(self.bias, adapted.bias, dh.sum(0))
            for k in range(len(OFFSETS)):
                order = _order(around[:, k])
                tokens = around[order, k]
                first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                rows = tokens[first]
                grad = np.add.reduceat(dh[order], first, axis=0)
                squared = adapted.near[k][rows] + grad * grad
                adapted.near[k][rows] = squared
                self.near[k][rows] -= rate * grad / (np.sqrt(squared) + 1e-6)


def _order(ids: np.ndarray) -> np.ndarray:
    """Places by identifier; short integers are sorted by their digits."""
    return np.argsort(ids.astype(np.int16), kind="stable")


def _stepped(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to steps of 2^-STEP."""
    return np.rint(x * np.float32(1 << STEP)) * np.float32(2.0**-STEP)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _picked(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log-probability of one column for each row of logits, which are overwritten."""
    x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    return own - np.log(x.sum(1))


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id and ids: the tokens of each document as int16, written to the shared folder, since training and scores read them again."""

    def make():
        numbers = vocab.numbering()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [vocab.ids(plain_words(t), numbers).astype("<i2").tobytes() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

        return step

    return written(map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids binary"), "tokens")


def padded(ids: list[np.ndarray], filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents in one line with RADIUS fillers before each and after all, places of the tokens, and the document of each."""
    fill = np.full(RADIUS, filler, np.int32)
    line = np.concatenate([x for own in ids for x in (fill, own)] + [fill])
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    places = np.arange(len(owner)) + RADIUS * (owner + 1)
    return line, places, owner


def training_windows(batch: pa.RecordBatch, filler: int, turn: int, turns: int) -> np.ndarray:
    """Windows of 2 RADIUS + 1 tokens around the tokens of each document whose turn it is: every ``turns``-th one."""
    line, places, owner = padded(_arrays(batch), filler)
    starts = np.searchsorted(owner, owner)
    phase = np.array([xxhash.xxh32_intdigest(str(d)) for d in batch.column("doc_id").to_pylist()], np.int64)
    chosen = places[(np.arange(len(owner)) - starts + phase[owner]) % turns == turn]
    return line[chosen[:, None] + np.arange(-RADIUS, RADIUS + 1)]


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2") for x in batch.column("ids").to_pylist()]


def fit(tokens: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network trained on ``encoded`` tokens; without any token it predicts their shares."""
    net = Network.start(vocab.log_share)
    size = net.size

    def local(flat: bytes, rate: float, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Network(size, np.frombuffer(flat, np.float32).copy())
            squares = np.full(len(own.flat), 1e-6, np.float32)
            n = 0
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = training_windows(batch.slice(i, SLICE), size, turn, rounds)
                    own.train(part, rate, squares)
                    n += len(part)
            if n:
                yield _model_batch(_whole(own.flat) * n, n)

        return run

    for k in range(rounds):
        models = tokens.mapInArrow(local(net.flat.tobytes(), RATE / (k + 1), k), "model binary, n long")
        tasks = models.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            models = models.repartition(tasks).mapInArrow(_add_models, "model binary, n long")
        total, n = np.zeros(len(net.flat), np.int64), 0
        for r in models.collect():
            total += np.frombuffer(r[0], np.int64)
            n += r[1]
        if n:
            net = Network(size, (total / n / (1 << AVERAGED)).astype(np.float32))
    return net.settled()


def _whole(flat: np.ndarray) -> np.ndarray:
    """Weights as whole numbers of 2^-AVERAGED; a biased class that never occurs is near -30, so sums of 2^40 tokens fit."""
    return np.rint(flat * np.float64(1 << AVERAGED)).astype(np.int64)


def _model_batch(total: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["model", "n"])


def _add_models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for data, weight in zip(batch.column("model"), batch.column("n").to_pylist(), strict=True):
            own = np.frombuffer(data.as_py(), np.int64)
            total, n = own.copy() if total is None else total + own, n + weight
    if total is not None:
        yield _model_batch(total, n)


def score_ids(ids: list[np.ndarray], inside: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each document, and the sum of their conditional log-probabilities."""
    line, places, owner = padded(ids, net.size)
    sums = np.zeros(len(ids))
    shift = np.array(OFFSETS)
    for lo in range(0, len(places), BLOCK):
        part = places[lo : lo + BLOCK]
        centre = line[part]
        logs = net.log_probabilities(line[part[:, None] + shift], centre) + inside[centre]
        sums += np.bincount(owner[lo : lo + BLOCK], np.rint(logs * (1 << SUMMED)), len(ids))
    return np.bincount(owner, minlength=len(ids)), sums / (1 << SUMMED)


def score_texts(texts: list[str | None], vocab: Vocabulary, net: Network) -> tuple[np.ndarray, np.ndarray]:
    return score_ids([vocab.ids(plain_words(t)) for t in texts], vocab.inside, net)


def score(tokens: DataFrame, vocab: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_probability of each row of ``encoded`` tokens."""
    inside = vocab.inside

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, sums = score_ids(_arrays(batch), inside, net)
            means = [float(s / k) if k else None for s, k in zip(sums, n, strict=True)]
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"])

        return step

    return map_rows(tokens, make, "doc_id long, n_tokens long, log_likelihood double, mean_log_probability double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_probability, by a network trained on ``docs`` itself.

    Null texts and texts without letters or digits have no tokens, the sum 0
    and no mean. Texts are read whole, in blocks of tokens. Repeated rows score
    alike. Columns other than doc_id and text are not read. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocab = vocabulary(rows)
    tokens = encoded(rows, vocab)
    return score(tokens, vocab, fit(tokens, vocab))
