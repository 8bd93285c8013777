"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field reads word shapes, is trained by
gradient ascent on a small labelled table, and is decoded by Viterbi in numpy,
many chains at a time. A chain is a run of words around one that holds a digit,
an at sign or a bracketed "at": every word within REACH words of such a word
belongs to it. What the field labels is added where it passes the check of its
kind and overlaps no base span.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
REACH = 4
#: Rows of the labelled table, and passes over it.
TABLE_ROWS = 600
EPOCHS = 80
#: Words of one padded block of chains that is decoded at a time.
DECODE_WORDS = 20_000

Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_HOT = re.compile(r"[0-9@]|[\[(][aA][tT][\])]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each at sign to both sides."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then by kind as listed."""
    found: list[Span] = emails(text)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The conditional random field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CUES = frozenset("phone tel call fax mobile cell mail email e-mail contact write ip host server address card visa credit order id no nr ref invoice".split())
_TRIM = "\"'.,;:!?<>{}|%&*#$=~`"
Token = tuple[int, int, str]


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """Words with their places, without marks at either end."""
    out = []
    for m in _WORDS.finditer(text, start, len(text) if end is None else end):
        word = m[0].rstrip(_TRIM)
        bare = word.lstrip(_TRIM)
        if bare:
            at = m.start() + len(word) - len(bare)
            out.append((at, at + len(bare), bare))
    return out


def shape(word: str) -> str:
    """Letters as x or X, runs of digits with their length, other characters kept."""
    out, last, run = [], "", 0
    for c in word:
        s = "d" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        if s == last and s in "dxX":
            run += 1
            continue
        if last == "d":
            out.append(str(min(run, 9)))
        out.append(s)
        last, run = s, 1
    if last == "d":
        out.append(str(min(run, 9)))
    return "".join(out)


def features(shapes: list[str], words: list[str], i: int) -> list[str]:
    before = shapes[i - 1] if i else "<"
    after = shapes[i + 1] if i + 1 < len(shapes) else ">"
    word = words[i]
    digits = sum(c.isdigit() for c in word)
    out = [f"0{shapes[i]}", f"-{before}", f"+{after}", f"-0{before} {shapes[i]}", f"0+{shapes[i]} {after}", f"d{min(digits, 20)}"]
    if "@" in word:
        out.append("at")
    for j in (i - 1, i - 2):
        if j >= 0 and (cue := words[j].lower()) in CUES:
            out.append(f"c{i - j}{cue}")
    return out


class Crf:
    """Emission weights by feature, and transitions between the labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.move, self.first = index, emit, move, first

    def scores(self, words: list[str]) -> np.ndarray:
        shapes = [shape(w) for w in words]
        out = np.zeros((len(words), len(LABELS)))
        for i in range(len(words)):
            ids = [k for f in features(shapes, words, i) if (k := self.index.get(f)) is not None]
            out[i] = self.emit[ids].sum(0)
        return out

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain of emission scores, all chains of a block together."""
        out: list[np.ndarray | None] = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        at = 0
        while at < len(order):
            stop, longest = at, 0
            while stop < len(order) and (stop == at or (stop - at + 1) * len(chains[order[stop]]) <= DECODE_WORDS):
                longest = len(chains[order[stop]])
                stop += 1
            block = order[at:stop]
            lengths = np.array([len(chains[k]) for k in block])
            x = np.zeros((len(block), longest, len(LABELS)))
            for r, k in enumerate(block):
                x[r, : lengths[r]] = chains[k]
            best = x[:, 0] + self.first
            back = np.zeros((longest, len(block), len(LABELS)), np.int8)
            for t in range(1, longest):
                total = best[:, :, None] + self.move[None]
                back[t] = total.argmax(1)
                step = total.max(1) + x[:, t]
                best = np.where((t < lengths)[:, None], step, best)
            label = best.argmax(1)
            path = np.zeros((len(block), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                live = t < lengths
                path[live, t] = label[live]
                if t:
                    label = np.where(live, back[t][np.arange(len(block)), label], label)
            for r, k in enumerate(block):
                out[k] = path[r, : lengths[r]]
            at = stop
        return out


Row = tuple[str, list[Span]]


def labelled_table(rows: int = TABLE_ROWS, seed: int = 11) -> list[Row]:
    """The small labelled table: sentences of invented words with data written in many ways.

    About half of the rows hold none, only numbers that look alike: amounts,
    versions, years, order numbers, ratios and identifiers.
    """
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = ["an", "er", "ti", "on", "le", "ou", "de", "sch", "ción", "eau", "th", "ra", "ung", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = digits(15)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    area, local = lambda: digits(3), lambda: f"{digits(3)}-{digits(4)}"
    private = {
        "phone": [
            lambda: f"+{rng.randint(1, 99)} ({area()}) {local()}", lambda: f"({area()}) {local()}", lambda: f"{area()}-{local()}",
            lambda: f"{area()}.{digits(3)}.{digits(4)}", lambda: f"{area()} {digits(3)} {digits(4)}", lambda: f"+{rng.randint(1, 99)} {digits(3)} {digits(7)}",
        ],
        "email": [
            lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()} @ {word()}.com",
            lambda: f"{word()} [at] {word()}.com", lambda: f"{word()}(at){word()}.net", lambda: f"{word()}.{word()} (at) {word()}.example.org",
        ],
        "ip": [lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)) + f":{digits(4)}"],
        "card": [card],
    }
    plain = [
        lambda: digits(rng.randint(1, 6)), lambda: digits(16), lambda: digits(rng.randint(7, 20)), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)}.{digits(2)}",
        lambda: f"19{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), lambda: f"{word()}{digits(3)}", lambda: f"{digits(3)} {digits(3)}", lambda: f"@{word()}", lambda: f"{digits(1)},{digits(3)}",
    ]
    cues = {"phone": ["phone", "tel", "call", "fax"], "email": ["mail", "contact", "write"], "ip": ["ip", "host", "server"], "card": ["card", "visa"]}
    out = []
    for _ in range(rows):
        text, spans = "", []
        parts: list[tuple[str | None, str]] = [(None, word()) for _ in range(rng.randint(0, 5))]
        kind = rng.choice([*KINDS, None, None, None, None])
        if kind:
            if rng.random() < 0.5:
                parts.append((None, rng.choice(cues[kind])))
            parts.append((kind, rng.choice(private[kind])()))
            if rng.random() < 0.25:  # another number right after it
                parts.append((None, rng.choice(plain)()))
        else:
            if rng.random() < 0.3:
                parts.append((None, rng.choice(["order", "id", "no", "ref", "invoice"])))
            parts += [(None, rng.choice(plain)()) for _ in range(rng.randint(1, 2))]
        parts += [(None, word()) for _ in range(rng.randint(0, 5))]
        for k, p in parts:
            text += " " if text else ""
            if k:
                spans.append((len(text), len(text) + len(p), k))
            text += p + (rng.choice(["", "", "", ".", ","]) if p else "")
        out.append((text, spans))
    return out


def _gold(row: Row) -> tuple[list[str], list[int]]:
    text, spans = row
    toks = tokens(text)
    labels, last = [], None
    for start, end, _ in toks:
        hit = next((s for s in spans if start < s[1] and s[0] < end), None)
        labels.append(0 if hit is None else LABELS.index(("I-" if hit is last else "B-") + hit[2]))
        last = hit
    return [t[2] for t in toks], labels


def train(table: list[Row], epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam, all rows in one padded block. An empty table labels nothing."""
    pairs = [(w, y) for w, y in map(_gold, table) if w]
    index: dict[str, int] = {}
    feats = []
    for w, _ in pairs:
        shapes = [shape(x) for x in w]
        feats.append([[index.setdefault(f, len(index)) for f in features(shapes, w, i)] for i in range(len(w))])
    n, k = len(pairs), len(LABELS)
    emit, move, first = np.zeros((max(1, len(index)), k)), np.zeros((k, k)), np.zeros(k)
    if not n:
        first[0] = 1.0
        return Crf(index, emit, move, first)
    long = max(len(w) for w, _ in pairs)
    lengths = np.array([len(w) for w, _ in pairs])
    gold = np.zeros((n, long), int)
    x = np.zeros((n * long, len(index)), np.float32)
    for r, (_, y) in enumerate(pairs):
        gold[r, : len(y)] = y
        for t, ids in enumerate(feats[r]):
            x[r * long + t, ids] = 1
    live = np.arange(long)[None] < lengths[:, None]
    onehot = np.eye(k)[gold] * live[:, :, None]
    pairs_live = live[:, 1:]
    gold_moves = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:] * pairs_live[:, :, None])
    params = [emit, move, first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda a, axis: (t := a.max(axis, keepdims=True), np.squeeze(t, axis) + np.log(np.exp(a - t).sum(axis)))[1]
    for step in range(1, epochs + 1):
        s = (x @ emit).reshape(n, long, k)
        alpha, beta = np.zeros((n, long, k)), np.zeros((n, long, k))
        alpha[:, 0] = s[:, 0] + first
        for t in range(1, long):
            a = lse(alpha[:, t - 1, :, None] + move[None], 1) + s[:, t]
            alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
        for t in range(long - 2, -1, -1):
            b = lse(move[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        edge = np.zeros((k, k))
        for t in range(1, long):
            e = np.exp(alpha[:, t - 1, :, None] + move[None] + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            edge += (e * live[:, t, None, None]).sum(0)
        grads = [
            (x.T @ (onehot - node).reshape(n * long, k)) / n - ridge * emit,
            (gold_moves - edge) / n - ridge * move,
            (onehot[:, 0] - node[:, 0]).sum(0) / n - ridge * first,
        ]
        for p, g, mm, vv in zip(params, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return Crf(index, emit, move, first)


def chains(text: str) -> list[list[Token]]:
    """Words near one that holds a digit, an at sign or a bracketed at; near ones share a chain."""
    if not _HOT.search(text):
        return []
    toks = tokens(text)
    hot = [i for i, t in enumerate(toks) if _HOT.search(t[2])]
    out: list[list[Token]] = []
    at = 0
    while at < len(hot):
        lo = max(0, hot[at] - REACH)
        while at + 1 < len(hot) and hot[at + 1] - hot[at] <= 2 * REACH:
            at += 1
        out.append(toks[lo : hot[at] + REACH + 1])
        at += 1
    return out


_CHECKS: dict[str, Callable[[str], bool]] = {
    "email": lambda s: bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*(?:@|\[at\]|\(at\))\s*[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", s, re.I)),
    "ip": lambda s: bool(m := re.match(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)(?![0-9.])", s)) and all(int(x) <= 255 for x in m.groups()),
    "card": lambda s: bool(re.fullmatch(r"[0-9](?:[ -]?[0-9])+", s)) and 14 <= len(d := _DIGITS.sub("", s)) <= 19 and luhn(d),
    "phone": lambda s: bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", s)) and 10 <= len(_DIGITS.sub("", s)) <= 15 and bool(re.search(r"[ ().-]", s)),
}


def labelled_spans(toks: list[Token], labels: np.ndarray, text: str) -> list[Span]:
    """Runs of one kind that pass its check."""
    out: list[Span] = []
    for (start, end, _), y in zip(toks, labels, strict=True):
        name = LABELS[y]
        if name == "O":
            out.append((start, end, ""))
        elif name[0] == "I" and out and out[-1][2] == name[2:]:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((start, end, name[2:]))
    return [s for s in out if s[2] and _CHECKS[s[2]](text[s[0] : s[1]])]


def find(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _HOT.search(t) else [] for t in texts]
    where, scored = [], []
    for i, t in enumerate(texts):
        for c in chains(t):
            where.append((i, c))
            scored.append(model.scores([x[2] for x in c]))
    added: list[list[Span]] = [[] for _ in texts]
    for (i, c), labels in zip(where, model.decode(scored), strict=True):
        added[i] += labelled_spans(c, labels, texts[i])
    out = []
    for b, more in zip(base, added, strict=True):
        starts = np.array([s[0] for s in b])
        reach = np.maximum.accumulate(np.array([s[1] for s in b])) if b else starts
        free = []
        for s in more:
            k = int(np.searchsorted(starts, s[1])) if b else 0
            if k == 0 or reach[k - 1] <= s[0]:
                free.append(s)
        out.append((b, sorted(b + free, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of each row.

    Places are code points, ends exclusive. Null text counts as empty and has
    no spans. Texts are read whole at any length: each pattern takes time in
    proportion to it. Repeated rows give repeated rows. Columns other than
    doc_id and text are not read. No rows give no rows.
    """
    model = model or train(labelled_table())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = find([t or "" for t in batch.column("text").to_pylist()], model)
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([joined(a) for _, a in found], pa.string()),
                    pa.array([len(a) - len(b) for b, a in found], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_rows(rows, make, schema)
