"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into pieces of at most PIECE words. Their words,
   but for those in over MAX_SHARE of all documents, are the features; their
   document frequencies are counted over every document.
2. A randomised singular value decomposition of the TF-IDF matrix of passages
   gives the latent space. The passages are those of all documents and all
   pieces; their products with the range are taken in parallel and summed in a
   tree of tasks, as whole numbers of 2^-SUMMED, so the driver holds features x
   RANK numbers and the order of adding changes nothing. Words are read once:
   what follows works on their numbers in the benchmark.
3. Every passage of every document is folded into the space, and pieces whose
   cosine reaches MIN_COSINE are candidates; so are those that have two
   neighbouring features in common with it, which no verbatim copy lacks.
4. A candidate counts when the longest common subsequence of words covers
   enough of the piece: PLAIN of it, or ANSWERED of it where the answer of the
   item stands nearby too. So verbatim copies and paraphrases are found, and
   passages on the same subject are not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_rows, plain_words, written

PIECE = 32
#: Words of a block, and blocks of a passage: one starts at each block, and any piece lies within one.
BLOCK, BLOCKS = 16, 3
RANK, EXTRA, POWERS = 128, 16, 2
#: Weight of the pieces among the passages of WEIGHED_DOCS documents, so that the space tells them apart in corpora of any size.
PIECE_WEIGHT, WEIGHED_DOCS = 20.0, 3000
#: Binary places of summed products, sums added by one task, and features of passages multiplied at a time.
SUMMED, FAN_IN, CHUNK = 24, 8, 1 << 14
MAX_SHARE = 0.1
MIN_COSINE = 0.35
PLAIN, ANSWERED = 0.7, 0.5
ANSWER_WORDS = 4
#: Cells of a table of passages by words that is held at a time, and candidates tested by it at a time.
HELD, TESTED = 1 << 25, 1 << 15
#: Items searched in one pass, which bounds what is sent to the tasks.
BLOCK_ITEMS = 2000


@dataclass
class Piece:
    item_id: int
    words: list[str]
    answer: tuple[str, ...]

    def masks(self) -> dict[str, int]:
        return word_masks(self.words)


def word_masks(words: list) -> dict:
    """The places of each word as bits."""
    out: dict = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def pieces_of(items: list[tuple[int, str | None]]) -> list[Piece]:
    """Pieces of each item; what is left at its end is filled up from before. Items without words have none."""
    out = []
    for item_id, text in items:
        words = plain_words(text)
        question, _, rest = (text or "").rpartition("?")
        answer = tuple((plain_words(rest) if question and plain_words(rest) else words)[-ANSWER_WORDS:])
        for k in range(0, len(words), PIECE):
            part = words[k : k + PIECE] if k + PIECE <= len(words) or k == 0 else words[-PIECE:]
            out.append(Piece(item_id, part, answer))
    return out


def lcs(masks: dict[str, int], length: int, words: list[str]) -> int:
    """Length of the longest common subsequence, one machine step for each word (bit-parallel)."""
    full = (1 << length) - 1
    s = full
    for w in words:
        if m := masks.get(w):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def encoded(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """doc_id and ids: the number of each word of a text, -1 for words that no piece has, written to the shared folder."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                words = plain_words(text)
                out.append(np.fromiter(map(numbers.get, words, repeat(-1)), "<i4", len(words)).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

        return step

    return written(map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids binary"), "coded")


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in batch.column("ids").to_pylist()]


def document_frequency(coded: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of documents, and how many have each word. At most one row a word is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(words + 1, np.int64)
        for batch in batches:
            for ids in _arrays(batch):
                seen = np.unique(ids)
                counts[seen[seen >= 0]] += 1
            counts[words] += batch.num_rows
        have = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(counts[have], pa.int64())], ["word", "n"])

    out = np.zeros(words + 1, np.int64)
    for r in coded.select("ids").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return int(out[words]), out[:words]


@dataclass
class Space:
    """Vectors of the features in the latent space, weighted by idf; the pieces and their vectors.

    ``feature`` has the feature of each word, -1 for none, and -1 at its end for
    words that no piece has; ``words`` and ``answers`` are those of the pieces
    in numbers. ``padded`` has the words as rows of PIECE, filled up with the
    number that no word has, and ``lengths`` how many they are. ``pairs`` are the sorted codes of neighbouring features of the
    pieces, ``paired`` the piece of each.
    """

    feature: np.ndarray
    words: list[list[int]]
    answers: list[list[int]]
    vectors: np.ndarray
    pieces: list[Piece]
    queries: np.ndarray
    pairs: np.ndarray
    paired: np.ndarray
    padded: np.ndarray
    lengths: np.ndarray


def passages(ids: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and the block of BLOCK words that each stands in."""
    own = feature[ids]
    at = np.flatnonzero(own >= 0)
    return own[at], at // BLOCK


def neighbours(ids: np.ndarray, features: int) -> np.ndarray:
    """A code of each feature with the next one."""
    return ids[:-1].astype(np.int64) * features + ids[1:]


def folded(ids: np.ndarray, blocks: np.ndarray, total: int, vectors: np.ndarray) -> np.ndarray:
    """The summed vectors of each of ``total`` blocks. ``blocks`` does not fall."""
    out = np.zeros((total, vectors.shape[1]), np.float32)
    if len(ids):
        first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        out[blocks[first]] = np.add.reduceat(vectors[ids], first, axis=0)
    return out


def _range_step(features: np.ndarray, passage: np.ndarray, idf: np.ndarray, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A basis) to ``out`` for passages as idf-weighted rows of length 1. ``passage`` does not fall."""
    if not len(features):
        return
    key, tf = np.unique(passage.astype(np.int64) * len(idf) + features, return_counts=True)
    rows, f = np.divmod(key, len(idf))
    begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    lo = 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + CHUNK)))
        part = slice(begins[lo], begins[hi] if hi < len(begins) else len(key))
        first = begins[lo:hi] - begins[lo]
        own = f[part]
        sizes = np.diff(np.append(first, len(own)))
        x = (tf[part] * idf[own]).astype(np.float32)
        x /= np.repeat(np.sqrt(np.add.reduceat(x * x, first)), sizes)
        rows_ = x[:, None] * basis[own]
        y = np.repeat(np.add.reduceat(rows_, first, axis=0), sizes, axis=0)
        y *= x[:, None]
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        out[own[order][cuts]] += np.add.reduceat(y[order], cuts, axis=0)
        lo = hi


def fit(coded: DataFrame, pieces: list[Piece], numbers: dict[str, int]) -> Space | None:
    """The latent space for ``pieces`` over all passages of ``encoded`` documents; None where they have no usable word."""
    n, df = document_frequency(coded, len(numbers))
    most = max(1, MAX_SHARE * n)
    words = [[numbers[w] for w in p.words] for p in pieces]
    usable = set(np.flatnonzero(df <= most).tolist())
    # pieces made of frequent words alone are searched by them
    for own in words:
        if not any(df[w] <= most for w in own):
            usable.update(own)
    if not usable:
        return None
    kept = np.array(sorted(usable))
    feature = np.full(len(numbers) + 1, -1, np.int32)
    feature[kept] = np.arange(len(kept))
    idf = (np.log((n + 1) / (df[kept] + 1)) + 1).astype(np.float32)
    own = [f[f >= 0] for f in (feature[w] for w in words)]

    width = min(RANK + EXTRA, len(kept))
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(len(kept), width)))[0].astype(np.float32)
    passage = np.repeat(np.arange(len(own)), [len(x) for x in own])
    for _ in range(POWERS):
        total = np.zeros(basis.shape)
        _range_step(np.concatenate(own), passage, idf, basis, total)
        total *= PIECE_WEIGHT
        sums = coded.select("ids").mapInArrow(_summed(feature, idf, basis), "z binary")
        tasks = sums.rdd.getNumPartitions()
        # one sum reaches the driver: features x RANK numbers take megabytes, and collecting holds several copies of each row
        while tasks > 1:
            tasks = -(-tasks // FAN_IN)
            sums = sums.repartition(tasks).mapInArrow(_added, "z binary")
        whole = np.zeros(total.shape, np.int64)
        for r in sums.collect():
            whole += np.frombuffer(r[0], "<i8").reshape(total.shape)
        total += whole / (1 << SUMMED) * min(1.0, WEIGHED_DOCS / max(1, n))
        q, r = np.linalg.qr(total)
        basis = q.astype(np.float32)
    # total = (A'A) times the former range, so its triangle orders the directions by strength
    u, _, _ = np.linalg.svd(r)
    basis = (basis @ u[:, :RANK]).astype(np.float32)
    vectors = idf[:, None] * basis
    queries = np.stack([vectors[k].sum(0) for k in own])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    codes = [np.unique(neighbours(k, len(kept))) for k in own]
    pairs, paired = np.concatenate(codes), np.repeat(np.arange(len(own)), [len(c) for c in codes])
    order = np.argsort(pairs, kind="stable")
    answers = [[numbers[w] for w in p.answer] for p in pieces]
    padded = np.array([k + [len(numbers)] * (PIECE - len(k)) for k in words])
    return Space(feature, words, answers, vectors, pieces, queries, pairs[order], paired[order], padded, np.array([len(k) for k in words]))


def _summed(feature: np.ndarray, idf: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                parts = [passages(ids, feature) for ids in _arrays(batch.slice(i, SLICE))]
                # two blocks are a passage here
                ends = np.cumsum([len(own) and int(at[-1]) // 2 + 1 for own, at in parts])
                places = [at // 2 + (e - int(at[-1]) // 2 - 1) for (own, at), e in zip(parts, ends, strict=True) if len(own)]
                if places:
                    _range_step(np.concatenate([own for own, _ in parts if len(own)]), np.concatenate(places), idf, basis, total)
        yield _sum_batch(np.rint(total * (1 << SUMMED)).astype("<i8"))

    return run


def _sum_batch(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["z"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("z"):
            own = np.frombuffer(data.as_py(), "<i8")
            total = own.copy() if total is None else total + own
    if total is not None:
        yield _sum_batch(total)


Found = tuple[int, int, float, float, bool]


def _covered(places: np.ndarray, present: np.ndarray, numbers: int, space: Space) -> Iterator[tuple[int, int]]:
    """(passage, piece) of the candidates that have ANSWERED of the piece's words within reach, in any order.

    ``places`` are the candidates' in a table of passages by pieces, ``present``
    whether a passage has a word, ``numbers`` for each. This rules out most of
    them, and only those that the subsequence would rule out too.
    """
    for i in range(0, len(places), TESTED):
        at, k = np.divmod(places[i : i + TESTED], len(space.pieces))
        have = present[at[:, None] * numbers + space.padded[k]].sum(1)
        passed = np.flatnonzero(have >= ANSWERED * space.lengths[k])
        yield from zip(at[passed].tolist(), k[passed].tolist(), strict=True)


def search(ids: list[int], split: list[np.ndarray], space: Space) -> list[Found]:
    """(doc_id, item_id, cosine, covered, answered) of the pieces found in the numbered words ``split``, the best for each pair."""
    parts = [passages(w, space.feature) for w in split]
    sizes = np.array([-(-len(w) // BLOCK) for w in split])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    all_ids = np.concatenate([p[0] for p in parts])
    all_blocks = np.concatenate([p[1] + s for p, s in zip(parts, starts, strict=False)])
    blocks = folded(all_ids, all_blocks, int(starts[-1]), space.vectors)
    if not len(blocks):
        return []
    owner = np.repeat(np.arange(len(split)), sizes)
    windows = blocks.copy()
    for k in range(1, BLOCKS):
        same = np.flatnonzero(owner[k:] == owner[:-k])
        windows[same] += blocks[same + k]
    windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
    # passages and pieces that have neighbouring features in common
    codes = neighbours(all_ids, len(space.vectors))
    first = np.searchsorted(space.pairs, codes)
    lengths = np.searchsorted(space.pairs, codes, "right") - first
    lengths[owner[all_blocks[1:]] != owner[all_blocks[:-1]]] = 0
    shift = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
    at_block, at_piece = np.repeat(all_blocks[:-1], lengths), space.paired[shift + np.arange(len(shift))]
    shared_at = np.concatenate([at_block - k for k in range(BLOCKS)])
    shared_piece = np.tile(at_piece, BLOCKS)
    same = (shared_at >= 0) & (owner[shared_at] == owner[np.tile(at_block, BLOCKS)])
    shared_at, shared_piece = shared_at[same], shared_piece[same]
    order = np.argsort(shared_at, kind="stable")
    shared_at, shared_piece = shared_at[order], shared_piece[order]
    # the words within reach of each passage, BLOCK // 2 more on both sides
    numbers = len(space.feature)
    lengths = np.array([len(w) for w in split])
    text = np.concatenate(split)
    of = np.repeat(np.arange(len(split)), lengths)
    last_block = (np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + BLOCK // 2) // BLOCK
    known = np.flatnonzero(text >= 0)
    text, of, last_block = text[known], of[known], last_block[known]
    reach = []
    for k in range(BLOCKS + 1):
        within = np.flatnonzero((last_block >= k) & (last_block - k < sizes[of]))
        reach.append((starts[of[within]] + last_block[within] - k, text[within]))
    rows = max(1, min(8192, HELD // numbers))
    best: dict[tuple[int, int], tuple] = {}
    masks: dict[int, dict[int, int]] = {}
    last, words = -1, []
    for lo in range(0, len(windows), rows):
        cosines = windows[lo : lo + rows] @ space.queries.T
        near_enough = cosines >= MIN_COSINE
        part = slice(*np.searchsorted(shared_at, (lo, lo + rows)))
        near_enough[shared_at[part] - lo, shared_piece[part]] = True
        present = np.zeros(len(cosines) * numbers, bool)
        for at, word in reach:
            own = slice(*np.searchsorted(at, (lo, lo + rows)))
            present[(at[own] - lo) * numbers + word[own]] = True
        for at, k in _covered(np.flatnonzero(near_enough), present, numbers, space):
            block = lo + at
            doc = int(owner[block])
            place = (block - int(starts[doc])) * BLOCK
            piece = space.pieces[k]
            if (own := masks.get(k)) is None:
                own = masks[k] = word_masks(space.words[k])
            if block != last:
                last = block
                words = split[doc][max(0, place - BLOCK // 2) : place + BLOCKS * BLOCK + BLOCK // 2].tolist()
            covered = lcs(own, len(piece.words), words) / len(piece.words)
            if covered < ANSWERED:
                continue
            near = split[doc][max(0, place - PIECE) : place + BLOCKS * BLOCK + 2 * PIECE].tolist()
            answer = space.answers[k]
            n = len(answer)
            answered = any(near[i : i + n] == answer for i in range(len(near) - n + 1))
            if covered >= PLAIN or answered:
                key, value = (doc, piece.item_id), (covered, answered, float(cosines[at, k]))
                best[key] = max(best.get(key, value), value)
    return [(ids[d], item, cos, covered, answered) for (d, item), (covered, answered, cos) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, covered and answered: benchmark items that stand in documents.

    ``covered`` is the share of a piece's words found in order, ``answered``
    whether the item's last words stand nearby. Null and empty texts, of
    documents or items, match nothing; an empty table on either side gives no
    rows. Texts are read whole. Repeated documents give repeated rows; repeated
    items are found under each of their identifiers. Columns other than doc_id,
    item_id and text are not read. The benchmark is searched in blocks of
    BLOCK_ITEMS items, whatever its size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, cosine double, covered double, answered boolean"
    out = docs.sparkSession.createDataFrame([], schema)

    def searched(block: list[tuple[int, str | None]]) -> DataFrame | None:
        pieces = pieces_of(block)
        if not pieces:
            return None
        numbers = {w: k for k, w in enumerate(sorted({w for p in pieces for w in (*p.words, *p.answer)}))}
        coded = encoded(rows, numbers)
        space = fit(coded, pieces, numbers)
        if space is None:
            return None

        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = search(batch.column("doc_id").to_pylist(), _arrays(batch), space)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                names = ["doc_id", "item_id", "cosine", "covered", "answered"]
                return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names)

            return step

        return map_rows(coded, make, schema)

    block: list[tuple[int, str | None]] = []
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK_ITEMS:
            if (found := searched(block)) is not None:
                out = out.unionAll(found)
            block = []
    if block and (found := searched(block)) is not None:
        out = out.unionAll(found)
    return out
