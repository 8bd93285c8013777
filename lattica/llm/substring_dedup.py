"""Substring dedup by prefix-partitioned suffix trees.

A window is WINDOW consecutive words. A word goes when a window that covers it
has a word sequence that starts earlier as well.

1. Anchors. Every window picks the smallest hash among the PREFIX-word sequences
   inside it, its anchor; equal windows pick equal anchors, at the same place in
   them. So windows are dealt by the suffix that starts at their anchor, which
   stands for about eight of them, and equal windows meet where these suffixes
   have the same prefix.
2. Pruning. The prefixes of all documents are counted. Those that occur again,
   and those that occur over ``limit`` times, are kept in two bitmaps of
   FILTER_BITS bits; windows whose anchor is unique are unique and left out.
3. Trees. The windows of the documents are split by prefixes of PREFIX words
   into groups, each with the words around its anchors. The suffixes of a group
   are sorted, and the words that neighbours have in common give the internal
   nodes of its tree. A node as deep as the window is a repeat, and its leaves
   but the first go.
4. Longer prefixes. Suffixes whose prefix occurs over ``limit`` times are split
   by the whole window instead (two 64-bit hashes of it), so each group is one
   deep node and only its first leaf is needed: an aggregate that combines
   before it is shuffled. A slot of the bitmap that several prefixes share only
   sends more windows this way, which changes no result.
5. Maximal repeats. Runs of window starts that follow one another are one
   passage, as long as it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, words_of, written

WINDOW = 20
PREFIX = 6
#: Anchors with the same prefix up to which a tree is built in memory (about 5 MB), and words of the groups taken together.
GROUP_LIMIT = 16_384
TREE_WORDS = 500_000
#: Bits of each filter of prefixes: 8 MB, whatever the input; bytes of a bucket of the bitmap functions.
FILTER_BITS = 1 << 26
BUCKET = 4096

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def codes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def rolled(code: np.ndarray, width: int, by: np.uint64) -> np.ndarray:
    """A mixed polynomial hash of each ``width`` consecutive codes."""
    n = max(0, len(code) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for t in range(width):
            out = out * by + code[t : t + n]
        out ^= out >> np.uint64(31)
        out *= _M2
        out ^= out >> np.uint64(29)
    return out


def anchors(code: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of each anchor."""
    if len(code) < window:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    grams = rolled(code, PREFIX, _M1)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - PREFIX + 1)
    place = np.arange(len(view)) + view.argmin(1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return grams[place[first]], place[first], first, last


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """key and n: the anchors of all documents, and how often each occurs."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [anchors(codes(words_of(text)), window)[0] for text in batch.column("text").to_pylist()]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])

        return step

    return map_rows(docs.select("text"), make, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def bitmaps(counts: DataFrame, limit: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the anchors that occur again, and of those that occur over ``limit`` times.

    Two bitmaps of ``bits`` bits are all that the driver gets.
    """
    slot = F.pmod("key", F.lit(bits)) + 1
    crowded = F.col("n") > limit
    rows = counts.where("n > 1").groupBy(crowded.alias("crowded"), F.bitmap_bucket_number(slot).alias("bucket"))
    out = tuple(np.zeros(max(bits // 8, BUCKET), np.uint8) for _ in range(2))
    for r in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect():
        own = np.frombuffer(r["bits"], np.uint8)
        for bitmap in out if r["crowded"] else out[:1]:
            bitmap[(r["bucket"] - 1) * BUCKET :][: len(own)] |= own
    return out


def marked(key: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether the slot of each anchor is set."""
    slot = (key % np.uint64(bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


SUFFIXES = "key long, key2 long, doc_id long, mark long, lo int, hi int, words string"


def suffix_rows(docs: DataFrame, window: int, repeated: np.ndarray, crowded: np.ndarray, bits: int) -> DataFrame:
    """The windows that may repeat, lo to hi, by what they are compared with.

    * ``words`` given: all windows of one anchor, whose prefix is ``key``;
    * ``key2`` given: one window of a crowded prefix, by its two hashes;
    * neither: windows that repeat for certain, since the same words came
      earlier in the slice.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            seen: set = set()
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")]

            def add(*row) -> None:
                for column, value in zip(out, row, strict=True):
                    column.append(value)

            for doc, mark, text in sorted(set(zip(*columns, strict=True))):
                words = words_of(text)
                code = codes(words)
                key, _, first, last = anchors(code, window)
                hits = np.flatnonzero(marked(key, repeated, bits))
                if not len(hits):
                    continue
                many = marked(key, crowded, bits)
                a, b = (rolled(code, window, _M1), rolled(code ^ _M1, window, _M2)) if many.any() else (None, None)
                for k in hits.tolist():
                    lo, hi = int(first[k]), int(last[k])
                    if not many[k]:
                        context = " ".join(words[lo : hi + window])
                        if context in seen:
                            add(None, None, doc, mark, lo, hi, None)
                        else:
                            seen.add(context)
                            add(int(key[k].view(np.int64)), None, doc, mark, lo, hi, context)
                        continue
                    run = None
                    for at, pair in enumerate(zip(a[lo : hi + 1].view(np.int64).tolist(), b[lo : hi + 1].view(np.int64).tolist(), strict=True), lo):
                        if pair not in seen:
                            seen.add(pair)
                            add(*pair, doc, mark, at, at, None)
                        elif run == at - 1:
                            out[5][-1] = run = at
                            continue
                        else:
                            add(None, None, doc, mark, at, at, None)
                            run = at
                            continue
                        run = None
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            names = ["key", "key2", "doc_id", "mark", "lo", "hi", "words"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        return step

    return map_rows(docs.select("doc_id", "mark", "text"), make, SUFFIXES)


def common_words(suffixes: np.ndarray) -> np.ndarray:
    """How many words each of the sorted suffixes has in common with the one before; the first has none."""
    same = suffixes[1:] == suffixes[:-1]
    return np.concatenate(([0], np.cumprod(same, axis=1).sum(1)))


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf of the internal nodes that are as deep as ``depth`` but for what lies below them.

    Such a node is a run of sorted suffixes of which each has ``depth`` words
    in common with the one before.
    """
    deep = common >= depth
    first = np.flatnonzero(~deep[:-1] & deep[1:]) if len(deep) else np.zeros(0, int)
    last = np.flatnonzero(deep & np.append(~deep[1:], True))
    return first, last


Row = tuple[int, int, int, int, list[str]]


def repeated_suffixes(rows: list[Row], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, mark, lo, hi) of each run of suffixes that hang from a deep node but are not its first leaf.

    ``rows`` are (doc_id, mark, lo, hi, words) of whole groups in any order.
    """
    rows = sorted(rows, key=lambda r: r[:3])
    lengths = np.array([len(r[4]) for r in rows])
    begins = np.cumsum(lengths) - lengths
    word = np.unique(codes([w for r in rows for w in r[4]]), return_inverse=True)[1].astype(">u4")
    counts = np.array([r[3] - r[2] + 1 for r in rows])
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    # suffixes in document order, cut off at the depth that matters
    suffixes = word[(begins[row] + offset)[:, None] + np.arange(window)]
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"V{4 * window}").ravel(), kind="stable")
    first, last = deep_nodes(common_words(suffixes[order]), window)
    again = np.zeros(len(row), bool)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        leaves = order[a : b + 1]
        least = leaves.min()
        own = rows[row[least]][:2], offset[least] + rows[row[least]][2]
        # the same row twice is one document
        again[[x for x in leaves.tolist() if (rows[row[x]][:2], offset[x] + rows[row[x]][2]) != own]] = True
    hits = np.flatnonzero(again)
    if not len(hits):
        return
    for run in np.split(hits, np.flatnonzero((np.diff(hits) != 1) | (np.diff(row[hits]) != 0)) + 1):
        doc, mark, lo, _, _ = rows[row[run[0]]]
        yield doc, mark, lo + int(offset[run[0]]), lo + int(offset[run[-1]])


RUN = "doc_id long, mark long, lo int, hi int"


def _runs(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["doc_id", "mark", "lo", "hi"])


def tree_repeats(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, mark, lo and hi of the repeated runs, from trees over whole groups of suffixes with the same prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[Row] = []
        seen: dict[str, tuple] = {}
        size, last = 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                copies: list[tuple[int, int, int, int]] = []
                for key, doc, mark, lo, hi, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if key != last:
                        seen.clear()
                        if size >= TREE_WORDS:
                            yield _runs(list(repeated_suffixes(group, window)))
                            group, size = [], 0
                    last = key
                    # the same words again: every suffix hangs from a node that has an earlier leaf
                    if words in seen:
                        if seen[words] != (doc, mark, lo):
                            copies.append((doc, mark, lo, hi))
                        continue
                    seen[words] = (doc, mark, lo)
                    own = words.split(" ")
                    size += len(own)
                    group.append((doc, mark, lo, hi, own))
                yield _runs(copies)
        yield _runs(list(repeated_suffixes(group, window)) if group else [])

    dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id", "mark", "lo")
    return dealt.select("key", "doc_id", "mark", "lo", "hi", "words").mapInArrow(run, RUN)


def leaf_repeats(rows: DataFrame) -> DataFrame:
    """The leaves but the first of groups whose prefix is the whole window."""
    place = F.struct("doc_id", "mark", "lo")
    first = rows.groupBy("key", "key2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # written apart, so that the join is free to split a window that very many documents have
    later = rows.join(written(first, "leaves"), ["key", "key2"]).where(place != F.col("first"))
    return later.select("doc_id", "mark", "lo", "hi")


def repeats(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_LIMIT, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, mark, lo and hi (inclusive) of the window starts that also start earlier.

    ``docs`` has doc_id, mark and text; documents are ordered by the first two.
    """
    repeated, crowded = bitmaps(anchor_counts(docs, window), limit, bits)
    rows = written(suffix_rows(docs, window, repeated, crowded, bits), "suffixes")
    certain = rows.where("key is null").select("doc_id", "mark", "lo", "hi")
    trees = tree_repeats(rows.where("words is not null"), window)
    return certain.unionAll(trees).unionAll(leaf_repeats(rows.where("key2 is not null").drop("words")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, limit: int = GROUP_LIMIT, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that stays) of each row of ``docs``.

    Null and empty texts have no words; texts of fewer than ``window`` words
    keep all. Texts are read whole. Rows that share an identifier are ordered by
    a hash of their text; rows that repeat both are one document, and what stays
    of it stays in each. Rows without an identifier come with their words and
    nothing removed. Columns other than doc_id and text are not read. No rows
    give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = repeats(rows.where("doc_id is not null"), window, limit, bits)
    cuts = found.groupBy("doc_id", "mark").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("text", "lo", "hi")]
            for text, lo, hi in zip(*columns, strict=True):
                words = words_of(text)
                kept = words
                if lo:
                    step_ = np.zeros(len(words) + window + 1, np.int64)
                    np.add.at(step_, np.array(lo), 1)
                    np.add.at(step_, np.array(hi) + window, -1)
                    gone = np.cumsum(step_)[: len(words)] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = " ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

        return step

    joined = rows.join(cuts, ["doc_id", "mark"], "left")
    return map_rows(joined, make, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
