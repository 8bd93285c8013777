"""Near-duplicates by SimHash fingerprints in sharded BK-trees.

A BK-tree keys the children of a node by their integer Hamming distance to it;
a search within a radius follows only the edges whose key differs from the
distance to the query by no more than the radius.

Trees over all fingerprints would grow with the corpus, so they are not
broadcast: a shard's tree is built inside the task that the shard is dealt to.
Shards are chosen so that linked fingerprints meet in at least one of them.

* ``simhash_components``: fingerprints at most R bits apart agree in at least
  one of R + 1 blocks of bits, so each value of each block is a shard. Shards
  over SHARD_LIMIT are dealt again: their other bits differ in at most R places
  too, so those are cut into R + 1 blocks in turn, LEVELS times in all.
* ``near_duplicates``: copies that share four fifths of their shingles may
  differ in many more bits than blocks can bear, so shards are the smallest
  hashes of the shingle sets, or pairs of them. In each shard a tree over the
  fingerprints of the sets, repeats left out, finds what is within TREE_RADIUS
  bits and the sets confirm it; an index of the members then adds the links of
  sets whose fingerprints are farther apart.

Inside a shard, links are gathered by union-find and leave it as one edge for
each fingerprint, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, map_rows, words_of, written
from .components import connected_components

BITS = 64
SHARD_LIMIT = 2048
#: How often a crowded shard is dealt again: after four times with a radius of 3 its members agree in 44 of 64 bits.
LEVELS = 4
#: Least hashes of a shingle set, which deal a text to shards, and members that all blocks of a crowded shard have.
LEAST = 8
PIVOTS = 16
#: Bits that the trees over sets search within.
TREE_RADIUS = 14
#: Sets that are compared in pairs, without an index, and places of an index read at a time.
FEW, INDEXED = 6, 1 << 20


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the lower-cased text, repeats included."""
    words = [w.encode() for w in words_of(lower_ascii(text))]
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; none give zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Fingerprints in a tree whose edges are Hamming distances."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def find(self, value: int, radius: int) -> list[int]:
        """The places of the values within ``radius``, in no order."""
        found: list[int] = []
        values, children = self.values, self.children
        if values:
            stack = [0]
            while stack:
                k = stack.pop()
                d = (values[k] ^ value).bit_count()
                if d <= radius:
                    found.append(k)
                kids = children[k]
                if len(kids) <= 2 * radius + 1:
                    stack += [c for key, c in kids.items() if -radius <= key - d <= radius]
                else:
                    stack += [kids[key] for key in range(d - radius, d + radius + 1) if key in kids]
        return found

    def add(self, value: int, radius: int) -> list[int]:
        """Adds ``value`` and gives the places of the earlier ones within ``radius``."""
        found = self.find(value, radius)
        values, children = self.values, self.children
        place = len(values)
        if values:
            k = 0
            while True:
                d = (values[k] ^ value).bit_count()
                if d not in children[k]:
                    children[k][d] = place
                    break
                k = children[k][d]
        values.append(value)
        children.append({})
        return found


class Unions:
    """Union-find whose roots are the first members."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def add(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its 64-bit fingerprint, as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [signed(fingerprint(shingle_hashes(t or "", width))) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "fp"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, fp long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal ``keys``, which come sorted by them, one at a time."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        at = 0
        n = batch.num_rows
        values = list(zip(*columns, strict=True))
        for i in range(n):
            if values[i] != last:
                if i > at:
                    kept.append(batch.slice(at, i - at))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, at, last = [], i, values[i]
        if at < n:
            kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` shared out into ``parts`` blocks of neighbours."""
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def shards(prints: DataFrame, radius: int, limit: int = SHARD_LIMIT, levels: int = LEVELS) -> DataFrame:
    """(mask, value, fp, rep): every fingerprint with the shards it shares with others.

    ``mask`` has the bits in which a shard agrees, ``value`` the fingerprint
    under it. The members of shards over ``limit`` are dealt again by blocks of
    the bits left, ``levels`` times in all; a shard that is still over it
    agrees in all but a few bits and is searched as it is.
    """
    every = list(range(BITS))
    masks = [block for block in _masks(every, radius + 1)]
    left = prints.select("fp", "rep", F.array(*[F.lit(_mask(m)) for m in masks]).alias("masks"))
    out: DataFrame | None = None
    for level in range(levels):
        rows = left.select("fp", "rep", F.explode("masks").alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        dealt = rows.join(sizes, ["mask", "value"])
        last = level == levels - 1
        fit = (dealt if last else dealt.where(F.col("n") <= limit)).select("mask", "value", "fp", "rep")
        out = fit if out is None else out.unionAll(fit)
        if last:
            break
        finer = [(m, [m + more for more in _masks([b for b in every if b not in m], radius + 1)]) for m in masks]
        masks = [m for _, parts in finer for m in parts]
        # a table of each mask's finer ones: at most (radius + 1)^levels rows
        table = prints.sparkSession.createDataFrame([(_mask(m), [_mask(x) for x in parts]) for m, parts in finer], "mask long, masks array<long>")
        big = cut(dealt.where(F.col("n") > limit).select("mask", "fp", "rep"))
        if not big.limit(1).count():
            break
        left = big.join(F.broadcast(table), "mask").select("fp", "rep", "masks")
    return out


def shard_links(parts: DataFrame, radius: int) -> DataFrame:
    """(a, b): each member of a shard that a tree links, with the first member of its local component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for table in groups(batches, ["mask", "value"]):
            tree, unions = BKTree(), Unions()
            reps = table.column("rep").to_pylist()
            for fp in table.column("fp").to_pylist():
                k = unions.add()
                for other in tree.add(fp & 0xFFFFFFFFFFFFFFFF, radius):
                    unions.join(other, k)
            for k, rep in enumerate(reps):
                if (r := unions.root(k)) != k:
                    a.append(reps[r])
                    b.append(rep)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = parts.repartition("mask", "value").sortWithinPartitions("mask", "value", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3, limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of ``docs``.

    Fingerprints at most ``radius`` bits apart are linked, and the component is
    named by the smallest doc_id reachable. Null and empty texts have the
    fingerprint zero and are linked like any other; texts of fewer than
    ``width`` words are one shingle. Equal fingerprints are one node, so copies
    cost nothing more. Rows without an identifier get the component of their
    fingerprint, null if it has no other row. Columns other than doc_id and
    text are not read. No rows give no rows.
    """
    prints = cut(fingerprints(docs, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = shard_links(shards(nodes.where("rep is not null"), radius, limit), radius)
    labels = connected_components(links)
    named = nodes.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("node_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("node_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near-duplicates by similarity of the shingle sets


def routes(docs: DataFrame, width: int, limit: int, least: int = LEAST) -> DataFrame:
    """(key, doc_id, n): the shards of each text that shares one, with the number of their members.

    Keys are the ``least`` smallest hashes of the set of shingles. Keys that
    over ``limit`` texts have (a licence, a quoted passage) count in pairs
    only, all of them: sets with four fifths in common share two of their least
    hashes in all but one case of ten thousand, while a common line seldom gives
    a text two of them. Texts of one shingle keep their single key. Shards with
    the same members are one: two hashes over them all tell which.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [np.unique(shingle_hashes(t or "", width))[:least].view(np.int64) for t in batch.column("text").to_pylist()]
            keys = [k if len(k) else np.zeros(1, np.int64) for k in keys]
            sizes = [len(k) for k in keys]
            ids = np.repeat(np.array(batch.column("doc_id").to_pylist(), np.int64), sizes)
            lone = np.repeat(np.array(sizes) == 1, sizes)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys)), pa.array(lone)], ["doc_id", "key", "lone"])

        return step

    def sizes(rows: DataFrame) -> DataFrame:
        marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")

    def distinct(found: DataFrame) -> DataFrame:
        return found.groupBy("n", "mark1", "mark2").agg(F.min("key").alias("key")).select("key", "n")

    rows = written(map_rows(docs.select("doc_id", "text"), make, "doc_id long, key long, lone boolean"), "routes")
    counted = cut(sizes(rows))
    # a text of one shingle is alike to another exactly if it has the same key, however many have it
    lone = rows.where("lone").join(counted.select("key", "n"), "key").select("key", "doc_id", "n")
    usual = rows.where("not lone").join(distinct(counted.where(F.col("n") <= limit)), "key").select("key", "doc_id", "n")
    hot = rows.where("not lone").join(counted.where(F.col("n") > limit).select("key"), "key")
    hot = hot.groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys")).where("size(keys) > 1")
    two = F.flatten(F.transform("keys", lambda x: F.transform(F.filter("keys", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    pairs = cut(hot.select("doc_id", F.explode(two).alias("key")))
    paired = pairs.join(distinct(sizes(pairs)), "key").select("key", "doc_id", "n")
    return usual.unionAll(lone).unionAll(paired)


def _compared(docs: DataFrame, slots: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): documents whose sets of shingles are alike, each with the first of its local component.

    ``slots`` has doc_id, key and the parts of the key's shard in which the document is.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids, shard_lists = batch.column("doc_id").to_pylist(), batch.column("shards").to_pylist()
            for doc, own, text in zip(ids, shard_lists, batch.column("text").to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(text or "", width))
                fp, data = signed(fingerprint(hashes)), np.unique(hashes.astype(np.uint32)).tobytes()
                for shard in own:
                    for slot in shard["slots"]:
                        for column, value in zip(out, (shard["key"], slot, doc, fp, data), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "slot", "doc_id", "fp", "members"])

        return step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "slot"]):
            places: dict[bytes, int] = {}
            ids: list[int] = []
            prints: list[int] = []
            a: list[int] = []
            b: list[int] = []
            for part in table.to_batches(max_chunksize=256):
                for doc, fp, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "fp", "members")), strict=True):
                    # equal sets are one node
                    if (k := places.setdefault(data, len(ids))) < len(ids):
                        a.append(ids[k])
                        b.append(doc)
                    else:
                        ids.append(doc)
                        prints.append(fp & 0xFFFFFFFFFFFFFFFF)
            for k, r in enumerate(local_roots([np.frombuffer(x, np.uint32) for x in places], prints, similarity)):
                if r != k:
                    a.append(ids[r])
                    b.append(ids[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    by_doc = slots.groupBy("doc_id").agg(F.collect_list(F.struct("key", "slots")).alias("shards"))
    members = map_rows(docs.join(by_doc, "doc_id").select("doc_id", "shards", "text"), make, "key long, slot long, doc_id long, fp long, members binary")
    dealt = members.repartition("key", "slot").sortWithinPartitions("key", "slot", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def _some(parts: Column, salt: int) -> Column:
    """One of ``parts`` parts, by the hash of the document."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(parts, F.lit(1)))


def near_links(docs: DataFrame, width: int, similarity: float, limit: int) -> DataFrame:
    """(a, b): links whose components are those of all alike documents that share a shard.

    Shards of at most ``limit`` members are compared in one task. Larger ones
    are dealt into blocks of about ``limit``, each with PIVOTS members that all
    blocks have, which ties together most that is alike. What is then outside
    the largest component of its shard is compared with every block, in pieces
    of about ``limit``; inside that component no link can add anything.
    """
    shards_ = written(routes(docs, width, limit), "shards")
    blocks = F.ceil(F.col("n") / limit)
    pivot = _some(F.ceil(F.col("n") / PIVOTS), 3) == 0
    own = F.array(_some(blocks, 4))
    first = F.when(F.col("n") <= limit, F.array(F.lit(0).cast("long"))).when(pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own)
    links = written(_compared(docs, shards_.select("doc_id", "key", first.alias("slots")), width, similarity), "links")
    big = shards_.where(F.col("n") > limit)
    if not big.limit(1).count():
        return links
    labels = connected_components(links)
    labelled = cut(big.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component")))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    cores = parts.groupBy("key").agg(F.max(F.struct("held", "component")).alias("core"), F.sum("held").alias("all"))
    cores = cores.select("key", F.col("core.component").alias("core"), (F.col("all") - F.col("core.held")).alias("outside")).where("outside > 0")
    apart = labelled.join(cores, "key")
    pieces = F.ceil(F.col("outside") / limit)
    block, piece = _some(blocks, 4), _some(pieces, 5)
    across = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda p: block + blocks * p)
    along = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: k + blocks * piece)
    slots = F.when(F.col("component") == F.col("core"), across).otherwise(F.array_union(across, along))
    more = _compared(docs, apart.select("doc_id", "key", slots.alias("slots")), width, similarity)
    return links.unionAll(written(more, "links"))


def local_roots(sets: list[np.ndarray], prints: list[int], similarity: float) -> list[int]:
    """For each of the sorted sets, the first one that alike sets connect it to.

    A tree over their fingerprints ``prints`` gives candidates, which the sets
    confirm. For alike sets whose fingerprints are farther apart, sets are then
    compared with all others by an index of their members, until those that
    were not are all in one component, to which they can't add a link.
    """
    n = len(sets)
    tree, unions = BKTree(), Unions()
    for k in range(n):
        unions.add()
        for j in tree.add(prints[k], TREE_RADIUS):
            if unions.root(j) != unions.root(k) and alike(sets[j], sets[k], similarity):
                unions.join(j, k)
    if n <= FEW:
        for k in range(n):
            for j in range(k):
                if unions.root(j) != unions.root(k) and alike(sets[j], sets[k], similarity):
                    unions.join(j, k)
        return [unions.root(k) for k in range(n)]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
    held = np.bincount(codes)
    begins = np.cumsum(held) - held
    roots = np.array([unions.root(k) for k in range(n)])
    waiting = np.ones(n, bool)
    while True:
        left = np.flatnonzero(waiting)
        if not len(left):
            break
        rest = left[roots[left] != np.bincount(roots[left]).argmax()]
        if not len(rest):
            break
        k = int(rest[0])
        waiting[k] = False
        own = codes[starts[k] : starts[k + 1]]
        both = np.zeros(n, np.int64)
        ends = np.cumsum(held[own])
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + INDEXED, "right")))
            part = own[lo:hi]
            lengths = held[part]
            shift = np.repeat(begins[part] - np.cumsum(lengths) + lengths, lengths)
            both += np.bincount(holders[shift + np.arange(len(shift))], minlength=n)
            lo = hi
        found = np.unique(roots[both >= similarity * (sizes + sizes[k] - both)])
        if len(found) > 1:
            roots[np.isin(roots, found)] = found[0]
    return roots.tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``similarity``; empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return True
    if small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, limit: int = SHARD_LIMIT) -> DataFrame:
    """(node, component) of every document that has a near-duplicate.

    Linked are documents whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``similarity``. Shards of any size link through every member.

    Null and empty texts are alike. Documents without an identifier are in no
    group. Other columns are ignored. No rows give no rows.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return connected_components(near_links(rows, width, similarity, limit))
