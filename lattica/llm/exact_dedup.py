"""Exact dedup by a log-structured merge index of text digests.

Main path: DataFrame operations only.

1. Memtables. The documents are dealt into ``memtables`` memtables by a hash of
   their id. Each is reduced before it is shuffled: one entry for a digest, with
   the best row seen and the number of rows.
2. Flush. Each memtable is written as a sorted run: files of ranges of digests
   that don't overlap, each sorted. With each run goes a filter, a bitmap of
   FILTER_BITS bits in which the slot of each of its digests is set.
3. Compaction. An entry whose slot no other run's filter has is settled as it
   is. The others go up by levels: FAN_IN neighbouring runs at a time are merged
   in the order of digests and written as one sorted run, until one is left; of
   the rows of a digest the one with the longest original text, then the
   smallest identifier, stays.
4. Byte verification. Every row whose digest is held by more than one row is
   compared byte for byte with the text of the row that stays. Rows that
   differ (a digest collision) are grouped again by their whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, shared_folder, text_of

#: Memtables into which documents are dealt, each of which gives one run, and runs that are merged at a time.
MEMTABLES, FAN_IN = 16, 4
#: Bits of a run's filter: 1 MB, so 16 MB for all runs, whatever the input.
FILTER_BITS = 1 << 23
#: Bits of the filter over the identifiers of hits: 8 MB, whatever the input.
HIT_BITS = 1 << 26
RUN = "digest string, best struct<neg: bigint, none: boolean, doc_id: bigint>, n bigint, run int"


def normalised(text: Column) -> Column:
    """The text without tab, line feed, vertical tab, form feed, return and space."""
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def entries(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest and length in code points of each document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(normalised(text_of())).alias("digest"),
        F.char_length(text_of()).cast("long").alias("length"),
    )


def best(length: str, doc_id: str) -> Column:
    """Aggregate: the longest row, then the smallest identifier (a null one last)."""
    return F.min(F.struct((-F.col(length)).alias("neg"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id")))


def _sorted_runs(entries_: DataFrame, path: str) -> DataFrame:
    """Merges (run, digest, best, n) into one entry for each digest of a run and writes each run sorted.

    Tasks own ranges of digests, so the merge needs no other shuffle, and a
    run is one file for each range.
    """
    merged = (
        entries_.repartitionByRange("digest")
        .groupBy("run", "digest")
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        .sortWithinPartitions("run", "digest")
    )
    merged.write.partitionBy("run").parquet(path)
    return entries_.sparkSession.read.schema(RUN).parquet(path)


def flush(rows: DataFrame, path: str, memtables: int = MEMTABLES) -> DataFrame:
    """The memtables of ``rows`` (doc_id, digest, length), written as sorted runs under ``path``."""
    memtable = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int")
    entries_ = rows.withColumn("run", memtable).groupBy("run", "digest").agg(best("length", "doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    return _sorted_runs(entries_, path)


def _slot(column: str, bits: int) -> tuple[Column, Column]:
    """Bucket and place of a value's slot in a bitmap of ``bits`` bits."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    return F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)


def _has(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def filters(runs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """bucket and, for each run with an entry in it, the run and its bits."""
    bucket, at = _slot("digest", bits)
    each = runs.groupBy("run", bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
    return each.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))


def settled(runs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The runs with ``alone``: whether no other run's filter has the digest's slot.

    The filters have a fixed number of bits for a fixed number of runs, so they are broadcast.
    """
    bucket, at = _slot("digest", bits)
    probed = runs.withColumn("bucket", bucket).withColumn("at", at).join(F.broadcast(filters(runs, bits)), "bucket")
    others = F.filter("filters", lambda f: (f["run"] != F.col("run")) & _has(f["bits"], F.col("at")))
    return probed.select("run", "digest", "best", "n", (F.size(others) == 0).alias("alone"))


def compact(runs: DataFrame, path: str, memtables: int = MEMTABLES, fan_in: int = FAN_IN, bits: int = FILTER_BITS) -> DataFrame:
    """The runs merged by levels: digest, keep_id, keep_length and group_size, one row for a digest."""
    probed = cut(settled(runs, bits))
    done, rest = probed.where("alone"), probed.where("not alone")
    level, left = 0, memtables
    while left > 1:
        level, left = level + 1, -(-left // fan_in)
        rest = _sorted_runs(rest.withColumn("run", (F.col("run") / fan_in).cast("int")), f"{path}/level{level}")
    return (
        done.select("digest", "best", "n")
        .unionByName(rest.select("digest", "best", "n"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("keep_length"), F.col("n").alias("group_size"))
    )


def passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id may be in ``wanted``: all that are, and few others.

    The filter is a bitmap of HIT_BITS bits, a size that does not depend on the
    data, so it is broadcast.
    """
    bucket, at = _slot("doc_id", HIT_BITS)
    filter_ = wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
    return (
        rows.withColumn("bucket", bucket)
        .withColumn("at", at)
        .join(F.broadcast(filter_), "bucket")
        .where(_has(F.col("bits"), F.col("at")))
        .select(*rows.columns)
    )


def lsm_dedup(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES, fan_in: int = FAN_IN, bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest for each row of ``docs``.

    Rows are equal when their texts without white space are. Null text counts
    as empty, and empty texts are equal to one another. Of rows that repeat
    both text and identifier one stays in no defined order: all carry the same
    ``kept``. Other columns of ``docs`` are ignored, whatever their names. No
    rows give no rows.
    """
    rows = cut(entries(docs, digest))  # the only pass over all texts that normalises them
    path = shared_folder(docs.sparkSession, "lsm")
    # cut here for the same reason as below: the join on the digest may then be split
    index = cut(compact(flush(rows, f"{path}/level0", memtables), path, memtables, fan_in, bits))

    # Hits: digests that several rows hold. Their texts, and no others but what
    # a filter of fixed size lets through, are normalised again and moved.
    hits = index.where("group_size > 1").select("digest", "keep_id", "keep_length")
    texts = passing(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")),
        rows.join(hits.select("digest"), "digest", "left_semi"),
    ).select("doc_id", normalised(F.col("text")).alias("body"), F.char_length("text").cast("long").alias("length"))
    held = cut(texts.withColumn("digest", digest(F.col("body"))).join(hits, "digest"))
    # cut apart, so that the join is free to split a digest that very many rows share
    keeper = cut(
        held.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")))
        .groupBy("digest")
        .agg(F.min("body").alias("keep_body"))
    )
    verified = held.join(keeper, "digest").withColumn("same", F.col("body") == F.col("keep_body"))
    group = F.when(F.col("same"), F.lit(None)).otherwise(F.col("body"))
    judged = cut(verified.select("doc_id", "digest", "length", group.alias("other")))
    merged = judged.groupBy("digest", "other").agg(best("length", "doc_id").alias("best"), F.count(F.lit(1)).alias("size"))
    # Collisions only: rows whose digest has more than one text are joined by their text as well.
    apart = merged.where(F.col("other").isNotNull())
    clash = apart.select("digest").distinct().withColumn("clash", F.lit(True))
    lone = rows.join(index, "digest").join(clash, "digest", "left")
    plain = lone.where("clash is null").select(
        "doc_id", F.col("keep_id"), F.col("group_size"), F.col("digest"), F.lit(0).alias("part")
    )
    mixed = (
        judged.join(clash, "digest")
        .join(merged.select("digest", F.col("other").alias("o"), "best", "size"), "digest")
        .where(F.col("other").eqNullSafe(F.col("o")))
        .select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), "digest", F.lit(1).alias("part"))
    )
    return plain.unionByName(mixed).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest")
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Rows that share an identifier, or have none, are told apart by their texts:
    each text is judged by itself, and of rows that repeat both the longest
    original text stays. Null text counts as empty. No rows give no rows.
    """
    key, body = free_name(docs, "lsm_doc_id"), free_name(docs, "lsm_digest")
    found = lsm_dedup(docs, **options)
    doc_id = F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shared = cut(ids.where((F.col("n") > 1) | F.col(key).isNull()).select(key))
    gone = found.where("not kept").select(F.col("doc_id").alias(key))
    same = doc_id.eqNullSafe(F.col(key))
    plain = docs.join(gone.unionAll(shared).distinct(), same, "left_anti")
    # usually none: rows whose identifier does not name them
    digest = options.get("digest", sha256)
    again = docs.join(shared, same, "left_semi").withColumn(body, digest(normalised(text_of())))
    kept = found.where("kept").select(F.col("doc_id").alias(key), F.col("digest").alias(f"{body}_")).distinct()
    rank = free_name(again, "lsm_rank")
    first = Window.partitionBy("doc_id", body).orderBy(F.char_length(text_of()).desc(), F.xxhash64(text_of()))
    stays = again.join(kept, same & (F.col(body) == F.col(f"{body}_")), "left_semi").withColumn(rank, F.row_number().over(first))
    return plain.unionByName(stays.where(F.col(rank) == 1).select(*docs.columns))
