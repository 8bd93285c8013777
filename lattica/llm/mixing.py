"""Mixing sources to target weights along a time-varying curriculum.

Main path: DataFrame operations only.

Targets. Sources by code point, null last, get the weights of ``weights`` in
turn and share ``share`` of all words. A target stops at ``cap`` times its
source's words and the excess is shared again by weight. Sorted by the ratio of
cap to weight, the sources that stop are a prefix, so one ordered pass over the
sources finds the level at which the rest share.

Curriculum. Over training time t from 0 to 1 a source is drawn with a density
proportional to 1 + g (2t - 1), g its slope: a negative one comes early, a
positive one late. Its integral is the share of the source's target demanded by
t, and its inverse maps a document's place in the source's cumulative words to
the position at which it is trained on.

Places. Within a source, documents are ordered by a digest of their id. The
cumulative words are summed in two levels (first over slices of the digest,
then inside a slice), so that a source with a third of all rows is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Slopes of the schedules, by turns as the weights.
SLOPES = (0.0, -0.8, 0.8)
#: Hexadecimal digits of the digest that pick the slice inside a source: 4096 slices.
SLICE_DIGITS = 3


def size_of() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def _turn(values: tuple[float, ...], rank: Column) -> Column:
    out = F.lit(float(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = F.when(rank % len(values) == i, F.lit(float(v))).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """source, source_size, weight, rank and target from (source, source_size).

    One row for a source: the windows order the sources, not the documents.
    Sources without words get the target 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", _turn(weights, F.col("rank")))
        .withColumn("limit_", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("limit_") / F.col("weight"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("stopped", F.coalesce(F.sum("limit_").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("weight_left"))
        .withColumn(
            "level",
            F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"],
        )
    )
    target = F.when(F.col("level").isNull() | (F.col("level") > F.col("ratio")), F.col("limit_")).otherwise(
        F.col("level") * F.col("weight")
    )
    return levels.select("source", "source_size", "rank", "weight", target.alias("target"))


def position(share_done: Column, slope: Column) -> Column:
    """The time at which a source of that slope has had this share of its demand."""
    rest = F.lit(1.0) - slope
    root = F.sqrt(rest * rest + F.lit(4.0) * slope * share_done)
    return F.when(share_done <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * share_done / (rest + root))


def _readings(
    docs: DataFrame, carried: list[Column], weights: tuple[float, ...], share: float, cap: float, slopes: tuple[float, ...], seed: str
) -> DataFrame:
    """``carried``, doc_id, size, source_size, target, taken and readings of each row of ``docs``.

    ``readings`` has one (words, position) for each time that the document may
    be read, at most ``cap`` times rounded up: a source's documents are read in
    the order of their digests, again from the start after the last, until its
    target is reached.
    """
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    keys = [doc_id.alias("doc_id"), source.alias("source"), size_of().alias("size"), digest.alias("digest"), F.xxhash64(text_of()).alias("text_hash")]
    piece = F.substring("digest", 1, SLICE_DIGITS)
    # At most sources x 16^SLICE_DIGITS rows, combined before they are shuffled.
    slices = docs.select(*keys[:4]).groupBy("source", piece.alias("slice")).agg(F.sum("size").alias("slice_size"))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap).withColumnRenamed("source", "t_source")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "slice_start", "source_size", "rank", "target"
        )
    )
    inside = (
        Window.partitionBy("source", "slice").orderBy("digest", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("slice_start") + F.col("slice_offset")
    whole = F.round(F.col("target")).cast("long")
    slope = _turn(slopes, F.col("rank"))

    def reading(k: int) -> Column:
        begin = start + F.lit(k) * F.col("source_size")
        words = F.least(F.greatest(whole - begin, F.lit(0)), F.col("size")).cast("long")
        return F.struct(words.alias("words"), F.when(words > 0, position(begin / F.col("target"), slope)).alias("position"))

    return (
        docs.select(*keys, *carried)
        .withColumn("slice", piece)
        .withColumn("slice_offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(placed, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .withColumn("readings", F.array(*[reading(k) for k in range(math.ceil(cap))]))
        .withColumn("taken", F.aggregate("readings", F.lit(0).cast("long"), lambda n, r: n + r["words"]))
    )


def places(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    slopes: tuple[float, ...] = SLOPES,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position and readings of each row.

    ``taken`` counts the words that the mix takes of the document, with
    repeats; the document at which the target is reached gives the rest.
    ``readings`` has the words and the training time of each reading, at most
    ``cap`` of them rounded up, and ``position`` is the time of the first, null
    where nothing is taken.

    Null text has size 0. A null source is a source of its own, the last. Rows
    that repeat an identifier follow one another by a hash of their text, and
    rows that repeat that as well are alike. Other columns are ignored,
    whatever their names. No rows give no rows.
    """
    found = _readings(docs, [], weights, share, cap, slopes, seed)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", F.col("readings")[0]["position"].alias("position"), "readings")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``places`` range-sorted by position, those that are not taken first."""
    return places(docs, **options).orderBy("position", "doc_id")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    slopes: tuple[float, ...] = SLOPES,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs`` as they are trained on, with all their columns, range-sorted by position.

    A document that is read twice comes twice. Added are ``copy`` (0, 1, ...),
    ``words`` (how many of its words are read then) and ``position``, with
    underscores before the names where ``docs`` has such columns. The rows are
    carried along, not joined by their identifiers: rows that repeat one, and
    rows without one, are documents of their own, as in ``places``.
    """
    names = [free_name(docs, n) for n in ("copy", "words", "position")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _readings(docs, [row], weights, share, cap, slopes, seed)
    return (
        found.select("row", F.posexplode("readings").alias("copy", "reading"))
        .where("reading.words > 0")
        .select("row.*", *[F.col(c).alias(n) for c, n in zip(("copy", "reading.words", "reading.position"), names, strict=True)])
        .orderBy(names[2], "doc_id")
    )
