"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from sampled texts of
that language. A text is lower-cased, reduced to its letters and encoded, block
by block, with every dictionary; the language whose bytes are fewest wins. It
is rejected when the runner-up is nearly as small.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: The bounded sample the dictionaries are cut from: documents of each language, by hash order.
SAMPLE_DOCS = 256
#: Letters of a segment of a sampled document, segments taken from all over it, and bytes of a dictionary.
SEGMENT, SEGMENTS = 256, 32
DICTIONARY_BYTES = 1 << 16
#: Bytes encoded at a time: every part of a long text weighs the same.
BLOCK_BYTES = 4096
LEVEL = 6
#: Narrowest accepted margin, of the runner-up over the winner.
MIN_MARGIN = 0.01
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The lower-cased text with each run of anything but letters (Unicode category L) as one space."""
    if not text:
        return ""
    text = _NOT_LETTERS.sub(" ", text.lower()).strip()
    # numbers such as fractions and Roman numerals are word characters, but not letters
    if not text.isascii() and (odd := [c for c in set(text) if c != " " and not c.isalpha()]):
        text = " ".join(text.translate(dict.fromkeys(map(ord, odd), " ")).split(" "))
        text = re.sub(" +", " ", text).strip()
    return text


def segments(text: str) -> list[str]:
    """At most SEGMENTS pieces of SEGMENT letters, evenly spaced over the lines of the whole text."""
    found = []
    for line in text.split("\n"):
        own = letters(line)
        found += [own[i : i + SEGMENT] for i in range(0, len(own), SEGMENT)]
    if len(found) > SEGMENTS:
        found = [found[k * len(found) // SEGMENTS] for k in range(SEGMENTS)]
    return found


def sample(labelled: DataFrame, docs_each: int = SAMPLE_DOCS) -> dict[str, list[list[str]]]:
    """The segments of at most ``docs_each`` documents of each language, those whose ids hash lowest.

    Only ids and labels are ranked (each task keeps its lowest before the
    shuffle); the few chosen texts are cut to segments where they are read, so
    the driver gets at most languages x ``docs_each`` x SEGMENTS x SEGMENT
    letters. Of rows that repeat an id, one is taken.
    """
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").withColumn("place", F.dense_rank().over(order))
    chosen = ids.where(F.col("place") <= docs_each).select("lang", "doc_id").distinct()
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [segments(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(cut, pa.list_(pa.string()))], ["lang", "doc_id", "segments"])

        return step

    pieces = map_rows(texts.select("lang", "doc_id", "text"), make, "lang string, doc_id long, segments array<string>")
    out: dict[str, list[list[str]]] = {}
    for r in pieces.groupBy("lang", "doc_id").agg(F.min("segments").alias("segments")).orderBy("lang", "doc_id").collect():
        out.setdefault(r[0], []).append(r[2])
    return out


def shares(lengths: list[int], room: int) -> list[int]:
    """How much each gets of ``room``: as much as it wants, or an equal part of what the smaller ones leave."""
    out = [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda k: lengths[k])
    for rank, k in enumerate(order):
        out[k] = min(lengths[k], room // (len(order) - rank))
        room -= out[k]
    return out


def dictionaries(texts: dict[str, list[list[str]]], rows: dict[str, int] | None = None) -> list[tuple[str, bytes]]:
    """(language, raw content), the language with most labelled rows first.

    The segments of every sampled document share DICTIONARY_BYTES evenly.
    Segments that stand in several languages (licences, site furniture) say
    nothing and are left out; of those that one language repeats one is kept.
    """
    languages = Counter(x for ts in texts.values() for x in {x for t in ts for x in t})
    out = []
    for lang, ts in texts.items():
        seen: set[str] = set()
        parts = []
        for t in ts:
            own = [x for x in dict.fromkeys(t) if languages[x] == 1 and x not in seen]
            seen.update(own)
            parts.append(own)
        # one byte of each share is the space between documents
        room = shares([sum(len(x.encode()) + 1 for x in p) for p in parts], DICTIONARY_BYTES)
        content = b" ".join(x for p, n in zip(parts, room, strict=True) if (x := _spread(p, n - 1)))
        if content:
            out.append((-(rows or {}).get(lang, 0), lang, content))
    return [(lang, content) for _, lang, content in sorted(out)]


def _spread(parts: list[str], room: int) -> bytes:
    """``room`` bytes of the parts, a share from the start of each."""
    data = [p.encode() for p in parts]
    cut = [d[:n] for d, n in zip(data, shares([len(d) for d in data], room - len(data) + 1), strict=True)] if room >= len(data) else []
    return b" ".join(c for c in cut if c)


def compressors(dicts: list[tuple[str, bytes]]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dicts:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(
            (
                lang,
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
                ),
            )
        )
    return out


def classify(text: str | None, models: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """(language, score, margin) of a text.

    ``score`` is the winner's share when each language weighs two to the power
    of minus its excess bits, at most 64 of them. Ties go to the language with
    most sampled letters and have margin 0.
    """
    data = letters(text).encode()
    if not data or not models:
        return UNKNOWN, 0.0, 0.0
    totals = [0] * len(models)
    for i in range(0, len(data), BLOCK_BYTES):
        block = data[i : i + BLOCK_BYTES]
        for k, (_, z) in enumerate(models):
            totals[k] += len(z.compress(block))
    order = sorted(range(len(models)), key=lambda k: totals[k])
    best = totals[order[0]]
    margin = (totals[order[1]] - best) / best if len(order) > 1 else 1.0
    score = 1.0 / sum(math.exp(-math.log(2) * min(64, 8 * (t - best))) for t in totals)
    return models[order[0]][0], score, margin


def identify(docs: DataFrame, dicts: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for each row of ``docs``.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is
    every row where no language was learned. Long texts are encoded whole.
    Repeated rows give repeated rows. Columns other than doc_id and text are
    not read. No rows give no rows.
    """

    def make():
        models = compressors(dicts)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [classify(t, models) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[0] == UNKNOWN or x[2] < min_margin for x in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, dicts: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` does not reject."""

    @F.pandas_udf("boolean")
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        models = compressors(dicts)
        for texts in batches:
            found = [classify(t, models) for t in texts]
            yield pd.Series([x[0] != UNKNOWN and x[2] >= min_margin for x in found], dtype=bool)

    return docs.where(accepted(F.col("text").cast("string")))


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, held_out: Column | None = None) -> list[tuple[str, bytes]]:
    """Dictionaries from the rows of ``docs`` that are not held out; rows without text, label or identifier teach nothing."""
    rows = docs.select("doc_id", "text", "lang")
    if held_out is not None:
        rows = rows.where(~held_out)
    counts = {r[0]: r[1] for r in rows.where("lang is not null").groupBy("lang").count().collect()}
    return dictionaries(sample(rows), counts)
