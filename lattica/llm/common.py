"""Small pieces that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = "\t\n\x0b\x0c\r "
#: A word, as a Java or RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows turned into Python objects at a time, which bounds a worker's memory.
SLICE = 256

#: Distinct marks of a text up to which they are replaced one after the other.
FEW_MARKS = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_ASCII = str.maketrans(_UPPER, _UPPER.lower())
#: Of the ASCII characters, letters and digits stay and all others part words.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 0x20 for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: str) -> str:
    """Lower-cases A to Z and nothing else."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER_ASCII)


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than the six of SPACES."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, of any script, of the lower-cased text."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_PLAIN).decode().split()
    marks = [c for c in set(text) if not c.isalnum()]
    if len(marks) > FEW_MARKS:
        return text.translate(dict.fromkeys(map(ord, marks), " ")).split()
    for c in marks:
        text = text.replace(c, " ")
    return text.split()


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
) -> DataFrame:
    """``df`` through ``make()`` in slices of at most SLICE rows.

    ``make`` runs once in each task, so that models are unpacked there once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                if (out := step(batch.slice(i, SLICE))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: that of ``spark.checkpoint.dir``, or one in the warehouse where it is unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return _ends_with_session(spark, sc._jsc.sc().getCheckpointDir().get())


def _ends_with_session(spark: SparkSession, path: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the checkpoint folder; what is written there goes when the driver's process ends."""
    return _ends_with_session(spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
