"""What several operators share: readers, written intermediate tables, batches and small hash tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that a kernel holds as words at once.
CHARS_AT_ONCE = 800_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder if the
    session is local; on a cluster an error, for executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="passplane-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables that the step of this thread has written so far; None outside of steps.
_STEP: ContextVar[list[str] | None] = ContextVar("_STEP", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _STEP.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(p), True)


def finished(step: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """What a step gives, written; the tables that the step itself wrote on the way are deleted then."""
    own: list[str] = []
    token = _STEP.set(own)
    try:
        out = written(step(), name)
    finally:
        _STEP.reset(token)
    deleted(spark, own[:-1])
    if (outer := _STEP.get()) is not None:
        outer.append(own[-1])
    return out


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of consecutive segments of 64-bit hashes: a bit is set where over half of a segment's hashes have it."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = segment_sums(bits, sizes) * 2 > sizes[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]


def is_training_row(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text, modulo 5, is not 0 (the other rows are held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The rows that nothing is learned from."""
    return ~is_training_row(doc_id)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts as Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def by_size(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most so many characters, or of one text."""
    begin = held = 0
    for i, x in enumerate(texts):
        if i > begin and held + len(x) > most:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield begin, len(texts)


class Codes(dict):
    """Numbers strings in the order in which they first appear."""

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        return code

    def of(self, words: list) -> np.ndarray:
        """The number of each word."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the index ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments of rows; an empty segment has sum 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full], axis=0, dtype=out.dtype)
    return out


def one_thread() -> None:
    """Keeps native libraries in a task to that task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def annotated(docs: DataFrame, kernel: Callable[[list[str]], list[pa.Array]], fields: str) -> DataFrame:
    """(row, *fields): each row as one column, and what the kernel finds in its text. Names of the row cannot clash.

    kernel: from texts (null: empty) to an array for each of the fields, which are given as in a DDL schema.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    added = StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, *kernel(texts_of(row.field("text")))], ["row", *added.fieldNames()])

    return packed.mapInArrow(run, StructType([*packed.schema.fields, *added.fields]))
