"""What several operators share: column selection, shared storage and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.session import scratch_root

# Bytes of text handled together inside a Python worker; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: extra columns cannot clash."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach."""
    return f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back; later stages survive lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``SLICE_BYTES`` of ``column``."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the offset at which each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = lists.values, lists.offsets.to_numpy()
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return values.filter(pa.array(full)), before[offsets]


def map_texts(
    df: DataFrame, worker: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text"
) -> DataFrame:
    """``worker`` over slices of bounded size; its result rows need not match the input rows."""

    def run(batches):
        for part in text_slices(batches, column):
            yield worker(part)

    return df.mapInArrow(run, schema)


def crc_of_id(column: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(column.cast("string").cast("binary"))


def keep_texts(
    df: DataFrame, decide: Callable[[list[bytes]], list[bool]], text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, whose text ``decide`` keeps. Nothing is shuffled."""

    def run(batches):
        for part in text_slices(batches, text_col):
            yield part.filter(pa.array(decide(raw_texts(part, text_col)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
