"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ravelin.shipping import shipped
from ravelin.storage import exists, file_system, new_path, removed, shared_dir, written  # noqa: F401

#: What counts as white space for line keys and words: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def detached(c: Column) -> Column:
    """The same long behind an expression: a join on it gets an exchange of its own,
    so that adaptive execution can split skewed partitions of the other side."""
    return c.bitwiseXOR(F.lit(0).cast("long"))


def met(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: sorted and merged, never collected by the driver to be broadcast,
    whatever size the session lets it broadcast."""
    return df.hint("merge")


#: Rows and bytes that go to a Python function at a time. Texts are long: this bounds memory, not what is processed.
SLICE, SLICE_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut the batches for Python functions to these sizes, unless the session says otherwise."""
    for name, usual, wanted in (("maxRecordsPerBatch", "10000", SLICE), ("maxBytesPerBatch", "67108864b", SLICE_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, str(wanted))


def discarded(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` returned and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        removed(df.sparkSession, files[0].rpartition("/")[0])


def trimmed() -> None:
    """Give memory that this process has freed back to the system: workers and drivers stay for what comes later."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_slices(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """df.mapInPandas(f, schema) with frames of at most SLICE rows; integers with nulls stay exact."""
    shipped(df.sparkSession)
    small_batches(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)

        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    yield batch.slice(at, SLICE).to_pandas(integer_object_nulls=True)

        for out in f(frames()):
            yield from pa.Table.from_pandas(out, schema=arrow, preserve_index=False).combine_chunks().to_batches()
        pa.default_memory_pool().release_unused()
        trimmed()

    return df.mapInArrow(run, kind)
