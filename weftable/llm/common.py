"""Helpers shared by the corpus operators: Arrow mappers, shared tables, size checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftable.sources.shared import scratch, shared_path, written

__all__ = ["blocks", "key_and_text", "map_blocks", "scratch", "shared_path", "text_udf", "utf8", "written"]

#: Text bytes handed to Python at once; whole rows, so one longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of `column`, so that memory follows neither batch nor table size."""
    if batch.nbytes <= limit:
        yield batch
        return
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory of a worker to the machine at the end of a task: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_blocks(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded size; fn may return None for nothing."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, text):
                out = fn(block)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def text_udf(fn: Callable[[pa.Array], pa.Array], kind: str):
    """A scalar UDF of a text column, given to fn as Arrow strings in slices of bounded size.

    Only the texts go to Python: the other columns of the rows stay in the JVM."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            made = [fn(b.column("text")) for b in blocks(batch, "text")]
            yield made[0] if len(made) == 1 else pa.concat_arrays(made)
        give_back()

    return run


def utf8(column: pa.Array) -> list[bytes | None]:
    """Whole texts as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def key_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, under fixed names: other columns may have any name."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
