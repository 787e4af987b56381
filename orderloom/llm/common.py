"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.session import shared_folder


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Cuts the lineage: what was written survives the loss of executors, and a
    join with it sees plain exchanges that the planner can split at run time.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most so many rows, the first by a hash of some columns, the same on every run.

    A first filter on the hash leaves about twice as many, so that tasks do not
    each send their own first rows to the driver.
    """
    share = min(1.0, 2 * most / max(1, df.count()))
    place = F.xxhash64(*columns, F.lit(29))
    low = df.where(place <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    return low.orderBy(place, *columns).limit(most)


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary file of that name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows that a Python task handles at a time, whatever the size of the Arrow batches.
SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that only a few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def from_text(docs: DataFrame, name: str, kind: T.DataType, arrow_kind: pa.DataType, make: Callable[[], Callable]) -> DataFrame:
    """``row``, all columns as they were, and a column made from the texts of a slice.

    ``make`` is called in the task and returns a function from a list of texts
    to a list of values. Only short slices become Python objects, and the other
    columns pass through as Arrow data.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField(name, kind)])

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches):
            texts = pc.struct_field(batch["row"], "text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(function(texts), arrow_kind)], names=["row", name])

    return packed.mapInArrow(mapped, schema)
