"""What the vector operators share: which vectors take part, Arrow lists as matrices, streams of groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null and not zero, with components that are all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def proper_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part and have an identifier; their lengths may differ."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(takes_part(F.col("vector")) & F.col("vec_id").isNotNull())


def by_length(vectors: DataFrame) -> list[DataFrame]:
    """The vectors of each length; only vectors of one length can be compared."""
    sizes = [row.size for row in vectors.select(F.size("vector").alias("size")).distinct().orderBy("size").collect()]
    return [vectors.where(F.size("vector") == size) for size in sizes] if len(sizes) > 1 else [vectors]


def matrix(batch: pa.RecordBatch | pa.Table, column: str = "vector") -> np.ndarray:
    """A column of lists of one length as a matrix."""
    lists = batch.column(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[name].to_numpy()


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each as one table; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [column(batch, key) for key in keys]
        changes = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for start, stop in zip([0, *changes], [*changes, batch.num_rows]):
            key = tuple(v[start] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)
