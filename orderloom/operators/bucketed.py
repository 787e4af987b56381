"""Snapshots in folders by key bucket, of which a change set rewrites only those that it touches.

The bucket of a row follows from its key alone, so the rows that a change can
meet are in the buckets of the changed keys. Their numbers are literals of the
scan, and only their folders are written again; all other files stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.changes import Applied
from orderloom.session import stored

BUCKETS = 1024

#: Folder columns: how many buckets the table has, and which one a row is in.
_OF, _BUCKET = "of", "bucket"
_FOLDERS = (_OF, _BUCKET)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    dealt = df.withColumns({_OF: F.lit(buckets), _BUCKET: _bucket(key, buckets)}).hint("rebalance", _BUCKET)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*_FOLDERS).parquet(path)


def write_buckets(df: DataFrame, path: str, *, key: str = "id", buckets: int = BUCKETS) -> None:
    """Write a snapshot in buckets; a bucket has one file, or several where it is large."""
    _write(df, path, key, buckets)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folders = [T.StructField(c, T.IntegerType()) for c in _FOLDERS]
    return spark.read.schema(T.StructType([*schema, *folders])).parquet(path)


def read_buckets(
    spark: SparkSession, path: str, schema: T.StructType, numbers: list[int] | None = None
) -> DataFrame:
    """The snapshot, or the rows of some buckets; other folders are not opened."""
    table = _read(spark, path, schema)
    if numbers is not None:
        table = table.where(F.col(_BUCKET).isin(numbers))
    return table.select(*schema.names)


def apply_to_buckets(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    changes: DataFrame,
    operation: Callable[[DataFrame, DataFrame], Applied],
    *,
    key: str = "id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Apply a change set to the stored snapshot in place, and return its rejects.

    ``operation`` is one of the changes that keep every row of the snapshot
    (``upsert``, ``update_users``, ``overwrite_columns``, ``add_stock`` and the
    like); one that deletes rows could leave a bucket empty, which would not be
    written again. ``changes`` are read more than once and must stay the same.

    New buckets are stored before the old ones are replaced, so a failure until
    then changes nothing. The replacement goes folder by folder: after a failure
    in it, upserts and overwrites can be applied again, sums such as
    ``add_stock`` can not. Only numbers of buckets reach the driver.
    """
    table = _read(spark, path, schema)
    if not table.where(F.col(_OF) != buckets).isEmpty():
        raise ValueError(f"the table was not written in {buckets} buckets")
    numbers = changes.where(F.col(key).isNotNull()).select(_bucket(key, buckets).alias(_BUCKET)).distinct()
    touched = sorted(row[_BUCKET] for row in numbers.collect())  # at most one per bucket
    applied = operation(read_buckets(spark, path, schema, touched), changes)
    rejects = stored(applied.rejects, "rejects")
    if touched:
        _write(stored(applied.snapshot.select(*schema.names), "touched"), path, key, buckets)
    return rejects
