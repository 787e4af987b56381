"""Violations of a new snapshot from those of the old one and the rows that changed.

A change set is given as the rows that it took away and the rows that it
brought; a changed row is in both. Only changed rows and changed keys are
checked again: against stored counts of unique keys, against the parents, and,
where parents changed, against the children that name them. The results equal
the full checks of ``constraints`` over the new snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators import constraints


class RowChanges(NamedTuple):
    """Whole rows that left a snapshot and whole rows that entered it."""

    removed: DataFrame
    added: DataFrame


def _not_of(violations: DataFrame, keys: DataFrame) -> DataFrame:
    """Violations but for those of some keys; the keys are few, the violations stay where they are."""
    return violations.join(keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct(), "key", "left_anti").select(
        *violations.columns
    )


def _touched(changes: RowChanges, key: str) -> DataFrame:
    return changes.removed.select(key).unionByName(changes.added.select(key)).distinct()


def row_check(
    before: DataFrame, changes: RowChanges, check: Callable[[DataFrame], DataFrame], *, key: str = "id"
) -> DataFrame:
    """A check that looks at one row at a time, such as ``not_null``, ``in_range`` or ``max_length``.

    ``before`` has the check's violations in the old snapshot.
    """
    return _not_of(before, _touched(changes, key)).unionByName(check(changes.added))


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have each combination of values; combinations with a null are left out."""
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def _count_changes(changes: RowChanges, columns: Sequence[str]) -> DataFrame:
    signed = key_counts(changes.added, columns).unionByName(
        key_counts(changes.removed, columns).withColumn("copies", -F.col("copies"))
    )
    return signed.groupBy(*columns).agg(F.sum("copies").alias("change"))


def changed_counts(counts: DataFrame, changes: RowChanges, columns: Sequence[str]) -> DataFrame:
    """The new counts of the changed keys alone, zeros included."""
    columns = list(columns)
    moved = _count_changes(changes, columns)
    known = counts.join(moved.select(*columns), columns, "left_semi")
    both = moved.join(known, columns, "left")
    return both.select(*columns, (F.coalesce("copies", F.lit(0)) + F.col("change")).cast("bigint").alias("copies"))


def unique_check(before: DataFrame, counts: DataFrame, changes: RowChanges, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; ``counts`` are those of the old snapshot, from ``key_counts``."""
    columns = list(columns)
    now = changed_counts(counts, changes, columns)
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in columns))
    repeated = now.where("copies > 1").select(
        F.lit("unique").alias("rule"),
        text.alias("key"),
        F.lit(",".join(columns)).alias("column"),
        F.col("copies").cast("string").alias("value"),
    )
    return _not_of(before, now.select(text.alias("key"))).unionByName(repeated)


def foreign_key_check(
    before: DataFrame,
    child: DataFrame,
    changes: RowChanges,
    column: str,
    parent: DataFrame,
    parent_changes: RowChanges | None = None,
    *,
    parent_key: str = "id",
    key: str = "id",
) -> DataFrame:
    """Children whose reference is not found; ``child`` and ``parent`` are the new snapshots.

    Brought rows are looked up in the parents. Parents that are gone make
    violations of the children that name them, which are found by a join of the
    children with these few keys; parents that came heal violations by value.
    """
    kept = _not_of(before, _touched(changes, key))
    brought = constraints.foreign_key(changes.added, column, parent, parent_key=parent_key, key=key)
    if parent_changes is None:
        return kept.unionByName(brought)
    came = parent_changes.added.select(F.col(parent_key).cast("string").alias("value")).distinct()
    gone = (
        parent_changes.removed.select(F.col(parent_key).alias(column))
        .distinct()
        .join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")
    )
    named = child.join(gone, column, "left_semi").join(changes.added.select(key), key, "left_anti")
    lost = constraints.foreign_key(named, column, parent.limit(0), parent_key=parent_key, key=key)
    healed = kept.join(came, "value", "left_anti").select(*before.columns)
    left = healed.join(lost.select("key"), "key", "left_anti").select(*before.columns)
    return left.unionByName(lost).unionByName(brought)
