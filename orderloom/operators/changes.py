"""Batch application of change sets to a snapshot table.

The snapshot is the large side. Changes are first reduced to one row per key,
and every operation is a left or anti join against that, so the planner may
broadcast a small change set and leave the snapshot where it is.

Changes of one key apply in the order of ``ts`` and then ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


class Applied(NamedTuple):
    """A new snapshot and the changes that found no place in it."""

    snapshot: DataFrame
    rejects: DataFrame


def _sequence(changes: DataFrame) -> Column:
    """Place of a change among those of its key; the whole row decides between equals, the same in every retry."""
    return F.struct(*(c for c in ORDER if c in changes.columns), F.struct(*changes.columns))


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each key; reduced before the shuffle. Rows without a key are left out."""
    row = F.struct(*changes.columns)
    return (
        changes.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(row, _sequence(changes)).alias("last"))
        .select("last.*")
    )


def _rejects(changes: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Changes without a key or with one that the snapshot does not hold.

    The snapshot's keys are first cut to those of the changes, so that a small
    change set is broadcast and the snapshot stays where it is.
    """
    known = snapshot.select(key).join(changes.select(key).distinct(), key, "left_semi")
    return changes.join(known, key, "left_anti").select(*changes.columns)


def upsert(snapshot: DataFrame, changes: DataFrame, key: str = "id") -> Applied:
    """Insert rows, or replace whole rows where the key exists, nulls included.

    Changes without a key are rejected, every one of them; ``insert_with_ids``
    inserts them.
    """
    rows = latest(changes, key).select(*snapshot.columns)
    kept = snapshot.join(rows.select(key), key, "left_anti").select(*snapshot.columns)
    return Applied(kept.unionByName(rows), changes.where(F.col(key).isNull()))


def insert_with_ids(snapshot: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Upsert after giving a random id to rows that have none.

    A retried task would draw other ids, so write the result once and read it
    from there.
    """
    known = upsert(snapshot, changes, key)
    return known.snapshot.unionByName(known.rejects.withColumn(key, F.uuid()).select(*snapshot.columns))


def update_users(snapshot: DataFrame, changes: DataFrame) -> Applied:
    """Overwrite e-mail and name, the password only where one is given; touch ``updated_at``.

    An earlier password stays if a later change of the same user has none.
    Changes without a time come before all others of their user, and where no
    change has one, ``updated_at`` stays as it is.
    """
    at = _sequence(changes)
    reduced = changes.groupBy("id").agg(
        F.lit(True).alias("changed"),
        F.max_by("email", at).alias("new_email"),
        F.max_by("name", at).alias("new_name"),
        F.max_by(
            F.col("password"), F.when(F.col("password").isNotNull(), at)
        ).alias("new_password"),
        F.max("ts").alias("changed_at"),
    )
    merged = snapshot.join(reduced, "id", "left")
    values = {
        "email": F.when(F.col("changed"), F.col("new_email")).otherwise(F.col("email")),
        "name": F.when(F.col("changed"), F.col("new_name")).otherwise(F.col("name")),
        "password": F.coalesce("new_password", "password"),
        "updated_at": F.coalesce("changed_at", "updated_at"),
    }
    return Applied(
        merged.select(*(values.get(c, F.col(c)).alias(c) for c in snapshot.columns)),
        _rejects(changes, snapshot, "id"),
    )


def overwrite_columns(
    snapshot: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "id",
    touch: str | None = None,
) -> Applied:
    """Set some columns from the last change of each key, nulls included."""
    kept = [F.col(c).alias(f"new_{c}") for c in columns]
    reduced = latest(changes, key).select(key, F.lit(True).alias("changed"), F.col("ts").alias("at"), *kept)
    merged = snapshot.join(reduced, key, "left")
    changed = F.coalesce("changed", F.lit(False))

    def value(column: str) -> Column:
        if column in columns:
            return F.when(changed, F.col(f"new_{column}")).otherwise(F.col(column)).alias(column)
        if column == touch:
            return F.when(changed, F.col("at")).otherwise(F.col(column)).alias(column)
        return F.col(column)

    return Applied(
        merged.select(*(value(c) for c in snapshot.columns)), _rejects(changes, snapshot, key)
    )


def update_products(snapshot: DataFrame, changes: DataFrame) -> Applied:
    """Overwrite name, description, price, stock and category; keep id and creation time."""
    return overwrite_columns(snapshot, changes, ["name", "description", "price", "stock", "category"])


def update_order_status(snapshot: DataFrame, changes: DataFrame) -> Applied:
    """Set the status, any value, and touch ``updated_at``."""
    return overwrite_columns(snapshot, changes, ["status"], touch="updated_at")


def status_events(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """One ``ORDER_STATUS_UPDATED`` row per change of a known order, with its new status."""
    return changes.select("id", F.col("status").alias("new_status"), F.col("ts")).join(
        snapshot.drop("status"), "id"
    ).withColumnRenamed("new_status", "status")


def add_stock(snapshot: DataFrame, deltas: DataFrame, *, stock: str = "stock") -> Applied:
    """Add the summed deltas of each product; stock may become negative."""
    totals = deltas.groupBy("id").agg(F.sum("quantity").alias("delta"))
    kind = snapshot.schema[stock].dataType
    merged = snapshot.join(totals, "id", "left").withColumn(
        stock, (F.col(stock) + F.coalesce("delta", F.lit(0))).cast(kind)
    )
    return Applied(merged.select(*snapshot.columns), _rejects(deltas, snapshot, "id"))


def delete_keys(snapshot: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed."""
    return snapshot.join(keys.select(key), key, "left_anti")
