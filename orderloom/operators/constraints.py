"""Checks for what a relational store would enforce, as rows of violations.

Every check returns (rule, key, column, value), all text, so that the results
of many checks can be put into one table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.sources.schemas import (
    CONSTRAINTS,
    Constraints,
    children_of,
    length_limits,
    required_columns,
)


def _violation(df: DataFrame, rule: str, key: Column, column: str, value: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        F.lit(column).alias("column"),
        value.cast("string").alias("value"),
    )


def not_null(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Nulls in any of the columns, found in a single scan."""
    missing = F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return df.select(F.col(key), F.explode(F.array_compact(missing)).alias("missing")).select(
        F.lit("not_null").alias("rule"),
        F.col(key).cast("string").alias("key"),
        F.col("missing").alias("column"),
        F.lit(None).cast("string").alias("value"),
    )


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values, or combinations of values, that occur more than once; nulls never collide."""
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    repeated = (
        df.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in columns))
    return _violation(repeated, "unique", text, ",".join(columns), F.col("copies"))


def in_range(df: DataFrame, column: str, low, high, key: str = "id") -> DataFrame:
    """Values outside a closed range; null passes."""
    outside = df.where(~F.col(column).between(low, high))
    return _violation(outside, "check_range", F.col(key), column, F.col(column))


def foreign_key(
    child: DataFrame, column: str, parent: DataFrame, *, parent_key: str = "id", key: str = "id"
) -> DataFrame:
    """Child rows whose reference is not null and not found in the parent."""
    present = child.where(F.col(column).isNotNull())
    orphans = present.join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")
    return _violation(orphans, "foreign_key", F.col(key), column, F.col(column))


def max_length(df: DataFrame, limits: Mapping[str, int], key: str = "id") -> DataFrame:
    """Texts longer than allowed, over all limited columns in a single scan."""
    found = F.array(
        *(
            F.when(
                F.length(c) > n,
                F.struct(F.lit(c).alias("column"), F.length(c).cast("string").alias("value")),
            )
            for c, n in limits.items()
        )
    )
    return df.select(F.col(key), F.explode(F.array_compact(found)).alias("v")).select(
        F.lit("max_length").alias("rule"),
        F.col(key).cast("string").alias("key"),
        F.col("v.column").alias("column"),
        F.col("v.value").alias("value"),
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace null by the default of the column; a value may be a Column."""
    filled = {
        c: F.coalesce(F.col(c), (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType))
        for c, v in defaults.items()
        if c in df.columns
    }
    return df.withColumns(filled)


def delete_cascade(child: DataFrame, column: str, deleted: DataFrame, *, deleted_key: str = "id") -> DataFrame:
    """Child rows that do not refer to a deleted parent."""
    return child.join(deleted.select(F.col(deleted_key).alias(column)), column, "left_anti").select(
        *child.columns
    )


def delete_set_null(
    child: DataFrame, column: str, deleted: DataFrame, *, deleted_key: str = "id"
) -> DataFrame:
    """Child rows with references to deleted parents set to null."""
    gone = deleted.select(F.col(deleted_key).alias(column), F.lit(True).alias("gone")).distinct()
    value = F.when(F.col("gone").isNull(), F.col(column)).alias(column)
    return child.join(gone, column, "left").select(
        *(value if c == column else F.col(c) for c in child.columns)
    )


def validate(df: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Violations of several rules in one table.

    Each rule is a check of this module followed by its further arguments, e.g.
    ``(in_range, "rating", 1, 5)``.
    """
    return reduce(DataFrame.unionByName, (check(df, *arguments) for check, *arguments in rules))


def table_violations(table: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All violations of the declared constraints of a table.

    References are checked where the parent table is given.
    """
    df, declared = tables[table], CONSTRAINTS.get(table, Constraints())
    present = set(df.columns)
    found = [not_null(df, [c for c in required_columns(table) if c in present])]
    limits = {c: n for c, n in length_limits(table).items() if c in present}
    if limits:
        found.append(max_length(df, limits))
    found += [unique(df, columns) for columns in (("id",), *declared.unique) if present.issuperset(columns)]
    found += [in_range(df, column, low, high) for column, low, high in declared.ranges]
    found += [
        foreign_key(df, r.column, tables[r.parent])
        for r in declared.references
        if r.parent in tables and r.column in present
    ]
    return reduce(DataFrame.unionByName, found)


class Deleted(NamedTuple):
    """The tables that a deletion changed, and the ids that a restricting reference kept from it."""

    tables: dict[str, DataFrame]
    blocked: DataFrame


def blocked_ids(table: str, ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Those of some ids (column id) that cannot be deleted.

    A restricting reference blocks the row it refers to, and a row that would be
    deleted along with it blocks it when it is blocked itself.
    """
    found = ids.where("false")
    for child, reference in children_of(table):
        if child not in tables or reference.on_delete == "null":
            continue
        parents = ids.select(F.col("id").alias("parent"))
        referring = tables[child].select(F.col(reference.column).alias("parent"), *(["id"] if "id" in tables[child].columns else []))
        referring = referring.join(parents, "parent", "left_semi")
        if reference.on_delete == "cascade":
            if not any(c in tables for c, _ in children_of(child)):
                continue
            referring = referring.join(blocked_ids(child, referring.select("id"), tables), "id", "left_semi")
        found = found.union(referring.select(F.col("parent").alias("id")))
    return found.distinct()


def delete_rows(table: str, deleted: DataFrame, tables: Mapping[str, DataFrame]) -> Deleted:
    """Delete rows by id and carry the deletion on to the tables that refer to them.

    ``deleted`` has the ids in its first column. Rows that a restricting
    reference holds, directly or through a cascade, stay with all that belongs
    to them, and their ids are returned.
    """
    ids = deleted.select(F.col(deleted.columns[0]).alias("id")).where("id is not null").distinct()
    blocked = blocked_ids(table, ids, tables)
    return Deleted(_deleted(table, ids.join(blocked, "id", "left_anti"), tables), blocked)


def _deleted(table: str, ids: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    result = {table: tables[table].join(ids, "id", "left_anti").select(*tables[table].columns)}
    for child, reference in children_of(table):
        if child not in tables or reference.on_delete == "restrict":
            continue
        current = {**tables, **result}
        if reference.on_delete == "null":
            result[child] = delete_set_null(current[child], reference.column, ids)
        else:
            gone = current[child].join(
                ids.select(F.col("id").alias(reference.column)), reference.column, "left_semi"
            )
            result.update(_deleted(child, gone.select("id"), current))
    return result
