"""Pairs of a Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.sources.canonical import CanonicalTables, duckdb_with

Build = Callable[[CanonicalTables], DataFrame]
DIGITS = 4


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and turn decimals into doubles, so that engines agree on the text."""
    columns = []
    for column in df.schema.fields:
        ref = F.col(f"`{column.name}`")
        if isinstance(column.dataType, (T.DoubleType, T.FloatType)):
            ref = F.round(ref.cast("double"), digits)
        elif isinstance(column.dataType, T.DecimalType):
            ref = ref.cast("double")
        elif isinstance(column.dataType, T.TimestampType):
            ref = ref.cast("timestamp_ntz")
        columns.append(ref.alias(column.name))
    return df.select(*columns)


@dataclass
class Registry:
    """Collects the queries of one area."""

    builders: dict[str, Build] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(
        self,
        name: str,
        build: Build,
        sql: str | None = None,
        *,
        doubles: str = "",
        digits: int = DIGITS,
        named: tuple[tuple[str, str], ...] = (),
    ) -> None:
        """Register a query.

        ``doubles`` lists the columns that the SQL side rounds, to ``digits`` places
        like the Spark side; ``named`` are extra named subqueries for it.
        """
        if name in self.builders:
            raise ValueError(f"{name} is registered twice")
        self.builders[name] = build
        self.digits[name] = digits
        if sql is not None:
            rounded = ", ".join(
                f"round(cast({c} as double), {digits}) as {c}" for c in doubles.split()
            )
            star = f"* replace ({rounded})" if rounded else "*"
            self.oracles[name] = duckdb_with(f"select {star} from ({sql}) answer", *named)

    def also(self, name: str, like: str, build: Build) -> None:
        """Register another way to the rows of a query that is there already, against the same SQL."""
        self.add(name, build)
        self.digits[name], self.oracles[name] = self.digits[like], self.oracles[like]

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
            build, digits = self.builders[name], self.digits[name]
            return lambda spark, directory: comparable(build(CanonicalTables(spark, directory)), digits)

        return {name: bind(name) for name in self.builders}
