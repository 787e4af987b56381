"""Reading and writing commerce tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.constraints import fill_defaults
from orderloom.sources.schemas import table_schema


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A commerce table from Parquet with its fixed schema; columns it lacks read as null."""
    return spark.read.schema(table_schema(table)).parquet(path)


def read_catalogue(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """The product catalogue, keyed by text ids, optionally one category of it."""
    catalogue = spark.read.schema(table_schema("catalogue")).parquet(path)
    return catalogue if category is None else catalogue.where(F.col("category") == category)


def read_live_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str = "id",
    low: int,
    high: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A table of a running database, read in parallel by ranges of its key.

    Needs the driver of the database on the class path. Rows outside the range
    are read as well, by the first and the last task.
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(partitions))
    )
    return reader.options(**options).load()


def literal_rows(spark: SparkSession, rows: Sequence[tuple], table: str, columns: Sequence[str]) -> DataFrame:
    """A few given rows as a table; columns that are not given are null."""
    schema = table_schema(table)
    given = T.StructType([T.StructField(c, schema[c].dataType) for c in columns])
    df = spark.createDataFrame(rows, given)
    return df.select(
        *(
            (F.col(f.name) if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        )
    )


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, defaults: Mapping[str, object | Column]
) -> DataFrame:
    """JSON records of a fixed schema with defaults for what is missing."""
    return fill_defaults(spark.read.schema(schema).json(path), defaults)


def order_defaults(now: datetime | str) -> dict[str, Column]:
    """Defaults of a new order: pending, created and updated now."""
    at = F.lit(now if isinstance(now, str) else now.isoformat(sep=" ")).cast("timestamp_ntz")
    return {"status": F.lit("PENDING"), "created_at": at, "updated_at": at}


def named_view(df: DataFrame, name: str) -> DataFrame:
    """Give a query a name in the session and return it read through that name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def append_table(df: DataFrame, path: str) -> None:
    """Append rows, e.g. a snapshot of query baselines, to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_by_month(
    df: DataFrame, path: str, *, ts: str = "created_at", partitions: int | None = None
) -> None:
    """Write a fact table in folders by year and month of a timestamp.

    Rows are ranged by month and time first, so a task writes to few folders and
    the files of a month have narrow time ranges. A busy month is cut into as
    many ranges as its share of the rows asks for.
    """
    dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    by = [F.col("year"), F.col("month"), F.col(ts)]
    ranged = dated.repartitionByRange(*by) if partitions is None else dated.repartitionByRange(partitions, *by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_bucketed(
    df: DataFrame, table: str, path: str, *, key: str, buckets: int, sort: Sequence[str] = ()
) -> None:
    """Save a catalogue table bucketed by a join key, so that joins on it need no shuffle.

    Rows are spread by the key first, so a bucket is one file and not one per task.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key, *sort)
        .saveAsTable(table)
    )


def bucketed_facts(
    orders: DataFrame, items: DataFrame, folder: str, *, prefix: str, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """Save orders by id and their lines by order id in equal buckets; both as tables whose join needs no shuffle."""
    spark = orders.sparkSession
    for df, name, key in ((orders, "orders", "id"), (items, "items", "order_id")):
        write_bucketed(df, f"{prefix}_{name}", f"{folder}/{name}", key=key, buckets=buckets)
    return spark.table(f"{prefix}_orders"), spark.table(f"{prefix}_items")


def write_with_bloom_filter(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write Parquet with bloom filters on columns that are looked up by equality."""
    writer = df.write.mode("overwrite")
    for column in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
