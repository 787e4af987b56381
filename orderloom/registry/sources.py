"""Tables written to and read from the shared folder, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators import workload
from orderloom.registry.core import Registry
from orderloom.session import shared_folder
from orderloom.sources import tables
from orderloom.sources.canonical import CanonicalTables
from orderloom.sources.schemas import table_schema

registry = Registry()
add = registry.add


def _stored_users(t: CanonicalTables) -> DataFrame:
    folder = shared_folder(t.spark, "users")
    t.v_users.write.mode("overwrite").parquet(folder)
    return tables.read_table(t.spark, folder, "users")


add(
    "s01_table_with_schema",
    lambda t: _stored_users(t).select(
        "id", "email", "name", "status", "tier", "registration_date", F.col("phone").isNull().alias("no_phone")
    ),
    "select id, email, name, status, tier, registration_date, true as no_phone from v_users",
)


def _stored_catalogue(t: CanonicalTables, category: str) -> DataFrame:
    folder = shared_folder(t.spark, "catalogue")
    t.part.select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        (F.col("p_size") * 20).alias("stock"),
        F.col("p_type").alias("category"),
    ).write.mode("overwrite").parquet(folder)
    return tables.read_catalogue(t.spark, folder, category)


add(
    "s02_catalogue_category",
    lambda t: _stored_catalogue(t, "ECONOMY").select("id", "name", "price", "stock", "category"),
    """select concat('p-', p_partkey) as id, p_name as name, p_retailprice as price, p_size * 20 as stock,
              p_type as category
       from part where p_type = 'ECONOMY'""",
    doubles="price",
)


def _json_orders(t: CanonicalTables) -> DataFrame:
    """Order requests as JSON, a part of them without status and time."""
    folder = shared_folder(t.spark, "requests")
    given = F.col("id") % 3 > 0
    t.v_orders.select(
        "id",
        "user_id",
        F.lit(1).alias("product_id"),
        F.lit(2).alias("quantity"),
        "total_amount",
        F.when(given, F.col("status")).alias("status"),
        F.when(given, F.col("created_at")).alias("created_at"),
    ).write.mode("overwrite").json(folder)
    return tables.read_json_records(
        t.spark, folder, table_schema("request_orders"), tables.order_defaults("2001-08-01 00:00:00")
    )


add(
    "s08_json_records",
    _json_orders,
    """select id, user_id, cast(1 as bigint) as product_id, cast(2 as int) as quantity,
              case when id % 3 > 0 then status else 'PENDING' end as status, total_amount,
              case when id % 3 > 0 then created_at else timestamp '2001-08-01' end as created_at,
              timestamp '2001-08-01' as updated_at
       from v_orders""",
    doubles="total_amount",
)
add(
    "s09_named_view",
    lambda t: tables.named_view(
        workload.performance_trend(t.v_query_log, min_calls=2), "query_performance_trend"
    ),
    "select query_id, query, calls, total_time, mean_time, rows from v_query_log where calls > 2",
    doubles="total_time mean_time",
)


def _baseline(t: CanonicalTables) -> DataFrame:
    folder = shared_folder(t.spark, "baseline")
    tables.append_table(
        workload.baseline_of(t.v_query_log, recorded_at="2024-01-31 00:00:00"), folder
    )
    return tables.read_table(t.spark, folder, "query_baseline")


add(
    "s10_baseline_snapshot",
    _baseline,
    """select query_id, md5(query) as query_hash, query as query_sample, mean_time as baseline_mean_time,
              cast(calls as int) as baseline_calls, total_time as baseline_total_time,
              timestamp '2024-01-31' as recorded_at
       from v_query_log""",
    doubles="baseline_mean_time baseline_total_time",
)


def _monthly_orders(t: CanonicalTables) -> DataFrame:
    folder = shared_folder(t.spark, "monthly")
    tables.write_by_month(t.v_orders, folder)
    return t.spark.read.parquet(folder)


add(
    "s11_month_layout",
    lambda t: _monthly_orders(t).where("year = 1998 and month between 3 and 5"),
    """select *, cast(year(created_at) as int) as year, cast(month(created_at) as int) as month
       from v_orders where created_at >= timestamp '1998-03-01' and created_at < timestamp '1998-06-01'""",
    doubles="total_amount",
)
