"""Customer statistics, segments and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.scalars import Day, as_day, bounded, flag_sum, midnight, quotient, top_rows


def customer_stats(
    users: DataFrame, orders: DataFrame, items: DataFrame, *, since: Day, top: int = 100
) -> DataFrame:
    """Purchase statistics of active users registered on or after ``since``.

    Amounts are weighted by order line: an order with three lines counts three
    times in spend, average and status counts, one without lines once. Lines
    are first grouped by (user, product), which gives the number of distinct
    products without a distinct aggregate and spreads out a single busy user.
    Only the leaders are then joined with names and order counts.
    """
    members = users.where((F.col("status") == "ACTIVE") & (F.col("registration_date") >= midnight(since)))
    placed = orders.join(
        members.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    ).select(F.col("id").alias("order_id"), "user_id", "status", "total_amount", "created_at")

    by_product = (
        placed.join(items.select("order_id", "product_id"), "order_id", "left")
        .groupBy("user_id", "product_id")
        .agg(
            F.sum("total_amount").alias("spent"),
            F.count("total_amount").alias("amounts"),
            F.max("created_at").alias("last_order"),
            flag_sum(F.col("status") == "DELIVERED").alias("delivered"),
            flag_sum(F.col("status") == "CANCELLED").alias("cancelled"),
        )
    )
    by_user = by_product.groupBy("user_id").agg(
        F.sum("spent").alias("total_spent"),
        F.sum("amounts").alias("amounts"),
        F.max("last_order").alias("last_order_date"),
        F.count("product_id").alias("unique_products_purchased"),
        F.sum("delivered").alias("delivered_orders"),
        F.sum("cancelled").alias("cancelled_orders"),
    )
    ranking = (F.col("total_spent").desc_nulls_first(), F.col("user_id"))
    leaders = by_user.orderBy(*ranking).limit(top)

    named = members.select(F.col("id").alias("user_id"), "name", "email", "tier").join(
        bounded(leaders, top), "user_id"
    )
    columns = named.columns
    counted = (
        orders.select("user_id", F.col("id").alias("order_id"))
        .join(bounded(named, top), "user_id")
        .groupBy(*columns)
        .agg(F.count("order_id").alias("total_orders"))
    )
    return counted.select(
        F.col("user_id").alias("id"),
        "name",
        "email",
        "tier",
        "total_orders",
        "total_spent",
        quotient(F.col("total_spent"), F.col("amounts")).alias("avg_order_value"),
        "last_order_date",
        "unique_products_purchased",
        "delivered_orders",
        "cancelled_orders",
    ).orderBy(F.col("total_spent").desc_nulls_first(), "id")


def rfm_segments(
    users: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    *,
    as_of: Day,
) -> DataFrame:
    """Recency, frequency, monetary value and segment of every active user.

    The gaps between consecutive orders of a user add up to the span from the
    first to the last one, so the mean gap needs no window: it is the span
    divided by one less than the number of orders. Ties for the favourite
    category go to the first name in order.
    """
    today = F.lit(as_day(as_of))
    history = orders.groupBy("user_id").agg(
        F.count("id").alias("frequency"),
        F.sum("total_amount").alias("monetary"),
        F.to_date(F.min("created_at")).alias("first_day"),
        F.to_date(F.max("created_at")).alias("last_day"),
        F.count("created_at").alias("dated"),
    )

    named = products.select(F.col("id").alias("product_id"), "category_id").join(
        categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")),
        "category_id",
    )
    active = users.where(F.col("status") == "ACTIVE")
    owned = (
        orders.where(F.col("user_id").isNotNull())
        .select(F.col("id").alias("order_id"), "user_id")
        .join(active.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    )
    # One row per user and product, so that a product with very many lines is not one key of the join.
    per_category = (
        items.select("order_id", "product_id")
        .join(owned, "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("lines"))
        .join(named, "product_id")
        .groupBy("user_id", "category_id", "category_name")
        .agg(F.sum("lines").alias("lines"))
    )
    favourite = per_category.groupBy("user_id").agg(
        F.min(F.struct((-F.col("lines")).alias("rank"), F.col("category_name"))).alias("best")
    )

    recency = F.datediff(today, F.col("last_day"))
    frequency = F.coalesce(F.col("frequency"), F.lit(0))
    monetary = F.col("monetary")
    segment = (
        F.when((frequency >= 10) & (monetary >= 1_000_000) & (recency <= 30), "VIP_CHAMPION")
        .when((frequency >= 5) & (monetary >= 500_000), "LOYAL_CUSTOMER")
        .when((frequency >= 2) & (recency <= 90), "POTENTIAL_LOYALIST")
        .when((frequency == 1) & (recency <= 30), "NEW_CUSTOMER")
        .when(recency > 180, "AT_RISK")
        .when(frequency == 0, "NON_CUSTOMER")
        .otherwise("REGULAR_CUSTOMER")
    )
    cycle = F.round(quotient(F.datediff("last_day", "first_day"), F.col("dated") - 1))

    return (
        active.select(F.col("id").alias("user_id"), "name", "email", "tier", "registration_date")
        .join(history, "user_id", "left")
        .join(favourite, "user_id", "left")
        .select(
            F.col("user_id").alias("id"),
            "name",
            "email",
            "tier",
            "registration_date",
            recency.alias("recency_days"),
            frequency.alias("frequency"),
            "monetary",
            segment.alias("customer_segment"),
            F.col("best.category_name").alias("favorite_category"),
            cycle.alias("avg_purchase_cycle_days"),
        )
        .orderBy(F.col("monetary").desc_nulls_first(), "id")
    )


def _orders_by_name(users: DataFrame, orders: DataFrame, since: Day) -> DataFrame:
    """Orders since a day, summed per user before the join and per name after it."""
    per_user = (
        orders.where(F.col("created_at") >= midnight(since))
        .groupBy("user_id")
        .agg(F.count("id").alias("orders"), F.sum("total_amount").alias("spent"))
    )
    active = users.where(F.col("status") == "ACTIVE").select(F.col("id").alias("user_id"), "name")
    return (
        active.join(per_user, "user_id")
        .groupBy("name")
        .agg(F.sum("orders").alias("order_count"), F.sum("spent").alias("total_spent"))
    )


def top_customers_by_spend(
    users: DataFrame, orders: DataFrame, *, since: Day, top: int = 10
) -> DataFrame:
    """Names of active users with the highest spend; namesakes are one entry."""
    return top_rows(
        _orders_by_name(users, orders, since), top, F.col("total_spent").desc_nulls_first(), F.col("name")
    )


def top_customers_by_orders(
    users: DataFrame, orders: DataFrame, *, since: Day, top: int = 10
) -> DataFrame:
    """Names of active users with the most orders; namesakes are one entry."""
    counted = _orders_by_name(users, orders, since).select("name", "order_count")
    return top_rows(counted, top, F.col("order_count").desc(), F.col("name"))
