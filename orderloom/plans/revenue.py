"""Revenue over time, experiment groups and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import Day, midnight, month_number, month_start, percent, quotient


def monthly_category_revenue(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    *,
    statuses: Sequence[str] = ("DELIVERED", "PROCESSING"),
    since: Day,
) -> DataFrame:
    """Revenue per month and category with running total and change to the month before.

    Counts and revenue are weighted by order line. Lines are summed per (month,
    product) before the product join, so a hot product is one row per month by
    then. The running total goes through the categories of a month by name.
    """
    sold = orders.where(
        F.col("status").isin(*statuses) & (F.col("created_at") >= midnight(since))
    ).select(
        F.col("id").alias("order_id"), month_start(F.col("created_at")).alias("month"), "total_amount"
    )
    per_product = (
        items.select("order_id", "product_id")
        .join(sold, "order_id")
        .groupBy("month", "product_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count("total_amount").alias("amounts"),
            F.sum("total_amount").alias("revenue"),
        )
    )
    named = products.select(F.col("id").alias("product_id"), "category_id").join(
        categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")),
        "category_id",
    )
    monthly = (
        per_product.join(named, "product_id")
        .groupBy("month", "category_id", "category_name")
        .agg(
            F.sum("lines").alias("order_count"),
            F.sum("amounts").alias("amounts"),
            F.sum("revenue").alias("total_revenue"),
        )
    )
    within_month = (
        Window.partitionBy("month")
        .orderBy("category_name", "category_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    by_category = Window.partitionBy("category_id").orderBy("month")
    previous = F.col("previous_month_revenue")
    change = F.col("total_revenue") - previous
    return (
        monthly.withColumn("cumulative_revenue", F.sum("total_revenue").over(within_month))
        .withColumn("previous_month_revenue", F.lag("total_revenue").over(by_category))
        .select(
            "month",
            "category_name",
            "order_count",
            "total_revenue",
            quotient(F.col("total_revenue"), F.col("amounts")).alias("avg_order_value"),
            "cumulative_revenue",
            "previous_month_revenue",
            change.alias("revenue_change"),
            F.when(previous > 0, percent(change, previous)).alias("revenue_growth_rate"),
        )
        .orderBy(F.col("month").desc(), F.col("total_revenue").desc_nulls_first(), "category_name")
    )


def experiment_summary(users: DataFrame, orders: DataFrame, *, since: Day) -> DataFrame:
    """Delivered orders of newly registered active users, split by id parity.

    Conversions count orders, so the rate may pass 100 percent. Users and orders
    are aggregated apart and meet as one row per group.
    """
    group = F.when(F.col("user_id") % 2 == 0, "CONTROL_GROUP").otherwise("TEST_GROUP")
    members = users.where(
        (F.col("status") == "ACTIVE") & (F.col("registration_date") >= midnight(since))
    ).select(F.col("id").alias("user_id"))
    sizes = members.groupBy(group.alias("experiment_group")).agg(F.count("user_id").alias("user_count"))
    revenue = (
        orders.where((F.col("created_at") >= midnight(since)) & (F.col("status") == "DELIVERED"))
        .select("user_id", "id", "total_amount")
        .join(members, "user_id", "left_semi")
        .groupBy(group.alias("experiment_group"))
        .agg(
            F.count("id").alias("conversions"),
            F.sum("total_amount").alias("total_revenue"),
            F.count("total_amount").alias("amounts"),
            F.stddev_samp(F.col("total_amount").cast("double")).alias("revenue_stddev"),
        )
    )
    conversions = F.coalesce("conversions", F.lit(0))
    mean = quotient(F.col("total_revenue"), F.col("amounts"))
    return (
        sizes.join(revenue, "experiment_group", "left")
        .select(
            "experiment_group",
            "user_count",
            conversions.alias("conversion_count"),
            percent(conversions, F.col("user_count")).alias("conversion_rate"),
            "total_revenue",
            mean.alias("avg_revenue_per_user"),
            mean.alias("avg_revenue_per_paying_user"),
            "revenue_stddev",
        )
        .orderBy("experiment_group")
    )


def cohort_retention(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Active users per registration month and months since then.

    The cohort size is the number of users in the earliest month seen, which may
    lie before registration. Orders are reduced to (user, month) before they
    meet the users, so a busy user does not travel with all orders.
    """
    cohorts = users.where(F.col("status") == "ACTIVE").select(
        F.col("id").alias("user_id"), month_start(F.col("registration_date")).alias("cohort_month")
    )
    months = (
        orders.where(F.col("user_id").isNotNull())
        .select("user_id", month_number(F.col("created_at")).alias("activity"))
        .distinct()
    )
    active = (
        months.join(cohorts, "user_id")
        .select(
            "cohort_month",
            (F.col("activity") - month_number(F.col("cohort_month"))).alias("month_number"),
        )
        .where(F.col("month_number").isNotNull())
        .groupBy("cohort_month", "month_number")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    return _retention(active)


def _retention(active: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("cohort_month").orderBy("month_number")
    previous = F.col("previous_month_users")
    return (
        active.withColumn("cohort_size", F.first("active_users").over(in_order))
        .withColumn("previous_month_users", F.lag("active_users").over(in_order))
        .select(
            "cohort_month",
            "cohort_size",
            "month_number",
            "active_users",
            percent(F.col("active_users"), F.col("cohort_size")).alias("retention_rate"),
            "previous_month_users",
            F.when(previous > 0, percent(F.col("active_users"), previous)).alias(
                "month_over_month_retention"
            ),
        )
        .orderBy(F.col("cohort_month").desc(), "month_number")
    )


def registered_bitmaps(users: DataFrame) -> DataFrame:
    """Active users per registration month as bitmaps: cohort_month, part and users.

    A part is a range of user numbers, of which a bitmap holds one bit each.
    """
    return (
        users.where(F.col("status") == "ACTIVE")
        .groupBy(month_start(F.col("registration_date")).alias("cohort_month"), F.bitmap_bucket_number("id").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("users"))
    )


def ordering_bitmaps(orders: DataFrame) -> DataFrame:
    """Users with an order per month as bitmaps: activity (a month number), part and users."""
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy(month_number(F.col("created_at")).alias("activity"), F.bitmap_bucket_number("user_id").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))
    )


def merged_bitmaps(bitmaps: DataFrame, by: str) -> DataFrame:
    """Bitmaps of several batches as one per month and part."""
    return bitmaps.groupBy(by, "part").agg(F.bitmap_or_agg("users").alias("users"))


def retention_of_bitmaps(registered: DataFrame, ordering: DataFrame) -> DataFrame:
    """``cohort_retention``, exact, from stored bitmaps instead of users and orders.

    Cohorts and months meet per part, so no user is shuffled. User numbers that
    rise with registration keep a part to a few cohorts; where they are spread
    at random every part meets all cohorts with all months.
    """
    sides = F.array(F.col("members"), F.col("users"))
    both = (
        registered.withColumnRenamed("users", "members")
        .join(ordering, "part")
        .select("cohort_month", "activity", "part", F.explode(sides).alias("side"))
        .groupBy("cohort_month", "activity", "part")
        .agg(F.bitmap_count(F.bitmap_and_agg("side")).alias("users"))
    )
    active = (
        both.withColumn("month_number", F.col("activity") - month_number(F.col("cohort_month")))
        .where(F.col("month_number").isNotNull())
        .groupBy("cohort_month", "month_number")
        .agg(F.sum("users").alias("active_users"))
        .where("active_users > 0")
    )
    return _retention(active)
