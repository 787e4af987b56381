"""Search effectiveness and the view-cart-order funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import Day, midnight, minute_index, percent, quotient, top_rows
from orderloom.operators.ordered import running_totals


def _first_orders_after_click(clicks: DataFrame, purchases: DataFrame) -> DataFrame:
    """Clicked searches with the lowest order id among later purchases.

    A purchase counts if the same user bought the clicked product strictly after
    the search. Searches and purchases are laid on one timeline per user and
    product. Equal entries of an instant are one row with a weight by then, and
    a running minimum from the end of the timeline gives each search the lowest
    order id after it. So no search is paired with every purchase, and a busy
    user, product or minute is cut into pieces.
    """
    searched = clicks.groupBy(
        "user_id", F.col("clicked_product_id").alias("product_id"), F.col("created_at").alias("at"), "search_query"
    ).agg(
        F.count(F.lit(1)).alias("searches"),
        F.sum("results_count").alias("results"),
        F.count("results_count").alias("with_results"),
    )
    clicked = searched.select("user_id", "product_id").distinct()
    bought = (
        purchases.groupBy("user_id", "product_id", F.col("created_at").alias("at"))
        .agg(F.min("order_id").cast("bigint").alias("order_id"))
        .join(clicked, ["user_id", "product_id"], "left_semi")
    )
    timeline = searched.withColumn("search", F.lit(True)).unionByName(
        bought.withColumn("search", F.lit(False)), allowMissingColumns=True
    )
    # From the end, searches come before a purchase of the same instant.
    followed = running_totals(
        timeline,
        ["user_id", "product_id"],
        -minute_index(F.col("at")),
        ["at", "search", "search_query"],
        {},
        minima={"converted_order": F.col("order_id")},
        descending=True,
    )
    return followed.where("search").select(
        "user_id",
        F.col("product_id").alias("clicked_product_id"),
        F.col("at").alias("created_at"),
        "search_query",
        "searches",
        "results",
        "with_results",
        "converted_order",
    )


def search_effectiveness(
    searches: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    *,
    as_of: Day,
    days: int = 30,
    min_searches: int = 10,
    top: int = 50,
) -> DataFrame:
    """Searches, clicks and purchases after a click, per search text and hour of day."""
    start = midnight(as_of, days)
    recent = searches.where(F.col("created_at") >= start).select(
        "user_id", "search_query", "results_count", "clicked_product_id", "created_at"
    )
    clicked = F.col("user_id").isNotNull() & F.col("clicked_product_id").isNotNull()
    purchases = (
        orders.where((F.col("created_at") > start) & F.col("user_id").isNotNull())
        .select(F.col("id").alias("order_id"), "user_id", "created_at")
        .join(items.select("order_id", "product_id"), "order_id")
    )
    followed = _first_orders_after_click(recent.where(clicked), purchases)
    other = recent.where(~clicked).select(
        "user_id",
        "clicked_product_id",
        "created_at",
        "search_query",
        F.lit(1).cast("bigint").alias("searches"),
        F.col("results_count").cast("bigint").alias("results"),
        F.when(F.col("results_count").isNotNull(), 1).otherwise(0).cast("bigint").alias("with_results"),
        F.lit(None).cast("bigint").alias("converted_order"),
    )

    # Reduced to what the distinct counts can tell apart, as each of them reads all rows once more.
    apart = ["user_id", "clicked_product_id", "converted_order"]
    counts = [F.sum(c).alias(c) for c in ("searches", "results", "with_results")]
    grouped = (
        followed.unionByName(other)
        .groupBy("search_query", F.hour("created_at").alias("search_hour"), *apart)
        .agg(*counts)
        .groupBy("search_query", "search_hour")
        .agg(
            F.sum("searches").alias("search_count"),
            F.count_distinct("user_id").alias("unique_searchers"),
            quotient(F.sum("results"), F.sum("with_results")).alias("avg_results_count"),
            F.count_distinct("clicked_product_id").alias("click_count"),
            F.count_distinct("converted_order").alias("post_click_conversions"),
        )
        .where(F.col("search_count") >= min_searches)
    )
    at = F.col("search_hour")
    report = grouped.select(
        "search_query",
        "search_count",
        "unique_searchers",
        "avg_results_count",
        "click_count",
        percent(F.col("click_count"), F.col("search_count")).alias("click_through_rate"),
        "post_click_conversions",
        F.length("search_query").alias("query_length"),
        "search_hour",
        F.when(at.between(6, 11), "MORNING")
        .when(at.between(12, 17), "AFTERNOON")
        .when(at.between(18, 23), "EVENING")
        .otherwise("NIGHT")
        .alias("time_of_day"),
    )
    return top_rows(
        report,
        top,
        F.col("search_count").desc_nulls_first(),
        F.col("click_through_rate").desc_nulls_first(),
        F.col("search_query"),
        F.col("search_hour"),
    )


def conversion_funnel(
    views: DataFrame,
    carts: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    *,
    as_of: Day,
    days: int = 7,
) -> DataFrame:
    """Users, products and first events per funnel step, with conversion rates.

    Only the first event per user, product and step counts, so the events are
    reduced to distinct triples. A later step does not require an earlier one.
    """
    start = midnight(as_of, days)
    recent = F.col("created_at") >= start
    ordered = (
        orders.where(recent & F.col("status").isin("PROCESSING", "DELIVERED"))
        .select(F.col("id").alias("order_id"), "user_id")
        .join(items.select("order_id", "product_id"), "order_id")
    )

    def step(df: DataFrame, position: int) -> DataFrame:
        return df.select(F.lit(position).alias("position"), "user_id", "product_id").distinct()

    reached = (
        step(views.where(recent), 1)
        .unionByName(step(carts.where(recent), 2))
        .unionByName(step(ordered, 3))
    )
    counts = reached.groupBy("position").agg(
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count(F.lit(1)).alias("total_events"),
    )
    # At most three rows from here on.
    in_order = Window.orderBy("position")
    everything = Window.orderBy("position").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    viewers = F.max(F.when(F.col("position") == 1, F.col("unique_users"))).over(everything)
    previous = F.col("previous_step_users")
    return (
        counts.withColumn("previous_step_users", F.lag("unique_users").over(in_order))
        .withColumn("viewers", viewers)
        .orderBy("position")
        .select(
            F.element_at(
                F.array(F.lit("VIEW"), F.lit("CART"), F.lit("ORDER")), F.col("position")
            ).alias("step"),
            "unique_users",
            "unique_products",
            "total_events",
            "previous_step_users",
            F.when(previous > 0, percent(F.col("unique_users"), previous)).alias(
                "conversion_rate_from_previous"
            ),
            percent(F.col("unique_users"), F.col("viewers")).alias("overall_conversion_rate"),
        )
    )
