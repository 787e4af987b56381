"""Product performance, affinity and stock runway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import Day, bounded, midnight, percent, quotient

# Products of row counts can pass 64 bits for a hot product.
_WIDE = "decimal(38,0)"


def _wide(name: str, at_least: int = 0):
    return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(at_least)).cast("decimal(18,0)")


def product_performance(
    products: DataFrame,
    categories: DataFrame,
    brands: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    views: DataFrame,
    *,
    min_orders: int = 10,
    top: int = 50,
) -> DataFrame:
    """Leading active products with their share of the category.

    Sales and review counts are those of the joined rows: each order line is
    counted once per approved review and per view of its product. Each side is
    reduced to one row per product and the counts are multiplied, so the joined
    rows are never built. Category totals are joined to the leaders only.
    """
    lines = (
        items.groupBy("product_id", "order_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
        .groupBy("product_id")
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum("n").alias("lines"),
            F.sum("q").alias("sold"),
        )
    )
    approved = (
        reviews.where(F.col("status") == "APPROVED")
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.count("rating").alias("rated"),
            F.sum("rating").alias("rating_sum"),
        )
    )
    seen = (
        views.groupBy("product_id", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("product_id")
        .agg(F.sum("n").alias("views"), F.count("user_id").alias("view_count"))
    )
    stats = (
        products.where(F.col("status") == "ACTIVE")
        .select(F.col("id").alias("product_id"), "name", "category_id", "brand_id", "price")
        .join(lines, "product_id", "left")
        .join(approved, "product_id", "left")
        .join(seen, "product_id", "left")
        .select(
            F.col("product_id").alias("id"),
            "name",
            "category_id",
            "brand_id",
            "price",
            F.coalesce("order_count", F.lit(0)).alias("order_count"),
            (F.col("sold").cast("decimal(18,0)") * _wide("reviews", 1) * _wide("views", 1))
            .cast(_WIDE)
            .alias("total_sold"),
            quotient(F.col("rating_sum"), F.col("rated")).alias("avg_rating"),
            (_wide("reviews") * _wide("lines", 1) * _wide("views", 1)).cast(_WIDE).alias("review_count"),
            F.coalesce("view_count", F.lit(0)).alias("view_count"),
        )
    )

    category_names = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    leaders = (
        stats.where(F.col("order_count") > min_orders)
        .join(category_names, "category_id")
        .orderBy(F.col("total_sold").desc_nulls_first(), F.col("avg_rating").desc_nulls_first(), "id")
        .limit(top)
    )
    totals = stats.groupBy("category_id").agg(
        F.count("id").alias("category_product_count"),
        F.sum("order_count").alias("category_orders"),
        F.sum("total_sold").alias("category_sold"),
    )
    brand_names = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name"))
    return (
        totals.join(bounded(leaders, top), "category_id")
        .join(brand_names, "brand_id", "left")
        .select(
            "id",
            "name",
            "category_id",
            "brand_id",
            "price",
            "order_count",
            "total_sold",
            "avg_rating",
            "review_count",
            "view_count",
            "category_name",
            "category_product_count",
            percent(F.col("order_count"), F.col("category_orders")).alias("category_order_share"),
            percent(F.col("total_sold"), F.col("category_sold")).alias("category_volume_share"),
            "brand_name",
            F.when(F.col("avg_rating") >= 4.5, "EXCELLENT")
            .when(F.col("avg_rating") >= 4.0, "GOOD")
            .when(F.col("avg_rating") >= 3.5, "AVERAGE")
            .otherwise("POOR")
            .alias("rating_category"),
        )
        .orderBy(F.col("total_sold").desc_nulls_first(), F.col("avg_rating").desc_nulls_first(), "id")
    )


def product_affinity(
    products: DataFrame,
    items: DataFrame,
    *,
    min_co: int = 10,
    top: int = 100,
    cell: int = 1_000,
) -> DataFrame:
    """Pairs of active products bought in at least ``min_co`` common orders.

    Pairs are built from baskets that were cut to active products found in at
    least ``min_co`` orders; no other product can be part of a result. A basket
    is cut into pieces of about ``cell`` products, and two of its pieces meet in
    a cell of their own, so that however large a basket is, a task pairs no more
    than the square of that under one key.
    """
    order_total = items.agg(F.count_distinct("order_id").alias("n")).select("n").scalar()
    held = (
        items.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
        .select("order_id", "product_id")
        .distinct()
    )
    active = products.where(F.col("status") == "ACTIVE").select(F.col("id").alias("product_id"), "name")
    frequent = (
        held.groupBy("product_id")
        .agg(F.count("order_id").alias("order_count"))
        .where(F.col("order_count") >= min_co)
        .join(active, "product_id")
    )
    # An inner join on a unique key: a semi join would be moved below the
    # distinct and keep both uses of it from sharing one shuffle.
    baskets = held.join(frequent.select("product_id"), "product_id").select("order_id", "product_id")
    pieces = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("order_id")) / F.lit(cell)).cast("int")
    cut = baskets.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("product_id"), "pieces").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "order_id", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "product_id"
    )
    left = met.withColumnsRenamed({"product_id": "product_a", "piece": "piece_a"})
    right = met.withColumnsRenamed({"product_id": "product_b", "piece": "piece_b"})
    pairs = left.join(right, ["order_id", "low", "high"]).where(
        (F.col("product_a") < F.col("product_b")) & ((F.col("low") == F.col("high")) | (F.col("piece_a") != F.col("piece_b")))
    )
    counted = pairs.groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("co_occurrence_count"))

    def side(which: str) -> DataFrame:
        return frequent.select(
            F.col("product_id").alias(f"product_{which}"),
            F.col("name").alias(f"product_{which}_name"),
            F.col("order_count").alias(f"product_{which}_orders"),
        )

    common, orders_a, orders_b = (
        F.col("co_occurrence_count"),
        F.col("product_a_orders"),
        F.col("product_b_orders"),
    )
    return (
        counted.where(common >= min_co)
        .join(side("a"), "product_a")
        .join(side("b"), "product_b")
        .select(
            "product_a",
            "product_a_name",
            "product_b",
            "product_b_name",
            "co_occurrence_count",
            "product_a_orders",
            "product_b_orders",
            quotient(common, orders_a + orders_b - common).alias("jaccard_similarity"),
            (quotient(common, orders_a) / quotient(orders_b, order_total)).alias("lift_score"),
        )
        .orderBy(
            F.col("jaccard_similarity").desc_nulls_first(),
            F.col("lift_score").desc_nulls_first(),
            "product_a",
            "product_b",
        )
        .limit(top)
    )


def stock_runway(
    products: DataFrame, items: DataFrame, orders: DataFrame, *, as_of: Day, days: int = 30
) -> DataFrame:
    """Days of stock left, restock priority and reorder quantity per active product.

    Daily averages are over days with sales. A product without recent sales has
    no runway and priority OK.
    """
    recent = orders.where(
        F.col("status").isin("DELIVERED", "PROCESSING") & (F.col("created_at") >= midnight(as_of, days))
    ).select(F.col("id").alias("order_id"), F.to_date("created_at").alias("sale_date"))
    sales = (
        items.select("order_id", "product_id", "quantity")
        .join(recent, "order_id")
        .groupBy("product_id", "sale_date")
        .agg(F.sum("quantity").alias("sold"))
        .groupBy("product_id")
        .agg(
            quotient(F.sum("sold"), F.count("sold")).alias("avg_daily_sales"),
            F.stddev_samp("sold").alias("sales_stddev"),
            F.max("sold").alias("max_daily_sales"),
        )
    )
    mean = F.col("avg_daily_sales")
    left = F.when(mean > 0, F.col("stock_quantity") / mean)
    reorder = F.when(
        mean > 0,
        F.greatest(
            mean * 30,
            F.col("max_daily_sales") * F.lit(7.0),
            mean * 1.5 + F.col("sales_stddev") * 2,
        ),
    )
    return (
        products.where(F.col("status") == "ACTIVE")
        .select(F.col("id").alias("product_id"), "name", "stock_quantity")
        .join(sales, "product_id", "left")
        .select(
            F.col("product_id").alias("id"),
            "name",
            "stock_quantity",
            "avg_daily_sales",
            "sales_stddev",
            "max_daily_sales",
            left.alias("days_of_stock_remaining"),
            F.when(left < 7, "URGENT")
            .when(left < 14, "SOON")
            .when(left < 30, "MONITOR")
            .otherwise("OK")
            .alias("restock_priority"),
            reorder.alias("suggested_reorder_quantity"),
        )
        .orderBy(F.col("days_of_stock_remaining").asc_nulls_last(), "id")
    )
