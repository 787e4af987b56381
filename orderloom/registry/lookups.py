"""Lookups and filters with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators import lookup
from orderloom.registry.core import Registry
from orderloom.sources.canonical import CanonicalTables
from orderloom.sources.tables import literal_rows

registry = Registry()
add = registry.add

add("p01_find_by_key", lambda t: lookup.by_key(t.v_orders, 17), "select * from v_orders where id = 17",
    doubles="total_amount")
add(
    "p01_find_by_keys",
    lambda t: lookup.by_keys(t.v_products, t.lineitem.where("l_quantity >= 50").select("l_partkey")),
    """select * from v_products
       where id in (select l_partkey from lineitem where l_quantity >= 50)""",
    doubles="price",
)
# A few keys given with the request, looked up in a table.
add(
    "s07_requested_orders",
    lambda t: lookup.by_keys(t.v_orders, literal_rows(t.spark, [(1,), (17,), (402,), (-1,)], "orders", ["id"]).select("id")),
    "select * from v_orders where id in (1, 17, 402, -1)",
    doubles="total_amount",
)
add("p02_find_all", lambda t: lookup.find_all(t.v_users), "select * from v_users")
add("p03_orders_of_user", lambda t: lookup.orders_of_user(t.v_orders, 42),
    "select * from v_orders where user_id = 42", doubles="total_amount")
add("p04_orders_with_status", lambda t: lookup.orders_with_status(t.v_orders, "CANCELLED"),
    "select * from v_orders where status = 'CANCELLED'", doubles="total_amount")
add("p05_user_by_email", lambda t: lookup.user_by_email(t.v_users, "user7@example.com"),
    "select * from v_users where email = 'user7@example.com'")
# Supplier keys stand for requested users; at small scale all of them exist, so half are moved away.
add(
    "p06_email_exists",
    lambda t: lookup.existing_emails(
        t.supplier.select(
            F.concat(
                F.lit("user"),
                (F.col("s_suppkey") * F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(-1)).cast("string"),
                F.lit("@example.com"),
            ).alias("email")
        ),
        t.v_users,
    ),
    """select r.email, exists (select 1 from v_users u where u.email = r.email) as "exists"
       from (select distinct concat('user', cast(case when s_suppkey % 2 = 0 then s_suppkey
                    else -s_suppkey end as varchar), '@example.com') as email from supplier) r""",
)
add("p07_products_in_category", lambda t: lookup.products_in_category(t.v_products, "ECONOMY"),
    "select * from v_products where category_id = 'ECONOMY'", doubles="price")
add("p08_product_name_contains", lambda t: lookup.products_named_like(t.v_products, "widget"),
    "select * from v_products where contains(name, 'widget')", doubles="price")
add("p09_email_any_case", lambda t: lookup.user_by_email_any_case(t.v_users, "USER7@Example.com"),
    "select * from v_users where lower(email) = 'user7@example.com'")
add("p10_active_users", lambda t: lookup.active_rows(t.v_users),
    "select * from v_users where status = 'ACTIVE'")
add("p11_recent_orders", lambda t: lookup.recent_orders(t.v_orders, as_of="2001-08-01"),
    "select * from v_orders where created_at >= timestamp '2001-02-01'", doubles="total_amount")
add("p12_high_rated_reviews", lambda t: lookup.high_rated_reviews(t.v_reviews),
    "select * from v_reviews where rating >= 4 and status = 'APPROVED'")


def _tagged(t):
    return t.v_products.select("id", F.split("name", " ").alias("tags"))


add(
    "p13_tag_membership",
    lambda t: lookup.with_member(_tagged(t), "tags", "ring").select("id"),
    "select id from v_products where list_contains(string_split(name, ' '), 'ring')",
)
add(
    "p13_tag_overlap",
    lambda t: lookup.with_any_member(_tagged(t), "tags", ["red", "bolt"]).select("id"),
    "select id from v_products where list_has_any(string_split(name, ' '), ['red', 'bolt'])",
)
add(
    "p14_newest_orders_per_user",
    lambda t: lookup.first_per_key(t.v_orders, ["user_id"], [F.col("created_at").desc(), F.col("id")], 3),
    """select *, cast(row_number() over (partition by user_id order by created_at desc, id) as int) as place
       from v_orders qualify place <= 3""",
    doubles="total_amount",
)
add(
    "p14_dearest_products_per_category",
    lambda t: lookup.first_per_key(
        t.v_products, ["category_id", "status"], [F.col("price").desc(), F.col("id")], 5
    ),
    """select *, cast(row_number() over (partition by category_id, status order by price desc, id)
                      as int) as place
       from v_products qualify place <= 5""",
    doubles="price",
)
add(
    "p14_views_clustered_by_product",
    lambda t: lookup.clustered_by(t.v_views, ["product_id"], [F.col("created_at").desc()]),
    "select * from v_views",
)


def _layout_of_views(t: CanonicalTables) -> DataFrame:
    """Rows of each product in the layout, rows of it that stand behind an older one, and whether others stand between."""
    laid = lookup.clustered_by(t.v_views, ["product_id"], [F.col("created_at").desc(), F.col("id")])
    placed = laid.select("product_id", "created_at", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    along = Window.partitionBy("product_id").orderBy("place")
    seen = placed.withColumn("late", F.lag("created_at").over(along) < F.col("created_at"))
    pieces = seen.groupBy("product_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), (F.max("place") - F.min("place") + 1).alias("span")
    )
    return pieces.groupBy("product_id").agg(
        F.sum("n").alias("views"), F.sum("late").alias("out_of_order"), F.sum(F.col("span") - F.col("n")).alias("strangers")
    )


add(
    "p14_layout_of_views",
    _layout_of_views,
    """select product_id, count(*) as views, cast(0 as bigint) as out_of_order, cast(0 as bigint) as strangers
       from v_views group by product_id""",
)
