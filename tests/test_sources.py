"""Schemas, table layouts, synthetic tables and plan shapes."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orderloom.functions import fixed
from orderloom.operators import lookup
from orderloom.plans import products, revenue
from orderloom.registry import analytics
from orderloom.session import shared_folder
from orderloom.sources import schemas, synthetic, tables
from orderloom.sources.canonical import CanonicalTables

SMALL = "/root/testdata/sf0.001"


def test_schemas():
    assert len(schemas.table_names()) == 22
    for table in schemas.table_names():
        assert "varchar" not in schemas.table_schema(table).simpleString()
    assert schemas.length_limits("users")["email"] == 255
    assert "price" in schemas.required_columns("products")
    assert ("shipment_tracking", "shipment_id") in [
        (t, r.column) for t, r in schemas.children_of("shipments")
    ]
    for table, declared in schemas.CONSTRAINTS.items():
        names = schemas.table_schema(table).fieldNames()
        used = [c for u in declared.unique for c in u] + [r.column for r in declared.references]
        assert set(used) | set(declared.defaults) <= set(names)


def test_literal_rows_and_json_defaults(spark, tmp_path):
    users = tables.literal_rows(
        spark, [("a@example.com", "secret", "Ann"), ("b@example.com", "secret", "Bob")], "users",
        ["email", "password", "name"],
    )
    assert users.columns == schemas.table_schema("users").fieldNames()
    assert users.where("status is null and email like 'a%'").count() == 1
    path = tmp_path / "orders.json"
    path.write_text('{"user_id": 1, "total_amount": 5.25}\n{"user_id": 2, "status": "PAID"}\n')
    read = tables.read_json_records(
        spark, str(path), schemas.table_schema("request_orders"), tables.order_defaults("2024-01-01 00:00:00")
    ).collect()
    assert [r.status for r in read] == ["PENDING", "PAID"]
    assert read[0].created_at.year == 2024 and str(read[0].total_amount) == "5.25"


def test_month_layout_prunes_partitions(spark, tmp_path):
    orders = CanonicalTables(spark, SMALL).v_orders
    tables.write_by_month(orders, str(tmp_path / "orders"), partitions=4)
    read = spark.read.parquet(str(tmp_path / "orders"))
    assert read.count() == orders.count()
    plan = read.where("year = 1998 and month = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    files = [f for _, _, names in os.walk(tmp_path / "orders") for f in names if f.endswith(".parquet")]
    months = read.select("year", "month").distinct().count()
    assert len(files) <= months + 4


def test_bucketed_join_has_no_shuffle(spark, tmp_path):
    t = CanonicalTables(spark, SMALL)
    tables.write_bucketed(t.v_orders, "b_orders", str(tmp_path / "o"), key="id", buckets=4)
    tables.write_bucketed(t.v_order_items, "b_items", str(tmp_path / "i"), key="order_id", buckets=4)
    try:
        joined = spark.table("b_orders").hint("merge").join(
            spark.table("b_items"), F.col("b_orders.id") == F.col("order_id")
        )
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == t.v_order_items.count()
    finally:
        spark.sql("drop table b_orders")
        spark.sql("drop table b_items")


def exchanges_below_join(plan, key):
    """The exchanges under the join on a key in the tree of a plan."""
    lines = [(max(line.rfind("+- "), line.rfind(":- ")), line) for line in plan.splitlines()]
    (at,) = (i for i, (_, line) in enumerate(lines) if re.search(rf"SortMergeJoin \[{key}#", line))
    below = []
    for depth, line in lines[at + 1 :]:
        if depth <= lines[at][0]:
            break
        below.append(line)
    assert sum("FileScan" in line for line in below) == 2
    return [line for line in below if "Exchange" in line]


@pytest.mark.parametrize("bucketed", [True, False])
def test_revenue_and_runway_join_bucketed_facts_without_shuffle(spark, bucketed):
    t = CanonicalTables(spark, SMALL)
    orders, items = analytics.facts_in_buckets(t) if bucketed else (t.v_orders, t.v_order_items)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for answer in (
            revenue.monthly_category_revenue(orders, items, t.v_products, t.v_categories, since="1998-01-01"),
            products.stock_runway(t.v_products, items, orders, as_of=analytics.ORDERS_AS_OF),
        ):
            plan = answer._jdf.queryExecution().executedPlan().toString()
            assert bool(exchanges_below_join(plan, "order_id")) != bucketed
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_bloom_filter_layout(spark, tmp_path):
    users = CanonicalTables(spark, SMALL).v_users
    tables.write_with_bloom_filter(users, str(tmp_path / "u"), ["email"])
    read = spark.read.parquet(str(tmp_path / "u"))
    assert lookup.user_by_email(read, "user7@example.com").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root)
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_synthetic_data_does_not_depend_on_partitions(spark, rows):
    few = synthetic.ids(spark, 300).coalesce(1)
    many = synthetic.ids(spark, 300).repartition(7)
    for build in (
        lambda ids: synthetic.users(ids),
        lambda ids: synthetic.orders(ids, 50, 40, today="2024-01-01"),
        lambda ids: synthetic.order_items(ids, 40),
        lambda ids: synthetic.search_logs(ids, 50, now="2024-01-01 00:00:00"),
    ):
        assert rows(build(few)) == rows(build(many))
    assert rows(synthetic.users(few)) != rows(synthetic.users(few, seed=7))


def test_synthetic_proportions(spark):
    data = synthetic.data_set(spark, now="2024-12-31 00:00:00", scale=0.2)
    assert data["categories"].count() == 48 and data["brands"].count() == 100
    users = {r.tier: r["count"] for r in data["users"].groupBy("tier").count().collect()}
    for tier, weight in zip(fixed.TIERS, fixed.TIER_WEIGHTS):
        assert users.get(tier, 0) / 2000 == pytest.approx(weight / 100, abs=0.04)
    orders = data["orders"].agg(
        F.avg(F.col("user_id").isNull().cast("int")).alias("guests"),
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
        F.count_distinct("order_number").alias("numbers"),
    ).first()
    assert orders.guests == pytest.approx(0.1, abs=0.01) and orders.numbers == 20_000
    assert (orders.first.year, orders.last.year) == (2023, 2024)
    views = data["product_views"].agg(
        F.avg(F.col("user_id").isNull().cast("int")).alias("anonymous"),
        F.sum((F.col("user_id").isNull() != F.col("session_id").isNotNull()).cast("int")).alias("wrong"),
    ).first()
    assert views.anonymous == pytest.approx(0.3, abs=0.01) and views.wrong == 0
    unbranded = data["products"].where("brand_id is null").count() / data["products"].count()
    assert unbranded == pytest.approx(0.3, abs=0.03)
    prices = data["products"].select(F.col("id").alias("product_id"), "price")
    references = data["order_items"].join(prices, "product_id")
    assert references.count() == data["order_items"].count()
    assert references.where("unit_price <> price").count() == 0


def test_few_products_still_give_distinct_lines(spark):
    for n in (1, 2, 3, 4, 5, 6):
        lines = synthetic.order_items(synthetic.ids(spark, 50), n)
        per_order = lines.groupBy("order_id").agg(
            F.count("product_id").alias("n"), F.count_distinct("product_id").alias("d"), F.max("product_id").alias("m")
        )
        assert per_order.where(f"n <> d or n > {min(5, n)} or m > {n}").count() == 0



def _plans(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Without small tables the planner shows what it would do for large ones.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in entry.queries().items():
            if re.match(r"[apmcwlg]\d", name):
                yield name, query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_cross_joins_and_no_python_in_batch_plans(spark):
    for name, plan in _plans(spark):
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
            assert node not in plan, f"{node} in {name}"


@pytest.mark.parametrize(
    "name,filters",
    [
        ("p01_find_by_key", "EqualTo(o_orderkey,17)"),
        ("p08_product_name_contains", "StringContains(p_name,widget)"),
        ("p11_recent_orders", "GreaterThanOrEqual(o_orderdate"),
        ("a11_top_customers_by_spend", "GreaterThanOrEqual(o_orderdate"),
        ("a10_conversion_funnel", "GreaterThanOrEqual(ts"),
    ],
)
def test_filters_reach_the_scan(spark, name, filters):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert filters in plan
