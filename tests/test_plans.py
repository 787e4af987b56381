"""Edge cases of the analytical plans on small tables."""

from datetime import datetime
from decimal import Decimal
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderloom.plans import customers, journeys, products, revenue


def ts(day, hour=0, minute=0):
    return datetime.fromisoformat(f"{day}T{hour:02d}:{minute:02d}:00")


USERS = "id bigint, name string, email string, tier string, status string, registration_date timestamp_ntz"
ORDERS = "id bigint, user_id bigint, status string, total_amount decimal(12,2), created_at timestamp_ntz"
ITEMS = "id bigint, order_id bigint, product_id bigint, quantity int, total_price decimal(12,2)"
PRODUCTS = (
    "id bigint, name string, category_id bigint, brand_id bigint, price decimal(10,2), "
    "stock_quantity int, status string"
)
NAMED = "id bigint, name string"


def user(i, status="ACTIVE", registered="2023-01-10", name=None):
    return (i, name or f"u{i}", f"u{i}@example.com", "GOLD", status, ts(registered))


def order(i, user_id, amount=100, day="2024-01-01", status="DELIVERED", hour=0):
    return (i, user_id, status, Decimal(amount), ts(day, hour))


def product(i, category=1, stock=10, status="ACTIVE"):
    return (i, f"p{i}", category, None, Decimal(5), stock, status)


def line(i, order_id, product_id, quantity=1):
    return (i, order_id, product_id, quantity, Decimal(5))


def test_customer_stats_weights_by_line(spark):
    users = spark.createDataFrame([user(1), user(2), user(3), user(4, status="INACTIVE")], USERS)
    orders = spark.createDataFrame(
        [
            order(1, 1, 100),
            order(2, 1, 10, status="CANCELLED"),
            order(3, 2, 7),
            order(4, None, 999),
            order(5, 4, 50),
        ],
        ORDERS,
    )
    items = spark.createDataFrame([line(1, 1, 1), line(2, 1, 2), line(3, 1, 2), line(4, 3, 9)], ITEMS)
    result = {r.id: r for r in customers.customer_stats(users, orders, items, since="2023-01-01").collect()}
    assert set(result) == {1, 2}
    first = result[1]
    # Three lines of 100 and one order of 10 without lines.
    assert (first.total_orders, first.total_spent, first.avg_order_value) == (2, Decimal(310), 310 / 4)
    assert (first.unique_products_purchased, first.delivered_orders, first.cancelled_orders) == (2, 3, 1)
    assert customers.customer_stats(users, orders, items, since="2023-06-01").count() == 0


def test_customer_stats_ties_at_the_limit_go_by_id(spark):
    users = spark.createDataFrame([user(i) for i in range(1, 6)], USERS)
    orders = spark.createDataFrame([order(i, i, 100) for i in range(1, 6)], ORDERS)
    items = spark.createDataFrame([], ITEMS)
    result = customers.customer_stats(users, orders, items, since="2023-01-01", top=3)
    assert [r.id for r in result.collect()] == [1, 2, 3]


def test_rfm_segments(spark):
    users = spark.createDataFrame([user(i) for i in range(1, 8)], USERS)
    recent = "2024-01-20"
    placed = (
        [order(100 + i, 1, 200_000, recent) for i in range(10)]
        + [order(200 + i, 2, 150_000, "2023-10-01") for i in range(5)]
        + [order(300, 3, 1, "2023-12-30"), order(301, 3, 1, recent)]
        + [order(400, 4, 1, recent)]
        + [order(500, 5, 1, "2023-01-01")]
        + [order(600, 6, 1, "2023-10-10")]
    )
    orders = spark.createDataFrame(placed, ORDERS)
    items = spark.createDataFrame(
        [line(1, 300, 1), line(2, 300, 2), line(3, 301, 3), line(4, 400, 3), line(5, 400, 3)], ITEMS
    )
    catalogue = spark.createDataFrame([product(1, 1), product(2, 2), product(3, 3)], PRODUCTS)
    categories = spark.createDataFrame([(1, "toys"), (2, "books"), (3, "tools")], NAMED)
    result = customers.rfm_segments(users, orders, items, catalogue, categories, as_of="2024-01-31").collect()
    by_id = {r.id: r for r in result}
    assert {i: r.customer_segment for i, r in by_id.items()} == {
        1: "VIP_CHAMPION",
        2: "LOYAL_CUSTOMER",
        3: "POTENTIAL_LOYALIST",
        4: "NEW_CUSTOMER",
        5: "AT_RISK",
        6: "REGULAR_CUSTOMER",
        7: "NON_CUSTOMER",
    }
    # Three categories tie for user 3: the first name wins.
    assert by_id[3].favorite_category == "books"
    assert by_id[4].favorite_category == "tools"
    assert by_id[3].avg_purchase_cycle_days == 21 and by_id[4].avg_purchase_cycle_days is None
    nobody = by_id[7]
    assert (nobody.frequency, nobody.monetary, nobody.recency_days) == (0, None, None)
    assert result[0].id == 7  # nothing spent sorts first


def test_top_customers_merge_namesakes(spark):
    users = spark.createDataFrame(
        [user(1, name="kim"), user(2, name="kim"), user(3, name="lee"), user(4, "INACTIVE")], USERS
    )
    orders = spark.createDataFrame(
        [order(1, 1, 10), order(2, 2, 20), order(3, 3, 25), order(4, 4, 99), order(5, 3, 500, "2022-01-01")],
        ORDERS,
    )
    spend = customers.top_customers_by_spend(users, orders, since="2024-01-01").collect()
    assert [(r.name, r.order_count, r.total_spent) for r in spend] == [
        ("kim", 2, Decimal(30)),
        ("lee", 1, Decimal(25)),
    ]
    assert customers.top_customers_by_orders(users, orders, since="2024-01-01", top=1).first().name == "kim"


def test_product_performance_counts_joined_rows(spark):
    catalogue = spark.createDataFrame([product(1), product(2), product(3, status="INACTIVE")], PRODUCTS)
    items = spark.createDataFrame(
        [line(1, 1, 1, 2), line(2, 2, 1, 3), line(3, 1, 2, 1), line(4, 1, 3, 9)], ITEMS
    )
    reviews = spark.createDataFrame(
        [(1, 1, 5, "APPROVED"), (2, 1, 4, "APPROVED"), (3, 1, 1, "PENDING")],
        "id bigint, product_id bigint, rating int, status string",
    )
    views = spark.createDataFrame(
        [(1, 1, 7), (2, 1, 7), (3, 1, None)], "id bigint, product_id bigint, user_id bigint"
    )
    categories = spark.createDataFrame([(1, "toys")], NAMED)
    brands = spark.createDataFrame([], NAMED)
    result = products.product_performance(
        catalogue, categories, brands, items, reviews, views, min_orders=0
    ).collect()
    first, second = result
    assert first.id == 1 and first.order_count == 2
    # 5 sold x 2 reviews x 3 views; 2 reviews x 2 lines x 3 views.
    assert (first.total_sold, first.review_count, first.view_count) == (30, 12, 1)
    assert (first.avg_rating, first.rating_category) == (4.5, "EXCELLENT")
    assert (second.avg_rating, second.rating_category, second.review_count) == (None, "POOR", 0)
    assert first.category_product_count == 2
    assert first.category_volume_share == pytest.approx(100 * 30 / 31)
    assert first.brand_name is None


def brute_affinity(lines, active, min_co):
    baskets = {}
    for _, o, p, *_ in lines:
        baskets.setdefault(o, set()).add(p)
    together = {}
    for basket in baskets.values():
        for pair in combinations(sorted(basket), 2):
            together[pair] = together.get(pair, 0) + 1
    return sorted((a, b, n) for (a, b), n in together.items() if n >= min_co and {a, b} <= active)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    lines=st.lists(st.tuples(st.integers(1, 8), st.integers(1, 12)), min_size=1, max_size=80),
    min_co=st.integers(1, 4),
    cell=st.integers(1, 6),
)
def test_product_affinity_equals_brute_force(spark, lines, min_co, cell):
    rows = [line(i, o, p) for i, (o, p) in enumerate(lines)]
    catalogue = spark.createDataFrame(
        [product(i, status="INACTIVE" if i % 5 == 0 else "ACTIVE") for i in range(1, 13)], PRODUCTS
    )
    items = spark.createDataFrame(rows, ITEMS)
    result = products.product_affinity(catalogue, items, min_co=min_co, top=1000, cell=cell)
    found = sorted((r.product_a, r.product_b, r.co_occurrence_count) for r in result.collect())
    assert found == brute_affinity(rows, {i for i in range(1, 13) if i % 5}, min_co)


def test_stock_runway(spark):
    catalogue = spark.createDataFrame(
        [product(1, stock=12), product(2, stock=100), product(3), product(4, status="INACTIVE")], PRODUCTS
    )
    orders = spark.createDataFrame(
        [
            order(1, 1, day="2024-01-10"),
            order(2, 1, day="2024-01-12"),
            order(3, 1, day="2024-01-12", status="CANCELLED"),
            order(4, 1, day="2023-11-01"),
        ],
        ORDERS,
    )
    items = spark.createDataFrame(
        [line(1, 1, 1, 2), line(2, 2, 1, 4), line(3, 3, 1, 50), line(4, 4, 3, 5), line(5, 1, 2, 5)], ITEMS
    )
    result = products.stock_runway(catalogue, items, orders, as_of="2024-01-31").collect()
    assert [r.id for r in result] == [1, 2, 3]
    urgent, single, unsold = result
    assert (urgent.avg_daily_sales, urgent.days_of_stock_remaining, urgent.restock_priority) == (3, 4, "URGENT")
    assert urgent.sales_stddev == pytest.approx(2**0.5)
    assert urgent.suggested_reorder_quantity == 90
    # One day with sales has no deviation; the reorder quantity goes without it.
    assert single.sales_stddev is None and single.suggested_reorder_quantity == 150
    assert (unsold.days_of_stock_remaining, unsold.restock_priority) == (None, "OK")


def test_monthly_category_revenue(spark):
    catalogue = spark.createDataFrame([product(1, 1), product(2, 2)], PRODUCTS)
    categories = spark.createDataFrame([(1, "toys"), (2, "books")], NAMED)
    orders = spark.createDataFrame(
        [
            order(1, 1, 100, "2024-01-05"),
            order(2, 1, 50, "2024-02-05"),
            order(3, 1, 10, "2024-02-20", status="CANCELLED"),
            order(4, 1, 70, "2024-02-28", status="PROCESSING"),
        ],
        ORDERS,
    )
    items = spark.createDataFrame(
        [line(1, 1, 1), line(2, 1, 1), line(3, 2, 1), line(4, 3, 1), line(5, 4, 2)], ITEMS
    )
    result = revenue.monthly_category_revenue(orders, items, catalogue, categories, since="2024-01-01")
    found = {(r.month.month, r.category_name): r for r in result.collect()}
    assert set(found) == {(1, "toys"), (2, "toys"), (2, "books")}
    january, february, books = found[1, "toys"], found[2, "toys"], found[2, "books"]
    assert (january.order_count, january.total_revenue, january.revenue_growth_rate) == (2, 200, None)
    assert (february.previous_month_revenue, february.revenue_change) == (200, -150)
    assert february.revenue_growth_rate == -75
    assert (books.cumulative_revenue, february.cumulative_revenue) == (70, 120)


def test_experiment_summary_without_orders(spark):
    users = spark.createDataFrame([user(1), user(2), user(4), user(6, "INACTIVE")], USERS)
    orders = spark.createDataFrame([order(1, 2, 10), order(2, 2, 30), order(3, 4, 5, "2022-05-05")], ORDERS)
    control, test = revenue.experiment_summary(users, orders, since="2023-01-01").collect()
    assert (control.user_count, control.conversion_count, control.conversion_rate) == (2, 2, 100)
    assert (control.avg_revenue_per_user, control.avg_revenue_per_paying_user) == (20, 20)
    assert (test.user_count, test.conversion_count, test.total_revenue) == (1, 0, None)


def test_cohort_before_registration(spark):
    users = spark.createDataFrame([user(1), user(2), user(3, "INACTIVE"), user(4)], USERS)
    orders = spark.createDataFrame(
        [
            order(1, 1, day="2022-12-31"),
            order(2, 1, day="2023-01-31"),
            order(3, 1, day="2023-01-15"),
            order(4, 2, day="2023-01-02"),
            order(5, 3, day="2023-01-02"),
            order(6, None, day="2023-01-02"),
        ],
        ORDERS,
    )
    result = revenue.cohort_retention(users, orders).collect()
    assert [(r.month_number, r.active_users, r.cohort_size) for r in result] == [(-1, 1, 1), (0, 2, 1)]
    assert (result[1].retention_rate, result[1].month_over_month_retention) == (200, 200)


SEARCHES = (
    "id bigint, user_id bigint, search_query string, results_count int, clicked_product_id bigint, "
    "created_at timestamp_ntz"
)


def test_search_conversions_only_after_the_search(spark):
    at = ts("2024-01-20", 10, 30)
    searches = spark.createDataFrame(
        [
            (1, 1, "bag", 3, 5, at),
            (2, 2, "bag", 4, 5, at),
            (3, 3, "bag", 5, 5, at),
            (4, None, "bag", 6, 5, at),
            (5, 4, "bag", 7, None, at),
        ],
        SEARCHES,
    )
    orders = spark.createDataFrame(
        [
            (9, 1, ts("2024-01-20", 10, 31)),
            (8, 1, ts("2024-01-25", 0, 0)),
            (7, 2, at),
            (6, 3, ts("2024-01-20", 10, 29)),
            (5, 4, ts("2024-01-21")),
        ],
        "id bigint, user_id bigint, created_at timestamp_ntz",
    )
    items = spark.createDataFrame([(i, 5) for i in range(5, 10)], "order_id bigint, product_id bigint")
    row = journeys.search_effectiveness(
        searches, orders, items, as_of="2024-01-31", min_searches=1
    ).collect()
    assert len(row) == 1
    assert (row[0].search_count, row[0].unique_searchers, row[0].click_count) == (5, 4, 1)
    assert row[0].post_click_conversions == 1
    assert (row[0].time_of_day, row[0].query_length, row[0].avg_results_count) == ("MORNING", 3, 5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    searches=st.lists(st.tuples(st.integers(1, 2), st.integers(0, 300)), min_size=1, max_size=30),
    bought=st.lists(st.tuples(st.integers(1, 2), st.integers(0, 300)), max_size=30),
)
def test_search_conversions_equal_brute_force(spark, searches, bought):
    def at(minutes):
        return ts("2024-01-20", minutes // 60, minutes % 60)

    searched = spark.createDataFrame(
        [(i, u, f"q{i % 3}", 1, 5, at(m)) for i, (u, m) in enumerate(searches)], SEARCHES
    )
    # Order ids fall with time, so that the lowest later one is far away.
    ranked = sorted(bought, key=lambda b: -b[1])
    orders = spark.createDataFrame(
        [(i, u, at(m)) for i, (u, m) in enumerate(ranked)], "id bigint, user_id bigint, created_at timestamp_ntz"
    )
    items = spark.createDataFrame([(i, 5) for i in range(len(ranked))], "order_id bigint, product_id bigint")
    expected = {}
    for i, (u, m) in enumerate(searches):
        later = [o for o, (bu, bm) in enumerate(ranked) if bu == u and bm > m]
        expected.setdefault((f"q{i % 3}", m // 60), set()).update([min(later)] if later else [])
    result = journeys.search_effectiveness(
        searched, orders, items, as_of="2024-01-31", min_searches=1, top=None
    ).collect()
    assert {(r.search_query, r.search_hour): r.post_click_conversions for r in result} == {
        k: len(v) for k, v in expected.items()
    }


def test_funnel_with_missing_step(spark):
    event = "id bigint, user_id bigint, product_id bigint, created_at timestamp_ntz"
    day = ts("2024-01-30")
    views = spark.createDataFrame(
        [(1, 1, 1, day), (2, 1, 1, day), (3, 2, 1, day), (4, None, 1, day), (5, 9, 9, ts("2023-01-01"))], event
    )
    carts = spark.createDataFrame([], event)
    orders = spark.createDataFrame([order(1, 1, day="2024-01-30"), order(2, 2, day="2024-01-30", status="PENDING")], ORDERS)
    items = spark.createDataFrame([line(1, 1, 1), line(2, 2, 1)], ITEMS)
    view, ordered = journeys.conversion_funnel(views, carts, orders, items, as_of="2024-01-31").collect()
    assert (view.step, view.unique_users, view.total_events, view.previous_step_users) == ("VIEW", 2, 3, None)
    assert (ordered.step, ordered.previous_step_users) == ("ORDER", 2)
    assert (ordered.conversion_rate_from_previous, ordered.overall_conversion_rate) == (50, 50)
    only_orders = journeys.conversion_funnel(carts, carts, orders, items, as_of="2024-01-31").collect()
    assert only_orders[0].overall_conversion_rate is None
