"""Edge cases of lookups, change sets, constraints, workload and request metrics."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.operators import changes, constraints, lookup, ordered, requests, workload

START = datetime(2024, 1, 1)
RELAXED = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_membership_and_newest(spark, rows):
    tagged = spark.createDataFrame(
        [(1, ["a", "b"]), (2, ["c"]), (3, None)], "id bigint, tags array<string>"
    )
    assert rows(lookup.with_member(tagged, "tags", "b"), "id") == [(1,)]
    assert rows(lookup.with_any_member(tagged, "tags", ["b", "c"]), "id") == [(1,), (2,)]
    seen = spark.createDataFrame([(1, k, k * i) for k in (1, 2) for i in range(5)], "u int, k int, at int")
    newest = lookup.first_per_key(seen, ["k"], [F.col("at").desc()], 2)
    assert rows(newest, "k", "at") == [(1, 3), (1, 4), (2, 6), (2, 8)]


SNAPSHOT = "id bigint, email string, name string, password string, created_at timestamp_ntz, updated_at timestamp_ntz"
CHANGE = "id bigint, email string, name string, password string, ts timestamp_ntz, seq bigint"


def test_user_update_keeps_password_and_rejects_unknown(spark):
    snapshot = spark.createDataFrame(
        [(1, "a@x", "A", "p1", START, START), (2, "b@x", "B", "p2", START, START)], SNAPSHOT
    )
    later = START + timedelta(days=1)
    change = spark.createDataFrame(
        [
            (1, "c@x", "C", "new", later, 1),
            (1, None, "D", None, later, 2),
            (3, "z@x", "Z", "pz", later, 3),
        ],
        CHANGE,
    )
    result = changes.update_users(snapshot, change)
    by_id = {r.id: r for r in result.snapshot.collect()}
    assert set(by_id) == {1, 2}
    assert (by_id[1].email, by_id[1].name, by_id[1].password) == (None, "D", "new")
    assert (by_id[1].updated_at, by_id[1].created_at) == (later, START)
    assert (by_id[2].password, by_id[2].updated_at) == ("p2", START)
    assert [r.id for r in result.rejects.collect()] == [3]


def test_upsert_writes_nulls_and_inserts(spark, rows):
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    change = spark.createDataFrame(
        [(1, "x", 1), (1, None, 2), (3, "c", 1)], "id bigint, v string, seq bigint"
    )
    assert rows(changes.upsert(snapshot, change).snapshot) == [(1, None), (2, "b"), (3, "c")]


def test_user_update_without_time_applies_as_a_whole(spark):
    snapshot = spark.createDataFrame([(1, "a@x", "A", "p1", START, START)], SNAPSHOT)
    change = spark.createDataFrame([(1, "c@x", "C", "new", None, None)], CHANGE)
    row = changes.update_users(snapshot, change).snapshot.first()
    assert (row.email, row.name, row.password, row.updated_at) == ("c@x", "C", "new", START)


def test_upsert_rejects_every_row_without_key(spark, rows):
    snapshot = spark.createDataFrame([(1, "a")], "id bigint, v string")
    change = spark.createDataFrame([(None, "x", 1), (None, "y", 2), (1, "z", 3)], "id bigint, v string, seq bigint")
    result = changes.upsert(snapshot, change)
    assert rows(result.snapshot) == [(1, "z")]
    assert rows(result.rejects, "v") == [("x",), ("y",)]


def test_equal_places_are_decided_by_the_row(spark, rows):
    change = spark.createDataFrame([(1, "b", 1), (1, "c", 1), (1, "a", 1)], "id bigint, v string, seq bigint")
    for parts in (1, 3):
        assert rows(changes.latest(change.repartition(parts), "id"), "v") == [("c",)]


def test_insert_draws_missing_ids(spark):
    snapshot = spark.createDataFrame([("k", "a")], "id string, v string")
    change = spark.createDataFrame(
        [(None, "x", 1), (None, "y", 2), ("k", "z", 3)], "id string, v string, seq bigint"
    )
    result = changes.insert_with_ids(snapshot, change).collect()
    assert sorted(r.v for r in result) == ["x", "y", "z"]
    assert all(r.id for r in result)


def test_stock_may_become_negative(spark, rows):
    snapshot = spark.createDataFrame([(1, 5), (2, 7)], "id bigint, stock int")
    deltas = spark.createDataFrame([(1, -4), (1, -4), (9, 1)], "id bigint, quantity int")
    result = changes.add_stock(snapshot, deltas)
    assert rows(result.snapshot) == [(1, -3), (2, 7)]
    assert rows(result.rejects) == [(9, 1)]
    assert result.snapshot.schema["stock"].dataType.simpleString() == "int"


def test_status_update(spark, rows):
    snapshot = spark.createDataFrame(
        [(1, "PENDING", START), (2, "PENDING", START)], "id bigint, status string, updated_at timestamp_ntz"
    )
    later = START + timedelta(hours=1)
    change = spark.createDataFrame(
        [(1, "SHIPPED", later, 2), (1, "PAID", later, 1)],
        "id bigint, status string, ts timestamp_ntz, seq bigint",
    )
    assert rows(changes.update_order_status(snapshot, change).snapshot) == [
        (1, "SHIPPED", later),
        (2, "PENDING", START),
    ]
    assert changes.status_events(snapshot, change).count() == 2
    assert rows(changes.delete_keys(snapshot, change), "id") == [(2,)]


def test_constraints(spark, rows):
    child = spark.createDataFrame(
        [(1, 10, "ab", 5), (2, None, "abcd", 6), (3, 99, None, None), (4, 10, "ab", 0)],
        "id bigint, parent_id bigint, name string, rating int",
    )
    parent = spark.createDataFrame([(10,), (11,)], "id bigint")
    assert rows(constraints.not_null(child, ["name", "rating"]), "key", "column") == [
        ("3", "name"),
        ("3", "rating"),
    ]
    assert rows(constraints.unique(child, ["parent_id"]), "key", "value") == [("10", "2")]
    assert rows(constraints.unique(child, ["parent_id", "name"]), "key") == [("10,ab",)]
    assert rows(constraints.in_range(child, "rating", 1, 5), "key") == [("2",), ("4",)]
    assert rows(constraints.foreign_key(child, "parent_id", parent), "key", "value") == [("3", "99")]
    assert rows(constraints.max_length(child, {"name": 3}), "key", "value") == [("2", "4")]
    assert rows(constraints.fill_defaults(child, {"rating": 1}), "id", "rating")[2] == (3, 1)
    gone = parent.where("id = 10")
    assert rows(constraints.delete_cascade(child, "parent_id", gone), "id") == [(2,), (3,)]
    assert rows(constraints.delete_set_null(child, "parent_id", gone), "id", "parent_id") == [
        (1, None),
        (2, None),
        (3, 99),
        (4, None),
    ]


def test_deletes_cascade_through_tables(spark, rows):
    tables = {
        "orders": spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_id bigint"),
        "order_items": spark.createDataFrame([(1, 1), (2, 2)], "id bigint, order_id bigint"),
        "users": spark.createDataFrame([(7,), (8,)], "id bigint"),
        "product_views": spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_id bigint"),
        "cart_items": spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_id bigint"),
    }
    gone = spark.createDataFrame([(7,)], "id bigint")
    blocked = constraints.delete_rows("users", gone, tables)
    assert rows(blocked.blocked) == [(7,)]  # an order refers to the user
    assert rows(blocked.tables["users"]) == [(7,), (8,)] and blocked.tables["cart_items"].count() == 2
    del tables["orders"]
    result, blocked = constraints.delete_rows("users", gone, tables)
    assert set(result) == {"users", "product_views", "cart_items"} and blocked.count() == 0
    assert rows(result["product_views"]) == [(1, None), (2, 8)]
    assert rows(result["cart_items"]) == [(2, 8)]
    tables["orders"] = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, user_id bigint")
    orders = constraints.delete_rows("orders", gone.selectExpr("1L as id"), tables)
    assert rows(orders.tables["order_items"]) == [(2, 2)]


def test_restricted_rows_block_through_cascades(spark, rows):
    tables = {
        "users": spark.createDataFrame([(7,), (8,), (9,)], "id bigint"),
        "user_addresses": spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id bigint, user_id bigint"),
        "orders": spark.createDataFrame(
            [(1, None, 1, None), (2, None, None, None)],
            "id bigint, user_id bigint, shipping_address_id bigint, billing_address_id bigint",
        ),
    }
    result = constraints.delete_rows("users", spark.createDataFrame([(7,), (8,), (None,)], "id bigint"), tables)
    assert rows(result.blocked) == [(7,)]
    assert rows(result.tables["users"]) == [(7,), (9,)]
    assert rows(result.tables["user_addresses"]) == [(1, 7), (3, 9)]


def test_time_defaults_are_declared(spark):
    from orderloom.sources.schemas import declared_defaults

    assert declared_defaults("users", "now") == {
        "status": "ACTIVE", "tier": "BRONZE", "registration_date": "now", "created_at": "now", "updated_at": "now",
    }
    assert declared_defaults("shipment_tracking", "now") == {"timestamp": "now"}


def test_declared_constraints_of_a_table(spark, rows):
    reviews = spark.createDataFrame(
        [(1, 1, 1, 5, "ok"), (2, 1, 2, 9, "x" * 300), (2, 5, 2, 3, None)],
        "id bigint, product_id bigint, user_id bigint, rating int, title string",
    )
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    found = constraints.table_violations(
        "product_reviews", {"product_reviews": reviews, "products": parents, "users": parents}
    )
    assert rows(found, "rule", "key", "column") == [
        ("check_range", "2", "rating"),
        ("foreign_key", "2", "product_id"),
        ("max_length", "2", "title"),
        ("unique", "2", "id"),
    ]


def test_first_number_is_masked(spark):
    log = spark.createDataFrame(
        [(1, "select 12 from t34", 5, 1.0, 5.0), (2, "select 9 from t34", 5, 3.0, 15.0), (3, "\nx\n7 8", 5, 1.0, 5.0)],
        "query_id bigint, query string, calls bigint, mean_time double, total_time double",
    )
    result = workload.query_patterns(log, min_calls=1).collect()
    assert [(r.query_pattern, r.pattern_count, r.avg_pattern_time) for r in result] == [
        ("select N from t34", 2, 2.0),
        ("\nx\nN 8", 1, 1.0),
    ]


def test_regressions_with_zero_baseline(spark):
    log = spark.createDataFrame(
        [(1, "a", 5, 4.0, 20.0), (2, "b", 5, 1.5, 7.5), (3, "c", 5, 1.0, 5.0), (4, "d", 5, 1.0, 5.0)],
        "query_id bigint, query string, calls bigint, mean_time double, total_time double",
    )
    base = spark.createDataFrame(
        [(1, 2.0), (2, 1.0), (3, 0.0), (4, None)], "query_id bigint, baseline_mean_time double"
    )
    result = {r.queryid: r.performance_change_percent for r in workload.regressions(log, base).collect()}
    assert result == {1: 100.0, 3: None}


def test_impact_priorities(spark):
    log = spark.createDataFrame(
        [(1, "a", 1001, 101.0, 1.0), (2, "b", 501, 51.0, 1.0), (3, "c", 101, 11.0, 1.0), (4, "d", 1001, 10.0, 1.0)],
        "query_id bigint, query string, calls bigint, mean_time double, total_time double",
    )
    result = {r.queryid: r.optimization_priority for r in workload.impact_ranking(log).collect()}
    assert result == {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM", 4: "LOW"}


def test_safe_ratio(spark):
    counters = spark.createDataFrame([(0, 0), (3, 1)], "h bigint, m bigint")
    assert [r.ratio for r in workload.safe_ratio(counters, "h", "m").collect()] == [0.0, 75.0]
    assert workload.safe_ratio(counters, "h", "m", empty=100).first().ratio == 100.0


@RELAXED
@given(values=st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 9)), min_size=3, max_size=40))
def test_rank_correlation_equals_pandas(spark, values):
    import pandas as pd

    frame = pd.DataFrame(values, columns=["v", "o"])
    expected = frame["v"].rank().corr(frame["o"].rank())
    df = spark.createDataFrame(values, "v int, o int")
    found = workload.order_correlation(df, "v", "o").first()[0]
    assert (found is None and pd.isna(expected)) or found == pytest.approx(expected)


def test_ranks_of_texts_with_a_shared_start(spark):
    words = ["id-000", "id-001", "id-0010", "id-", "id-é", "id-zz", "id-zz"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = {r.w: r["rank"] for r in ordered.value_rank(df, "w", slots=4).collect()}
    assert found == {"id-": 1, "id-000": 2, "id-001": 3, "id-0010": 4, "id-zz": 5.5, "id-é": 7}


def exclusive(values):
    return statistics.quantiles(values, n=20)[18]


@pytest.mark.parametrize("count", [2, 19, 20, 21, 59, 500, 3001])
@pytest.mark.parametrize("accuracy", [20, 100, 50_000])
def test_exclusive_quantile_is_exact(spark, count, accuracy):
    random.seed(count)
    values = [round(random.expovariate(0.01), random.choice([0, 3])) for _ in range(count)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    found = ordered.exclusive_quantile(df, "v", accuracy=accuracy).first()[0]
    assert found == pytest.approx(exclusive(values), rel=1e-12)


def test_exclusive_quantile_per_group_with_null_group_and_ties(spark):
    random.seed(5)
    values = [(g, float(random.choice([1, 2, 2, 2, 50, random.random()]))) for g in ("a", "b", None) for _ in range(400)]
    df = spark.createDataFrame(values, "g string, v double")
    found = {r.g: r["quantile"] for r in ordered.exclusive_quantile(df, "v", ["g"], accuracy=50).collect()}
    expected = {g: exclusive([v for k, v in values if k == g]) for g in ("a", "b", None)}
    assert found == pytest.approx(expected)


LOG = "request_id bigint, ts timestamp_ntz, service string, status string, latency_ms double"


def test_p95_needs_more_than_twenty_samples(spark):
    def log(n):
        rows = [(i, START + timedelta(seconds=i), "s", "success", float(i * i)) for i in range(n)]
        return requests.latency_summary(spark.createDataFrame(rows, LOG)).first()

    assert log(20).p95_latency == pytest.approx(statistics.mean(i * i for i in range(20)))
    assert log(21).p95_latency == pytest.approx(exclusive([i * i for i in range(21)]))
    assert log(1).rps is None


def test_outcomes_and_endpoints(spark):
    bodies = spark.createDataFrame(
        [
            (False, '{"status": "fallback"}', "/api/products/1"),
            (False, '{"status": "ok"}', "/users/products"),
            (False, "", "/api/users"),
            (False, None, "/x"),
            (False, "[1]", "/x"),
            (False, "{broken", "/x"),
            (True, "{}", "/x"),
        ],
        "failed boolean, body string, path string",
    )
    found = bodies.select(
        requests.outcome(F.col("failed"), F.col("body")).alias("o"), requests.base_endpoint(F.col("path")).alias("e")
    ).collect()
    assert [r.o for r in found] == ["fallback", "success", "success", "success", "success", "failed", "failed"]
    assert [r.e for r in found][:4] == ["/api/products", "/api/products", "/api/users", "/api/orders"]


@RELAXED
@given(
    calls=st.lists(st.tuples(st.sampled_from("ab"), st.booleans(), st.integers(0, 200)), max_size=60),
    block=st.integers(3, 9),
)
def test_rolling_failure_rate_equals_brute_force(spark, calls, block):
    rows = [
        (i, START + timedelta(seconds=20 * t), s, "failed" if bad else "success", 1.0)
        for i, (s, bad, t) in enumerate(calls)
    ]
    expected = {}
    for service in "ab":
        own = sorted((r[1], r[0], r[3] == "failed") for r in rows if r[2] == service)
        for i in range(2, len(own)):
            expected[own[i][1]] = sum(bad for *_, bad in own[i - 2 : i + 1]) * 100 / 3
    df = spark.createDataFrame(rows, LOG)
    found = requests.rolling_failure_rate(df, window=3, block=block).collect()
    assert {r.request_id: r.failure_rate for r in found} == pytest.approx(expected)
    assert all(r.breached == (r.failure_rate >= 50) for r in found)


def test_dependencies_and_progress(spark, rows):
    spans = spark.createDataFrame(
        [(1, None, "gateway"), (2, 1, "user"), (3, 1, "user"), (4, 2, "db"), (5, 99, "lost")],
        "span_id bigint, parent_span_id bigint, service string",
    )
    assert rows(requests.service_dependencies(spans)) == [("gateway", "user", 2), ("user", "db", 1)]
    log = spark.createDataFrame(
        [(i, START + timedelta(minutes=i), "s", "failed" if i % 2 else "success", 1.0) for i in range(7)], LOG
    )
    steps = requests.progress_series(log, every=3).collect()
    assert [(r.completed, r.success, r.failed) for r in steps] == [(3, 2, 1), (6, 3, 3), (7, 4, 3)]
    assert steps[1].speed == pytest.approx(6 / 300)


@pytest.mark.parametrize("slot_rows", [1, 1_000_000])
def test_running_totals_with_null_groups_and_slots(spark, slot_rows):
    data = [("a", 1, 1), ("a", 5, 2), ("a", None, 4), (None, 2, 8), (None, 9, 16)]
    df = spark.createDataFrame(data, "g string, t int, v int")
    result = ordered.running_totals(
        df, ["g"], F.floor(F.col("t") / 3), ["t"], {"total": F.col("v")}, slot_rows=slot_rows
    )
    assert {(r.g, r.t): r.total for r in result.collect()} == {
        ("a", None): 4,
        ("a", 1): 5,
        ("a", 5): 7,
        (None, 2): 8,
        (None, 9): 24,
    }


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slot_rows", [1, 7, 40, 1_000_000])
def test_running_totals_cut_hot_slots(spark, descending, slot_rows):
    """Most rows share a slot, and many of them an instant as well."""
    random.seed(slot_rows)
    data = [
        (random.choice("aab"), random.choice([7, 7, 7, random.randint(0, 30)]), i, random.randint(-5, 5))
        for i in range(9_000)
    ]
    df = spark.createDataFrame(data, "g string, t int, id int, v int").repartition(7)
    slot = F.floor(F.col("t") / 10)
    result = ordered.running_totals(
        df,
        ["g"],
        -slot if descending else slot,
        ["t", "id"],
        {"total": F.col("v")},
        minima={"lowest": F.when(F.col("id") % 7 == 0, F.col("v"))},
        descending=descending,
        slot_rows=slot_rows,
    )
    expected = {}
    for g in "ab":
        total, lowest = 0, None
        for _, t, i, v in sorted((d for d in data if d[0] == g), key=lambda d: d[1:3], reverse=descending):
            total += v
            if i % 7 == 0:
                lowest = v if lowest is None else min(lowest, v)
            expected[i] = (total, lowest)
    assert {r.id: (r.total, r.lowest) for r in result.collect()} == expected


def test_hot_slots_are_spread(spark):
    """A slot with all rows is cut into many keys of about equal size."""
    df = spark.range(50_000).select(F.lit(1).alias("t"), F.col("id"))
    result = ordered.running_totals(df, [], F.col("t"), ["t", "id"], {"n": F.lit(1)})
    assert result.where("n <> id + 1").count() == 0
    plan = result._jdf.queryExecution().analyzed().toString()
    assert "_fine" in plan


@pytest.mark.parametrize("rows", [4_000, 40_000])
def test_pieces_of_a_slot_do_not_grow_with_it(spark, rows):
    """The largest window group stays near the bound when the one hot slot grows tenfold."""
    from orderloom.operators import ordered

    df = spark.range(rows).select("id", F.lit(0).alias("slot"))
    coarse = df.select(F.struct(F.lit(0).alias("_slot")).alias("_coarse"), F.struct("id").alias("_place"))
    hot = spark.range(1).select(
        F.struct(F.lit(0).alias("_slot")).alias("_coarse"), F.lit(rows).alias("_n"), F.lit(500.0).alias("_piece")
    )
    pieces = coarse.join(ordered._cuts(coarse, hot), "_coarse").groupBy(ordered._place_among(F.col("_place"))).count()
    assert pieces.agg(F.max("count")).first()[0] <= 2_000


def test_running_totals_split_by_size_of_group(spark, rows):
    """Small groups in one window and large ones by slots give the same, and small ones alone need no slots."""
    data = [(g, i, i % 3) for g, n in ((None, 3), ("a", 5), ("b", 40), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, t long, v long").repartition(4)
    want = []
    for g in (None, "a", "b", "c"):
        total = 0
        for _, t, v in sorted(r for r in data if r[0] == g):
            total += v
            want.append((g, t, v, total))
    for slot_rows in (1, 10, 60, 1000):
        got = ordered.running_totals(df, ["g"], F.floor(F.col("t") / 4), ["t"], {"total": F.col("v")}, slot_rows=slot_rows)
        assert rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_ordered_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("id % 7 as g", "id as t").mapInArrow(count, "g long, t long")
    ordered.running_totals(df, ["g"], F.col("t"), ["t"], {"n": F.lit(1)}, slot_rows=3).collect()
    assert seen.value == 100
