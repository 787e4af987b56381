"""Stored snapshots, counts, sketches, bitmaps and stream state: what they read and write, and their edges."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderloom.operators import bucketed, changes, constraints, delta_checks, rollups
from orderloom.plans import revenue
from orderloom.streaming import history

START = datetime(2024, 1, 1)


def files(folder):
    return {
        os.path.join(root, name)
        for root, _, names in os.walk(folder)
        for name in names
        if name.endswith(".parquet")
    }


def test_only_touched_buckets_are_written_again(spark, rows, tmp_path):
    folder = str(tmp_path / "stock")
    snapshot = spark.range(200).select("id", F.lit(5).alias("stock"))
    bucketed.write_buckets(snapshot, folder, buckets=16)
    before = files(folder)
    deltas = spark.createDataFrame([(3, 2), (3, 4), (None, 1), (900, 1)], "id bigint, quantity bigint")
    rejects = bucketed.apply_to_buckets(spark, folder, snapshot.schema, deltas, changes.add_stock, buckets=16)
    kept = before & files(folder)
    touched = {
        r[0] for r in spark.createDataFrame([(3,), (900,)], "id bigint").select(bucketed._bucket("id", 16)).collect()
    }
    assert kept and {path for path in before if not any(f"bucket={b}/" in path for b in touched)} == kept
    now = bucketed.read_buckets(spark, folder, snapshot.schema)
    assert rows(now.where("stock <> 5")) == [(3, 11)]
    assert now.count() == 200
    assert {r.id for r in rejects.collect()} == {None, 900}


def test_a_change_set_without_keys_writes_nothing(spark, tmp_path):
    folder = str(tmp_path / "rows")
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    bucketed.write_buckets(snapshot, folder, buckets=4)
    before = files(folder)
    change = spark.createDataFrame([(None, "x", 1)], "id bigint, name string, ts bigint")
    rejects = bucketed.apply_to_buckets(spark, folder, snapshot.schema, change, changes.upsert, buckets=4)
    assert files(folder) == before and rejects.count() == 1


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    folder = str(tmp_path / "rows")
    snapshot = spark.range(5).withColumn("stock", F.lit(1))
    bucketed.write_buckets(snapshot, folder, buckets=4)
    with pytest.raises(ValueError):
        bucketed.apply_to_buckets(
            spark, folder, snapshot.schema, snapshot.withColumnRenamed("stock", "quantity"), changes.add_stock, buckets=8
        )


@pytest.mark.parametrize("seed", [1, 2])
def test_delta_checks_equal_full_checks(spark, rows, seed):
    draw = random.Random(seed)
    kind = "id bigint, parent bigint, code string, size int"

    def row(i):
        return (i, draw.choice([None, *range(6)]), draw.choice([None, "a", "b", "c"]), draw.choice([None, 1, 5, 9]))

    old = [row(i) for i in range(20)]
    removed = draw.sample(old, 8)
    added = [row(r[0]) for r in removed[:4]] + [row(100 + i) for i in range(4)]
    new = [r for r in old if r not in removed] + added
    old_parents, new_parents = set(draw.sample(range(6), 3)), set(draw.sample(range(6), 3))

    def table(values):
        return spark.createDataFrame(values, kind)

    def parents(ids):
        return spark.createDataFrame([(i,) for i in sorted(ids)], "id bigint")

    moved = delta_checks.RowChanges(table(removed), table(added))
    keys = ["parent", "code"]
    for check in (
        lambda df: constraints.not_null(df, ["code", "size"]),
        lambda df: constraints.in_range(df, "size", 2, 8),
    ):
        found = delta_checks.row_check(check(table(old)), moved, check)
        assert rows(found, "key", "column", "value") == rows(check(table(new)), "key", "column", "value")
    found = delta_checks.unique_check(
        constraints.unique(table(old), keys), delta_checks.key_counts(table(old), keys), moved, keys
    )
    assert rows(found, "key", "value") == rows(constraints.unique(table(new), keys), "key", "value")
    found = delta_checks.foreign_key_check(
        constraints.foreign_key(table(old), "parent", parents(old_parents)),
        table(new),
        moved,
        "parent",
        parents(new_parents),
        delta_checks.RowChanges(parents(old_parents - new_parents), parents(new_parents - old_parents)),
    )
    full = constraints.foreign_key(table(new), "parent", parents(new_parents))
    assert rows(found, "key", "value") == rows(full, "key", "value")


def test_latencies_of_a_range_of_minutes(spark):
    log = spark.createDataFrame(
        [("a", START + timedelta(seconds=20 * i), "success" if i % 3 else "failed", float(i)) for i in range(30)]
        + [("b", START, "failed", None)],
        "endpoint string, ts timestamp_ntz, status string, latency_ms double",
    )
    kept = rollups.latency_rollup(log)
    whole = {r.endpoint: r for r in rollups.rolled_up_latency(kept).collect()}
    assert (whole["a"].calls, whole["a"].failed, whole["a"].p95_latency) == (30, 10, 28.0)
    assert whole["b"].calls == 1 and whole["b"].p95_latency is None
    cut = rollups.rolled_up_latency(
        kept,
        start=F.lit((START + timedelta(minutes=2)).isoformat()).cast("timestamp_ntz"),
        end=F.lit((START + timedelta(minutes=4)).isoformat()).cast("timestamp_ntz"),
        quantile=0.5,
    ).collect()
    assert [(r.endpoint, r.calls) for r in cut] == [("a", 6)] and 6 <= cut[0].p50_latency <= 11
    assert rollups.rolled_up_latency(kept.limit(0)).collect() == []


def test_profile_of_a_range_of_days(spark):
    log = spark.createDataFrame(
        [(START + timedelta(days=i % 4), f"v{i % 6}" if i % 5 else None, i) for i in range(40)],
        "at timestamp_ntz, name string, n bigint",
    )
    kept = rollups.profile_rollup(log, ["name", "n"], ts="at")
    day = F.lit("2024-01-02").cast("date")
    found = {r.column_name: r for r in rollups.rolled_up_profile(kept, first=day, last=day).collect()}
    own = [i for i in range(40) if i % 4 == 1]
    names = [f"v{i % 6}" for i in own if i % 5]
    assert found["n"].distinct_values == 10 and found["n"].avg_column_width == 8.0
    assert found["name"].distinct_values == len(set(names))
    assert found["name"].null_fraction == pytest.approx(1 - len(names) / len(own))


def test_bitmaps_of_batches_add_up(spark, rows):
    users = spark.createDataFrame(
        [(i, "ACTIVE" if i % 5 else "INACTIVE", START + timedelta(days=40 * (i % 2))) for i in (1, 2, 3, 5, 40_000, 80_001)],
        "id bigint, status string, registration_date timestamp_ntz",
    )
    orders = spark.createDataFrame(
        [(u, START + timedelta(days=30 * m)) for u in (1, 2, 3, 5, 40_000, 80_001, 80_001) for m in range(1 + u % 4)]
        + [(None, START)],
        "user_id bigint, created_at timestamp_ntz",
    )
    parts = [revenue.ordering_bitmaps(orders), revenue.ordering_bitmaps(orders.limit(4))]
    merged = revenue.merged_bitmaps(parts[0].unionByName(parts[1]), "activity")
    found = revenue.retention_of_bitmaps(revenue.registered_bitmaps(users), merged)
    assert rows(found) == rows(revenue.cohort_retention(users, orders))


PUSH = "recipient string, sentAt timestamp_ntz"


def test_a_push_at_exactly_the_lifetime_joins_its_list(spark, rows):
    month = timedelta(days=30)
    sent = spark.createDataFrame(
        [("u", START), ("u", START + month), ("v", START), ("v", START + month + timedelta(microseconds=1)), ("w", None)], PUSH
    )
    assert rows(history.closed_lists(sent), "recipient", "list_start", "pushed") == [
        ("u", START, 2),
        ("v", START, 1),
        ("v", START + month + timedelta(microseconds=1), 1),
    ]


def test_lists_are_given_out_once_when_they_have_closed(spark, rows, tmp_path):
    source, sink = str(tmp_path / "sent"), str(tmp_path / "lists")

    def run(pushes):
        rows_ = [(who, START + timedelta(days=day)) for who, day in pushes]
        spark.createDataFrame(rows_, PUSH).coalesce(1).write.mode("append").parquet(source)
        stream = history.closed_lists(spark.readStream.schema(PUSH).parquet(source))
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(sink).awaitTermination()
        return rows(spark.read.schema(stream.schema).parquet(sink), "recipient", "list_start", "pushed")

    assert run([("u", 0), ("v", 5)]) == []
    assert run([("u", 20), ("v", 50)]) == []  # u's list was still open
    first = ("u", START, 2)
    assert run([("v", 81), ("x", 81)]) == [first, ("v", START + timedelta(days=5), 1)]
    assert run([("x", 140)]) == [first, ("v", START + timedelta(days=5), 1), ("v", START + timedelta(days=50), 1)]
