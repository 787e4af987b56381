"""Order events, notifications and histories, in one batch and in many."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderloom.streaming import events as ev
from orderloom.streaming import history, notifications

START = datetime(2024, 1, 1, 9)


def event(order, user, kind=ev.CREATED, status="PENDING", days=0.0, **extra):
    at = START + timedelta(days=days)
    return {
        "eventType": kind,
        "orderId": order,
        "userId": user,
        "productId": 1,
        "quantity": 2,
        "totalAmount": 199.98,
        "status": status,
        "timestamp": at.isoformat(),
        **extra,
    }


GOOD = [
    event(1, 7),
    event(1, 7, ev.STATUS_UPDATED, "SHIPPED", days=1),
    event(2, 8, days=2),
    event(3, 7, days=40),
    event(4, 8, days=41.5),
]
BAD = [
    "{broken",
    "[1, 2]",
    "",
    json.dumps({"eventType": ev.CREATED, "orderId": 5}),
    json.dumps({"eventType": ev.CREATED, "orderId": 6, "userId": None}),
    json.dumps({"eventType": ev.CREATED, "orderId": 7, "userId": "x"}),
]


def raw(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def texts(events):
    return [json.dumps(e) for e in events]


def write_files(folder, lines, per_file):
    folder.mkdir()
    for n, i in enumerate(range(0, len(lines), per_file)):
        path = folder / f"{n:03d}.txt"
        path.write_text("\n".join(lines[i : i + per_file]) + "\n")
        stamp = 1_700_000_000 + n
        os.utime(path, (stamp, stamp))
    return str(folder)


def test_decoding_accepts_both_encodings_and_drops_the_rest(spark, rows):
    once = texts(GOOD[:2])
    twice = [json.dumps(t) for t in texts(GOOD[2:4])]
    decoded = ev.decode(raw(spark, once + twice + BAD))
    accepted = ev.accepted(decoded)
    assert rows(accepted, "orderId", "userId") == [(1, 7), (1, 7), (2, 8), (3, 7)]
    assert ev.rejected(decoded).count() == len(BAD)
    first = accepted.where("orderId = 2").first()
    assert first.event_time == START + timedelta(days=2) and str(first.totalAmount) == "199.98"


def test_notification_texts(spark):
    unknown = event(9, 9, "ORDER_VIEWED")
    no_status = event(1, 7, ev.STATUS_UPDATED, None)
    result = notifications.order_notifications(raw(spark, texts([GOOD[0], GOOD[1], unknown, no_status]))).collect()
    messages = [(r.recipient, r.subject, r.message, r.status, r.email, r.sentAt) for r in result]
    assert messages[0] == (
        "7",
        "주문 생성 알림",
        "주문이 성공적으로 생성되었습니다. 주문 ID: 1",
        "PENDING",
        "user_7@example.com",
        None,
    )
    assert messages[1][1:3] == ("주문 상태 변경 알림", "주문 상태가 SHIPPED(으)로 변경되었습니다.")
    assert "null" in messages[2][2] and len(messages) == 3
    mails = spark.createDataFrame([("a@b.c",), ("5",)], "r string").select(notifications.address(F.col("r")))
    assert [r[0] for r in mails.collect()] == ["a@b.c", "user_5@example.com"]


def test_events_round_trip(spark, rows):
    orders = spark.createDataFrame(
        [(1, 7, "PENDING", 12.5, START)], "id bigint, user_id bigint, status string, total_amount double, t timestamp_ntz"
    )
    sent = ev.encode(ev.order_events(orders, ev.CREATED, "t"))
    assert sent.columns == ["value"]
    back = json.loads(sent.first().value)
    assert set(back) == set(f.name for f in ev.EVENT_SCHEMA.fields)
    assert back["productId"] is None and back["eventType"] == ev.CREATED
    assert rows(ev.accepted(ev.decode(sent)), "orderId", "event_time") == [(1, START)]


def test_topic_stream_needs_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        ev.topic_stream(spark, "nowhere:9092")


def run_notifier(spark, folder, source, max_files=None):
    paths = {name: f"{folder}/{name}" for name in ("queue", "history", "rejects")}
    notifications.start_notifier(
        ev.file_stream(spark, source, max_files),
        checkpoint=f"{folder}/checkpoint",
        available_now=True,
        **paths,
    ).awaitTermination()
    return {name: spark.read.parquet(path).drop("batch") for name, path in paths.items()}


def test_one_batch_or_many_give_the_same_tables(spark, rows, tmp_path):
    source = write_files(tmp_path / "in", texts(GOOD) + BAD, per_file=2)
    one = run_notifier(spark, tmp_path / "one", source)
    many = run_notifier(spark, tmp_path / "many", source, max_files=1)
    for table in ("queue", "history", "rejects"):
        assert rows(one[table]) == rows(many[table])
    assert one["queue"].count() == len(GOOD)
    # An empty line is no record for a text source but an empty value, and is rejected.
    assert one["rejects"].count() == len(BAD)
    assert {r.status for r in one["history"].collect()} == {"SENT"}


def test_restart_repeats_nothing(spark, tmp_path):
    source = write_files(tmp_path / "in", texts(GOOD), per_file=2)
    first = run_notifier(spark, tmp_path / "out", source)["queue"].count()
    again = run_notifier(spark, tmp_path / "out", source)["queue"].count()
    assert first == again == len(GOOD)


def test_replayed_batch_replaces_its_folder(spark, tmp_path):
    source = write_files(tmp_path / "in", texts(GOOD), per_file=10)
    run_notifier(spark, tmp_path / "out", source)
    # A query that lost its checkpoint starts over with the first batch.
    paths = {name: f"{tmp_path}/out/{name}" for name in ("queue", "history", "rejects")}
    notifications.start_notifier(
        ev.file_stream(spark, source), checkpoint=f"{tmp_path}/fresh", available_now=True, **paths
    ).awaitTermination()
    assert spark.read.parquet(paths["queue"]).count() == len(GOOD)


def test_repeated_events(spark, tmp_path):
    lines = texts([GOOD[0], GOOD[0], GOOD[1], GOOD[0]])
    accepted = ev.accepted(ev.decode(raw(spark, lines)))
    assert ev.without_repeats(accepted).count() == 2
    source = write_files(tmp_path / "in", lines, per_file=1)
    stream = ev.without_repeats(ev.accepted(ev.decode(ev.file_stream(spark, source, 1))))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def sent_at(spark, times):
    """Notifications of user 7 at offsets in days."""
    lines = texts([event(i, 7, days=d) for i, d in enumerate(times)])
    return notifications.delivered(notifications.order_notifications(raw(spark, lines)))


def now(days, micros=0):
    at = START + timedelta(days=days, microseconds=micros)
    return F.lit(at.isoformat()).cast("timestamp_ntz")


def history_ids(sent, at):
    result = notifications.history_of(sent, "7", now=at).collect()
    assert [r.position for r in result] == list(range(1, len(result) + 1))
    return [r.orderId for r in result]


def test_history_expires_as_a_whole(spark):
    sent = sent_at(spark, [0, 10, 35, 70])
    assert history_ids(sent, now(35)) == [2, 1, 0]
    assert history_ids(sent, now(65)) == [2, 1, 0]  # exactly at the end
    assert history_ids(sent, now(65, 1)) == []
    assert history_ids(sent, now(70)) == [3]  # a new list
    assert notifications.history_of(sent, "8", now=now(35)).count() == 0
    # A push at the very end still keeps the list.
    assert history_ids(sent_at(spark, [0, 30]), now(31)) == [1, 0]


def run_log(spark, folder, source, max_files=None):
    raw_stream = ev.file_stream(spark, source, max_files)
    sent = notifications.delivered(notifications.order_notifications(raw_stream))
    paths = {name: f"{folder}/{name}" for name in ("pushes", "days")}
    history.start_history(sent, checkpoint=f"{folder}-checkpoint", available_now=True, **paths).awaitTermination()
    return history.history_log(*(spark.read.parquet(path).drop("batch") for path in paths.values()))


def test_history_log_in_one_batch_or_many(spark, rows, tmp_path):
    source = write_files(tmp_path / "in", texts(GOOD), per_file=1)
    columns = ["recipient", "op", "list_start", "seq", "sentAt", "orderId", "expires_at"]
    one = run_log(spark, tmp_path / "one", source)
    many = run_log(spark, tmp_path / "many", source, max_files=1)
    assert rows(one, *columns) == rows(many, *columns)
    pushes = F.col("op") == history.PUSH
    found = {(r.orderId, r.eventType): (r.list_start, r.seq) for r in one.where(pushes).collect()}
    assert found[1, ev.STATUS_UPDATED] == (START, 2)
    # User 7 was silent for 39 days: the list ended and another began.
    assert found[3, ev.CREATED] == (START + timedelta(days=40), 1)


def test_history_log_of_late_pushes(spark, rows, tmp_path):
    """Pushes at day 0, 40 and 12: the last one joins the list of day 0 and keeps it alive."""
    lines = texts([event(1, 7), event(2, 7, days=40), event(3, 7, days=12)])
    source = write_files(tmp_path / "in", lines, per_file=1)
    found = [
        rows(run_log(spark, tmp_path / f"out{files}", source, max_files=files), "orderId", "list_start", "seq")
        for files in (None, 1)
    ]
    assert found[0] == found[1] == [(1, START, 1), (2, START, 3), (3, START, 2)]


def test_history_log_closes_lists_after_the_lateness(spark, tmp_path):
    lines = texts([event(1, 7), event(2, 8, days=61), event(3, 8, days=62)])
    source = write_files(tmp_path / "in", lines, per_file=1)
    log = run_log(spark, tmp_path / "out", source, max_files=1)
    ended = log.where(F.col("op") == history.EXPIRE).collect()
    assert [(r.recipient, r.seq, r.expires_at) for r in ended] == [("7", 1, START + timedelta(days=30))]


def test_notifier_takes_a_repeated_event_once(spark, tmp_path):
    """Over several batches; the file's time stands in for a missing one, the same in both tables."""
    timeless = {**GOOD[1], "timestamp": None}
    broken = '{"orderId": 5'
    source = write_files(tmp_path / "in", [*texts([GOOD[0], GOOD[0], timeless, GOOD[0]]), broken, broken], per_file=1)
    paths = {name: str(tmp_path / name) for name in ("queue", "history", "rejects")}
    stream = ev.file_stream(spark, source, 1)
    notifications.start_notifier(stream, checkpoint=str(tmp_path / "c"), available_now=True, **paths).awaitTermination()
    queue, sent = (sorted((r.orderId, r.createdAt) for r in spark.read.parquet(paths[n]).collect()) for n in ("queue", "history"))
    assert len(queue) == 2 and queue == sent
    assert spark.read.parquet(paths["rejects"]).count() == 2


def test_only_the_months_of_a_batch_are_read(spark, tmp_path):
    """Fifty batches of a month each; files of other months are not even opened, being no Parquet."""
    folder = str(tmp_path / "decoded")
    schema = None
    for batch in range(50):
        rows = ev.decode(raw(spark, texts([event(batch, 7, days=31 * batch)]))).withColumn("event_time", ev.event_time())
        timed = rows.withColumn("month", F.date_format("event_time", "yyyy-MM"))
        schema = timed.schema
        if batch in (7, 30):
            timed.write.partitionBy("month").parquet(f"{folder}/batch={batch}")
        else:
            month = (START + timedelta(days=31 * batch)).strftime("%Y-%m")
            other = tmp_path / "decoded" / f"batch={batch}" / f"month={month}"
            other.mkdir(parents=True)
            (other / "part-0.parquet").write_text("not a table")
    own = (START + timedelta(days=31 * 7)).strftime("%Y-%m")
    known = notifications.earlier_events(spark, folder, schema, 40, [own])
    assert [r.orderId for r in known.collect()] == [7]
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "batch" in filters
    assert notifications.earlier_events(spark, folder, schema, 7, [own]).collect() == []
    assert notifications.earlier_events(spark, folder, schema, 40, [None]).collect() == []
