"""Order events, notifications and histories with their SQL counterparts.

Events are derived from the orders table: one per created order and one per
order that has left the pending state. Some are spoilt on purpose. The streams
read them from text files in the shared folder and run until all are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.registry.core import Registry
from orderloom.session import shared_folder
from orderloom.sources.canonical import CanonicalTables
from orderloom.streaming import events as ev
from orderloom.streaming import history, notifications

registry = Registry()
add = registry.add

NOW = "2001-08-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def clean_events(t: CanonicalTables) -> DataFrame:
    moved = t.v_orders.where("status <> 'PENDING'").withColumn(
        "changed_at", F.col("created_at") + F.expr("interval 1 day")
    )
    return ev.order_events(t.v_orders, ev.CREATED, "created_at").unionByName(
        ev.order_events(moved, ev.STATUS_UPDATED, "changed_at")
    )


_EVENTS = (
    "all_events",
    """
    select 'ORDER_CREATED' as event_type, id, user_id, status, total_amount, created_at as event_time from v_orders
    union all
    select 'ORDER_STATUS_UPDATED', id, user_id, status, total_amount, created_at + interval 1 day
    from v_orders where status <> 'PENDING'""",
)
_GOOD = (
    "good_events",
    """
    select * replace (case when id % 79 = 0 then 'ORDER_VIEWED' else event_type end as event_type)
    from all_events where id % 97 > 0 and id % 89 > 0""",
)
_MESSAGES = (
    "messages",
    """
    select cast(user_id as varchar) as recipient,
           case when event_type = 'ORDER_CREATED' then '주문 생성 알림' else '주문 상태 변경 알림' end as subject,
           case when event_type = 'ORDER_CREATED'
                then concat('주문이 성공적으로 생성되었습니다. 주문 ID: ', id)
                else concat('주문 상태가 ', status, '(으)로 변경되었습니다.') end as message,
           concat('user_', user_id, '@example.com') as email, event_time, id as "orderId",
           event_type as "eventType"
    from good_events where event_type in ('ORDER_CREATED', 'ORDER_STATUS_UPDATED')""",
)


def raw_events(t: CanonicalTables, disturbed: bool = False) -> DataFrame:
    """Event texts: some cut short, without user, of another type, or encoded twice.

    If ``disturbed``, some come without a time as well, and others twice.
    """
    order = F.col("orderId")
    prepared = clean_events(t).withColumns(
        {
            "userId": F.when(order % 89 > 0, F.col("userId")),
            "eventType": F.when(order % 79 == 0, "ORDER_VIEWED").otherwise(F.col("eventType")),
        }
    )
    if disturbed:
        again = (order % 67 == 0) & (order % 97 > 0) & (order % 89 > 0) & (order % 71 > 0)
        prepared = prepared.withColumn("timestamp", F.when(order % 71 > 0, F.col("timestamp")))
        prepared = prepared.unionByName(prepared.where(again))
    fields = [F.col(f.name) for f in ev.EVENT_SCHEMA.fields]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    twice = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    broken = F.concat(F.lit('{"orderId": '), order.cast("string"))
    return prepared.select(
        F.when(order % 97 == 0, broken).when(order % 83 == 0, twice).otherwise(text).alias("value")
    )


def _event_files(t: CanonicalTables, disturbed: bool = False, files: int | None = None) -> str:
    """A folder of event texts; ``files`` spreads the events of every recipient over so many."""
    folder = shared_folder(t.spark, "events")
    raw = raw_events(t, disturbed)
    (raw if files is None else raw.repartition(files, F.md5("value"))).write.text(folder)
    return folder


def _stream(t: CanonicalTables) -> DataFrame:
    return ev.file_stream(t.spark, _event_files(t))


def _pending(t: CanonicalTables) -> DataFrame:
    return notifications.order_notifications(t.spark.read.text(_event_files(t)))


def _finish(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over all that is there and return what it appended."""
    folder = shared_folder(stream.sparkSession, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def _notified(t: CanonicalTables, *tables: str):
    folder = shared_folder(t.spark, "notified")
    paths = {name: f"{folder}/{name}" for name in ("queue", "history", "rejects")}
    stream = ev.file_stream(t.spark, _event_files(t, disturbed=True))
    query = notifications.start_notifier(stream, checkpoint=f"{folder}/checkpoint", available_now=True, **paths)
    query.awaitTermination()
    tables = [t.spark.read.parquet(paths[name]).drop("batch") for name in tables]
    return tables[0] if len(tables) == 1 else tables


def _timed(df: DataFrame) -> DataFrame:
    """Times, but for events that had none of their own and got that of their file."""
    own = F.col("orderId") % 71 > 0
    return df.withColumns({c: F.when(own, F.col(c)) for c in ("createdAt", "sentAt") if c in df.columns})


def _times_agree(t: CanonicalTables) -> DataFrame:
    """Per event: whether queue and history have the same time, and whether there is one."""
    queue, sent = _notified(t, "queue", "history")
    both = queue.select("orderId", "eventType", "createdAt").join(
        sent.select("orderId", "eventType", F.col("createdAt").alias("stored"), "sentAt"), ["orderId", "eventType"]
    )
    same = (F.col("createdAt") == F.col("stored")) & (F.col("createdAt") == F.col("sentAt"))
    return both.select("orderId", "eventType", F.coalesce(same, F.lit(False)).alias("agree"))


def _history(t: CanonicalTables, files: int | None = None) -> DataFrame:
    """The pushes of the history log; with ``files``, over as many batches."""
    folder = shared_folder(t.spark, "history")
    stream = ev.file_stream(t.spark, _event_files(t, files=files), None if files is None else 1)
    paths = {name: f"{folder}/{name}" for name in ("pushes", "days")}
    sent = notifications.delivered(notifications.order_notifications(stream))
    history.start_history(sent, checkpoint=f"{folder}/checkpoint", available_now=True, **paths).awaitTermination()
    pushes, days = (t.spark.read.parquet(path).drop("batch") for path in paths.values())
    return (
        history.history_log(pushes, days)
        .where(F.col("op") == history.PUSH)
        .select("recipient", "list_start", "seq", "sentAt", "orderId", "eventType", "message", "expires_at")
    )


def _sent(t: CanonicalTables) -> DataFrame:
    """Sent notifications, read from a table as a history sink leaves it."""
    folder = shared_folder(t.spark, "sent")
    _delivered(t).write.parquet(folder)
    return t.spark.read.parquet(folder)


def _delivered(t: CanonicalTables) -> DataFrame:
    return notifications.delivered(_pending(t))


def _fields(values: DataFrame) -> DataFrame:
    return values.select(F.from_json("value", ev.EVENT_SCHEMA).alias("e")).select(
        F.col("e.eventType").alias("event_type"),
        F.col("e.orderId").alias("id"),
        F.col("e.userId").alias("user_id"),
        F.col("e.status").alias("status"),
        F.col("e.totalAmount").alias("total_amount"),
        F.col("e.timestamp").cast("timestamp_ntz").alias("event_time"),
    )


def _published(t: CanonicalTables) -> str:
    folder = shared_folder(t.spark, "topic")
    ev.write_events(clean_events(t), folder)
    return folder


def _republished(t: CanonicalTables) -> DataFrame:
    """Events written as a batch, read as a stream, and written again by the stream."""
    folder = shared_folder(t.spark, "again")
    stream = ev.accepted(ev.decode(ev.file_stream(t.spark, _published(t))))
    ev.write_events(stream, f"{folder}/events", checkpoint=f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.text(f"{folder}/events")


add(
    "s03_event_stream",
    lambda t: _fields(_finish(ev.file_stream(t.spark, _published(t)), "values")),
    "select * from all_events",
    doubles="total_amount",
    named=(_EVENTS,),
)
add(
    "s04_order_event_sink",
    lambda t: _fields(t.spark.read.text(_published(t))),
    "select * from all_events",
    doubles="total_amount",
    named=(_EVENTS,),
)
add(
    "s04_order_event_stream_sink",
    lambda t: _fields(_republished(t)),
    "select * from all_events",
    doubles="total_amount",
    named=(_EVENTS,),
)
add(
    "st01_decode_events",
    lambda t: _finish(ev.accepted(ev.decode(_stream(t))), "decoded").select(
        "eventType", "orderId", "userId", "status", "totalAmount", "event_time"
    ),
    """select event_type as "eventType", id as "orderId", user_id as "userId", status,
              total_amount as "totalAmount", event_time from good_events""",
    doubles='"totalAmount"',
    named=(_EVENTS, _GOOD),
)
add(
    "st01_rejected_events",
    lambda t: _notified(t, "rejects").select(
        F.regexp_extract("value", r'orderId\\*": ?(\d+)', 1).cast("bigint").alias("id"),
        F.col("value").rlike("[0-9]$").alias("broken"),
    ),
    "select id, id % 97 = 0 as broken from all_events where id % 97 = 0 or id % 89 = 0",
    named=(_EVENTS,),
)
add(
    "st02_routed_events",
    lambda t: _pending(t)
    .groupBy("eventType", "subject")
    .agg(F.count(F.lit(1)).alias("events")),
    'select "eventType", subject, count(*) as events from messages group by all',
    named=(_EVENTS, _GOOD, _MESSAGES),
)
_COMMON = 'recipient, \'ORDER\' as type, subject, message, email, "orderId", "eventType"'
_TIME = 'case when "orderId" % 71 > 0 then event_time end'
add(
    "s06_times_agree",
    _times_agree,
    'select "orderId", "eventType", true as agree from messages',
    named=(_EVENTS, _GOOD, _MESSAGES),
)
add(
    "st03_notifications",
    lambda t: _pending(t).drop("id", "sentAt"),
    f'select {_COMMON}, \'PENDING\' as status, event_time as "createdAt" from messages',
    named=(_EVENTS, _GOOD, _MESSAGES),
)
add(
    "s05_notification_queue",
    lambda t: _timed(_notified(t, "queue").drop("id", "sentAt")),
    f'select {_COMMON}, \'PENDING\' as status, {_TIME} as "createdAt" from messages',
    named=(_EVENTS, _GOOD, _MESSAGES),
)
for _name in ("s06_notification_history", "st06_delivery_status"):
    add(
        _name,
        (lambda t: _timed(_notified(t, "history").drop("id")))
        if _name.startswith("s06")
        else (lambda t: _timed(_delivered(t).drop("id"))),
        f'select {_COMMON}, \'SENT\' as status, {_TIME} as "createdAt", {_TIME} as "sentAt" from messages',
        named=(_EVENTS, _GOOD, _MESSAGES),
    )
_LISTS = (
    "listed",
    """
    select *, max(case when fresh then event_time end) over (
                  partition by recipient order by event_time, "orderId", "eventType"
                  rows unbounded preceding) as list_start
    from (select *, coalesce(event_time - lag(event_time) over (partition by recipient
                                                 order by event_time, "orderId", "eventType") > interval 30 days,
                             true) as fresh
          from messages) gaps""",
)
_LISTED_SQL = """select recipient, list_start,
              row_number() over (partition by recipient, list_start
                                 order by event_time, "orderId", "eventType") as seq,
              event_time as "sentAt", "orderId", "eventType", message, event_time + interval 30 days as expires_at
       from listed"""
_NAMED = (_EVENTS, _GOOD, _MESSAGES, _LISTS)
add("st04_history_state", _history, _LISTED_SQL, named=_NAMED)
add("st04_history_state_many_batches", lambda t: _history(t, files=6), _LISTED_SQL, named=_NAMED)


def _out_of_order(t: CanonicalTables, files: int = 6) -> DataFrame:
    """A stream of events in so many batches by time, each event up to 20 days late."""
    folder = shared_folder(t.spark, "late")
    shown = F.unix_date(F.to_date(F.col("timestamp").cast("timestamp_ntz"))) + F.col("orderId") % 21
    timed = clean_events(t).withColumn("shown", shown)
    first, last = timed.agg(F.min("shown"), F.max("shown")).first()
    number = F.least(F.floor((F.col("shown") - first) * files / max(1, last - first + 1)), F.lit(files - 1))
    fields = [F.col(f.name) for f in ev.EVENT_SCHEMA.fields]
    texts = timed.select(number.alias("file"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    for n in range(files):  # one after another, as the stream takes them by age
        texts.where(F.col("file") == n).select("value").coalesce(1).write.mode("append").text(folder)
    return ev.file_stream(t.spark, folder, 1)


def _closed(t: CanonicalTables) -> DataFrame:
    sent = notifications.delivered(notifications.order_notifications(_out_of_order(t)))
    return _finish(history.closed_lists(sent), "closed")


add(
    "st04_closed_lists_stream",
    _closed,
    """select recipient, list_start, max(event_time) as last_push, count(*) as pushed,
              max(event_time) + interval 30 days as expires_at
       from listed group by recipient, list_start
       having max(event_time) + interval 60 days <= (select max(event_time) from messages)""",
    named=(_EVENTS, ("good_events", "select * from all_events"), _MESSAGES, _LISTS),
)
add(
    "st05_history_query",
    lambda t: notifications.notification_history(_sent(t), now=_now()).select(
        "recipient", "position", "orderId", "eventType", "message", "sentAt"
    ),
    f"""select recipient, row_number() over (partition by recipient
                    order by event_time desc, "orderId" desc, "eventType" desc) as position,
               "orderId", "eventType", message, event_time as "sentAt"
        from listed
        where event_time <= timestamp '{NOW}'
        qualify list_start = max(list_start) over (partition by recipient)
            and max(event_time) over (partition by recipient) >= timestamp '{NOW}' - interval 30 days""",
    named=(_EVENTS, _GOOD, _MESSAGES, _LISTS),
)
add(
    "st07_change_events",
    lambda t: clean_events(t).select(
        F.col("eventType").alias("event_type"),
        F.col("orderId").alias("id"),
        F.col("userId").alias("user_id"),
        "status",
        F.col("timestamp").cast("timestamp_ntz").alias("event_time"),
    ),
    "select event_type, id, user_id, status, event_time from all_events",
    named=(_EVENTS,),
)
