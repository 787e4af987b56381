"""Notifications from order events: building, delivery, queue and history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.ordered import running_totals
from orderloom.streaming.events import CREATED, STATUS_UPDATED, accepted, decode, event_time, rejected

# Type, states and texts of a notification.
KIND = "ORDER"
PENDING = "PENDING"
SENT = "SENT"
CREATED_SUBJECT = "주문 생성 알림"
CREATED_TEXT = "주문이 성공적으로 생성되었습니다. 주문 ID: %s"
STATUS_SUBJECT = "주문 상태 변경 알림"
STATUS_TEXT = "주문 상태가 %s(으)로 변경되었습니다."

TTL_DAYS = 30
_MICROS_PER_DAY = 86_400_000_000


def _text(template: str, value: Column) -> Column:
    """The template with a value; a missing one is written as ``null``."""
    return F.format_string(template, F.coalesce(value.cast("string"), F.lit("null")))


def address(recipient: Column) -> Column:
    """The recipient itself if it is an address, else one made from the user id."""
    return F.when(recipient.contains("@"), recipient).otherwise(
        F.concat(F.lit("user_"), recipient, F.lit("@example.com"))
    )


def notifications(events: DataFrame) -> DataFrame:
    """Pending notifications for created orders and status changes; other types give none."""
    created = F.col("eventType") == CREATED
    recipient = F.col("userId").cast("string")
    return events.where(F.col("eventType").isin(CREATED, STATUS_UPDATED)).select(
        F.lit(None).cast("bigint").alias("id"),
        recipient.alias("recipient"),
        F.lit(KIND).alias("type"),
        F.when(created, CREATED_SUBJECT).otherwise(STATUS_SUBJECT).alias("subject"),
        F.when(created, _text(CREATED_TEXT, F.col("orderId")))
        .otherwise(_text(STATUS_TEXT, F.col("status")))
        .alias("message"),
        F.lit(PENDING).alias("status"),
        F.col("event_time").alias("createdAt"),
        F.lit(None).cast("timestamp_ntz").alias("sentAt"),
        address(recipient).alias("email"),
        "orderId",
        "eventType",
    )


def delivered(pending: DataFrame, sent_at: Column | None = None) -> DataFrame:
    """The notifications as sent.

    Handing over a mail never fails a notification, so every one ends as sent;
    a failed one would be kept nowhere.
    """
    return pending.withColumns(
        {"status": F.lit(SENT), "sentAt": F.col("createdAt") if sent_at is None else sent_at}
    )


def order_notifications(raw: DataFrame) -> DataFrame:
    """Pending notifications of raw order events, batch or stream."""
    return notifications(accepted(decode(raw)))


def start_notifier(
    raw: DataFrame,
    *,
    queue: str,
    history: str,
    rejects: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Write queue, history and rejected events of a stream of raw events.

    Every batch is decoded once into a table below the checkpoint, by month of
    the events, from which the three tables are taken; so they agree on the time
    of an event that brings none. A repeated event is notified once: what an
    earlier batch has decoded is left out, and only the months of the batch are
    looked up for that, so nothing is dropped for being late. Each batch fills a
    folder of its own and replaces it when it is replayed, so a restart repeats
    nothing.
    """
    folder = f"{checkpoint}/decoded"
    keys = ["orderId", "eventType", "event_time"]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        timed = batch.withColumn("month", F.date_format("event_time", "yyyy-MM")).hint("rebalance", "month")
        own = f"{folder}/batch={batch_id}"
        timed.write.mode("overwrite").partitionBy("month").parquet(own)
        rows = session.read.schema(timed.schema).parquet(own)
        fresh = rows.where("valid").select("event.*", "event_time", "month").dropDuplicates(keys)
        if batch_id:
            months = [row.month for row in fresh.select("month").distinct().collect()]  # one row per month
            known = earlier_events(session, folder, timed.schema, batch_id, months)
            same = [F.equal_null(fresh[c], known[c]) for c in ("month", *keys)]
            fresh = fresh.join(known, same, "left_anti")
        pending = notifications(fresh)
        for df, path in (
            (pending, queue),
            (delivered(pending), history),
            (rejected(rows), rejects),
        ):
            df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    decoded = decode(raw)
    timed = decoded.withColumn("event_time", event_time())
    writer = timed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def earlier_events(
    session: SparkSession, folder: str, schema: T.StructType, batch_id: int, months: Sequence[str | None]
) -> DataFrame:
    """month and keys of the accepted events of earlier batches, in these months only (null: events without a time).

    The months are literals, so that the scan leaves the files of all others alone; a condition of a join would not.
    """
    stored = session.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(folder)
    month = F.col("month")
    own = month.isin([m for m in months if m is not None])
    if None in months:
        own = own | month.isNull()
    earlier = stored.where((F.col("batch") < batch_id) & own & F.col("valid"))
    return earlier.select("month", "event.orderId", "event.eventType", "event_time")


def live_lists(sent: DataFrame, *, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Recipients whose list is alive, with the first and the last push of it.

    A list ends as a whole when nothing was pushed to it for longer than its
    lifetime; the next push starts a new one. A gap that long lies between two
    days, so each recipient is looked at by days, not by pushes.
    """
    lifetime = ttl_days * _MICROS_PER_DAY
    daily = (
        sent.where(F.col("sentAt") <= now)
        .groupBy("recipient", F.to_date("sentAt").alias("day"))
        .agg(F.min("sentAt").alias("first"), F.max("sentAt").alias("last"))
    )
    before = F.expr("lag(last) over (partition by recipient order by day)")
    gap = F.timestamp_diff("MICROSECOND", F.col("before"), F.col("first"))
    starts = F.when(F.col("before").isNull() | (gap > lifetime), F.col("first"))
    return (
        daily.withColumn("before", before)
        .groupBy("recipient")
        .agg(F.max(starts).alias("list_start"), F.max("last").alias("last_push"))
        .where(F.timestamp_diff("MICROSECOND", F.col("last_push"), now) <= lifetime)
    )


def notification_history(sent: DataFrame, *, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Entries of all live lists with their position, 1 being the newest.

    One row per entry, so that a recipient with very many entries is never one
    value; filter by recipient and sort by position to read one history. Pushes
    of the same instant are ordered by order id and event type.
    """
    lists = live_lists(sent, now=now, ttl_days=ttl_days)
    entries = (
        sent.where(F.col("sentAt") <= now)
        .join(lists, "recipient")
        .where(F.col("sentAt") >= F.col("list_start"))
        .drop("list_start", "last_push")
    )
    return running_totals(
        entries,
        ["recipient"],
        -F.unix_date(F.to_date("sentAt")),
        ["sentAt", "orderId", "eventType"],
        {"position": F.lit(1)},
        descending=True,
    )


def history_of(
    sent: DataFrame, recipient: str, *, now: Column, ttl_days: int = TTL_DAYS
) -> DataFrame:
    """The history of one recipient, newest first; empty once its list has expired."""
    own = sent.where(F.col("recipient") == recipient)
    return notification_history(own, now=now, ttl_days=ttl_days).orderBy("position")
