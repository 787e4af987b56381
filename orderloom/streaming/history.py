"""Per-recipient notification lists from a stream of sent notifications.

A batch of the stream is only appended: its pushes, and per recipient and day
the first push, the last one and their number. Day rows of several batches add
up by minimum, maximum and sum, so lists follow from the pushes alone, however
they were cut into batches and in whatever order they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.ordered import running_totals
from orderloom.streaming.notifications import TTL_DAYS

PUSH = "PUSH"
EXPIRE = "EXPIRE"

_CARRIED = ["orderId", "eventType", "subject", "message"]
_PUSHES = ["recipient", "sentAt", *_CARRIED]


def day_rows(pushes: DataFrame) -> DataFrame:
    """First and last push and their number, per recipient and day."""
    return pushes.groupBy("recipient", F.to_date("sentAt").alias("day")).agg(
        F.min("sentAt").alias("first"), F.max("sentAt").alias("last"), F.count(F.lit(1)).alias("pushed")
    )


def merged_days(days: DataFrame) -> DataFrame:
    """Day rows of all batches as one row per recipient and day."""
    return days.groupBy("recipient", "day").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("pushed").alias("pushed")
    )


def start_history(
    sent: DataFrame, *, pushes: str, days: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the pushes and the day rows of a stream; a replayed batch replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{pushes}/batch={batch_id}"
        batch.select(*_PUSHES).write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.schema(batch.select(*_PUSHES).schema).parquet(folder)
        day_rows(written).write.mode("overwrite").parquet(f"{days}/batch={batch_id}")

    writer = sent.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def closed_lists(sent: DataFrame, *, ttl_days: int = TTL_DAYS, lateness: str = "30 days") -> DataFrame:
    """Start, last push, pushes and end of each list that has ended, from keyed state of the stream.

    A list is a session with a gap of its lifetime; a push at exactly that age
    still joins it. The state has one row per open list, not its pushes. A list
    is given out once, when the newest push is later than its end by the
    lateness, to the millisecond; a push that late is dropped, unlike in
    ``history_log``, and so are pushes without a time. Of a batch all lists are
    given out. Times are counted in elapsed time, whatever the session's zone.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    pushed = sent.withColumn("pushed_at", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("sentAt"))))
    gap = f"{ttl_days * 24} hours"
    lists = (
        pushed.withWatermark("pushed_at", lateness)
        .groupBy("recipient", F.session_window("pushed_at", gap).alias("list"))
        .agg(F.max("pushed_at").alias("last"), F.count(F.lit(1)).alias("pushed"))
    )

    def plain(at: Column) -> Column:
        return F.timestamp_add("MICROSECOND", F.unix_micros(at), epoch)

    return lists.select(
        "recipient",
        plain(F.col("list.start")).alias("list_start"),
        plain(F.col("last")).alias("last_push"),
        "pushed",
        (plain(F.col("last")) + F.make_interval(days=F.lit(ttl_days))).alias("expires_at"),
    )


def list_days(days: DataFrame, *, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Day rows with the start of the list that they belong to.

    A list ends as a whole after a lifetime without pushes. Such a gap lies
    between two days, so recipients are looked at by days, not by pushes.
    """
    daily = merged_days(days).withColumn("before", F.expr("lag(last) over (partition by recipient order by day)"))
    gap = F.timestamp_diff("MICROSECOND", F.col("before"), F.col("first"))
    fresh = F.when(F.col("before").isNull() | (gap > ttl_days * 86_400_000_000), F.col("first"))
    upto = "over (partition by recipient order by day rows unbounded preceding)"
    return daily.withColumn("fresh", fresh).withColumn("list_start", F.expr(f"max(fresh) {upto}")).drop("before", "fresh")


def history_log(
    pushes: DataFrame, days: DataFrame, *, ttl_days: int = TTL_DAYS, lateness: str = "30 days"
) -> DataFrame:
    """Pushes with their list, their place in it and its end as of them, and the ends of closed lists.

    A list is closed once the newest push of all is later than its end by more
    than the lateness; until then a late push may still join it.
    """
    lifetime = F.make_interval(days=F.lit(ttl_days))
    listed = list_days(days, ttl_days=ttl_days)
    placed = pushes.withColumn("day", F.to_date("sentAt")).join(
        listed.select("recipient", "day", "list_start"), ["recipient", "day"]
    )
    numbered = running_totals(
        placed,
        ["recipient", "list_start"],
        F.unix_date("day"),
        ["sentAt", "orderId", "eventType"],
        {"seq": F.lit(1)},
    )
    columns = ["recipient", "op", "list_start", "seq", "sentAt", "expires_at", *_CARRIED]
    log = numbered.withColumns({"op": F.lit(PUSH), "expires_at": F.col("sentAt") + lifetime})
    newest: Column = listed.agg(F.max("last").alias("newest")).select("newest").scalar()
    ended = (
        listed.groupBy("recipient", "list_start")
        .agg((F.max("last") + lifetime).alias("expires_at"), F.sum("pushed").alias("seq"))
        .where(F.col("expires_at") + F.expr(f"interval {lateness}") < newest)
        .withColumns({"op": F.lit(EXPIRE), "sentAt": F.col("expires_at")})
    )
    empty = {c: F.lit(None).cast(pushes.schema[c].dataType) for c in _CARRIED}
    return log.select(*columns).unionByName(ended.withColumns(empty).select(*columns))
