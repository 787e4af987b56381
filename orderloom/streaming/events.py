"""Order events: making them from order rows, reading them as a stream, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the topic, of the event types and of the event fields.
TOPIC = "orders"
CREATED = "ORDER_CREATED"
STATUS_UPDATED = "ORDER_STATUS_UPDATED"
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("eventType", T.StringType()),
        T.StructField("orderId", T.LongType()),
        T.StructField("userId", T.LongType()),
        T.StructField("productId", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("totalAmount", T.DecimalType(12, 2)),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def order_events(orders: DataFrame, event_type: str, at: str) -> DataFrame:
    """Orders as event rows; ``at`` names the column with the time of the change.

    Needs id, user_id, status and total_amount; product_id and quantity are
    null where the orders do not have them.
    """

    def optional(name: str, kind: str):
        return (F.col(name) if name in orders.columns else F.lit(None)).cast(kind)

    return orders.select(
        F.lit(event_type).alias("eventType"),
        F.col("id").cast("bigint").alias("orderId"),
        F.col("user_id").cast("bigint").alias("userId"),
        optional("product_id", "bigint").alias("productId"),
        optional("quantity", "int").alias("quantity"),
        F.col("total_amount").cast("decimal(12,2)").alias("totalAmount"),
        F.col("status"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def encode(events: DataFrame) -> DataFrame:
    """Events as JSON text in a single column ``value``, without a message key.

    The same rows can be written to files or, with the connector at hand, to a topic.
    """
    fields = [F.col(f.name) for f in EVENT_SCHEMA.fields]
    return events.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def topic_stream(spark: SparkSession, servers: str, topic: str = TOPIC, **options: str) -> DataFrame:
    """Order events from a message topic, from its beginning.

    Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    records = reader.options(**options).load()
    return records.select(F.col("value").cast("string").alias("value"), F.col("timestamp").cast("timestamp_ntz").alias("received"))


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Order events from text files with one event per line; ``received`` is the time of the file."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path).select("value", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received"))


def write_events(events: DataFrame, target: str, *, servers: str | None = None, checkpoint: str | None = None):
    """Publish event rows as JSON texts, to a folder of text files or, with ``servers``, to the topic ``target``.

    A batch is written at once; a stream needs a checkpoint, takes what is there
    and gives its query back. The topic needs the Kafka connector.
    """
    texts = encode(events)
    writer = texts.writeStream if texts.isStreaming else texts.write
    if servers is not None:
        writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", target)
    else:
        writer = writer.format("text").option("path", target)
    if texts.isStreaming:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return writer.mode("append").save()


def decode(raw: DataFrame) -> DataFrame:
    """Parse ``value`` into a struct ``event`` and flag it as ``valid``.

    Accepts an object as well as a JSON string that holds one. An event without
    a numeric user is not valid, whatever its type. ``received``, the time of
    the record, is kept where the source gives one.
    """
    received = F.col("received") if "received" in raw.columns else F.lit(None).cast("timestamp_ntz").alias("received")
    text = F.trim("value")
    inner = F.when(
        text.startswith('"'),
        F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(T.StringType()))[0],
    ).otherwise(text)
    parsed = F.when(F.trim("inner").startswith("{"), F.from_json("inner", EVENT_SCHEMA))
    return (
        raw.select("value", received, inner.alias("inner"))
        .select("value", "received", parsed.alias("event"))
        .select("value", "received", "event", F.col("event.userId").isNotNull().alias("valid"))
    )


def event_time() -> Column:
    """Time of a decoded event: its own, else that of its record, else, without either, that of the batch."""
    own = F.col("event.timestamp").try_cast("timestamp_ntz")
    return F.coalesce(own, F.col("received"), F.localtimestamp())


def accepted(decoded: DataFrame) -> DataFrame:
    """Valid events with ``event_time``."""
    # Taken out of an array: a plain filter would be moved below the parsing and
    # parse every text again.
    timed = F.struct("event.*", event_time().alias("event_time"))
    return decoded.select(F.inline(F.when(F.col("valid"), F.array(timed))))


def rejected(decoded: DataFrame) -> DataFrame:
    """Texts of the events that are dropped."""
    return decoded.where("not valid").select("value")


def without_repeats(events: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Drop repeated events of the same order, type and time.

    On a stream, events older than the newest one by more than the horizon are
    dropped as well, so that the state stays bounded.
    """
    keys = ["orderId", "eventType", "event_time"]
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    marked = events.withColumn("_mark", F.col("event_time").cast("timestamp"))
    return marked.withWatermark("_mark", horizon).dropDuplicatesWithinWatermark(keys).drop("_mark")
