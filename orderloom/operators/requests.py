"""Outcome, latency and dependency metrics over request logs and spans.

A request log has the columns request_id, ts, endpoint, status (success,
fallback or failed) and latency_ms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import flag_sum, minute_index, percent, quotient, seconds_between
from orderloom.operators.ordered import exclusive_quantile, running_totals

MIN_QUANTILE_SAMPLES = 20


def outcome(failed: Column, body: Column) -> Column:
    """success, fallback or failed from a failure flag and a JSON body.

    A body counts as fallback if its top-level ``status`` says so. A body that
    is not empty and not JSON counts as failed.
    """
    empty = body.isNull() | (body == "")
    broken = ~empty & F.get_json_object(body, "$").isNull()
    return (
        F.when(F.coalesce(failed, F.lit(False)) | broken, "failed")
        .when(F.get_json_object(body, "$.status") == "fallback", "fallback")
        .otherwise("success")
    )


def base_endpoint(path: Column) -> Column:
    return (
        F.when(path.contains("products"), "/api/products")
        .when(path.contains("users"), "/api/users")
        .otherwise("/api/orders")
    )


def _summary(log: DataFrame, by: Sequence[str]) -> DataFrame:
    status = F.col("status")
    elapsed = seconds_between(F.min("ts"), F.max("ts"))
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        flag_sum(status == "success").alias("success"),
        flag_sum(status == "fallback").alias("fallback"),
        flag_sum(status == "failed").alias("failed"),
        quotient(F.count(F.lit(1)), elapsed).alias("rps"),
        F.avg("latency_ms").alias("avg_latency"),
    )


def latency_summary(
    log: DataFrame, by: str | None = None, *, accuracy: int = 50_000
) -> DataFrame:
    """Outcome counts and shares, rate and latency, overall or per endpoint.

    The 95th percentile is exact; groups of up to 20 samples give their mean.
    """
    keys = [by] if by else []
    summary = _summary(log, keys)
    p95 = exclusive_quantile(log, "latency_ms", keys, accuracy=accuracy, name="p95")
    if by:
        tail = p95.withColumnRenamed(by, "_of")
        summary = summary.join(tail, F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        summary = summary.withColumn("p95", p95.select("p95").scalar())
    return summary.select(
        *keys,
        "total",
        "success",
        "fallback",
        "failed",
        percent(F.col("success"), F.col("total")).alias("success_pct"),
        percent(F.col("fallback"), F.col("total")).alias("fallback_pct"),
        percent(F.col("failed"), F.col("total")).alias("failed_pct"),
        "rps",
        "avg_latency",
        F.when(F.col("total") > MIN_QUANTILE_SAMPLES, F.col("p95"))
        .otherwise(F.col("avg_latency"))
        .alias("p95_latency"),
    )


def approximate_p95(log: DataFrame, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """95th percentile from a sketch in one pass, for logs where that is enough."""
    return log.groupBy(*by).agg(
        F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_latency")
    )


def endpoint_summary(log: DataFrame) -> DataFrame:
    """Outcome counts and mean latency per endpoint."""
    return _summary(log, ["endpoint"]).drop("rps", "total")


def rolling_failure_rate(
    log: DataFrame,
    *,
    window: int = 10,
    threshold: float = 50.0,
    by: str = "service",
    failures: Sequence[str] = ("failed", "fallback"),
    block: int = 100_000,
) -> DataFrame:
    """Share of failures among the last calls of each service.

    Rows appear from the first full window on. Calls get their position in the
    service from totals per minute; they are then cut into blocks of equal
    length, each with the few calls before it, and the rolling window runs per
    block. A service with most of the calls is thus spread over many tasks.
    """
    if block < window:
        raise ValueError("a block must hold at least one window")
    bad = F.when(F.col("status").isin(*failures), 1).otherwise(0)
    placed = running_totals(
        log.select(by, "ts", "request_id", bad.alias("bad")),
        [by],
        minute_index(F.col("ts")),
        ["ts", "request_id"],
        {"position": F.lit(1)},
    )
    home = F.floor((F.col("position") - 1) / F.lit(block))
    # The last calls of a block are repeated in front of the next one.
    lead_in = F.col("position") % block
    repeats = (lead_in > block - (window - 1)) | ((lead_in == 0) & F.lit(window > 1))
    spread = placed.withColumn("home", home).withColumn(
        "part",
        F.explode(F.when(repeats, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))),
    )
    recent = Window.partitionBy(by, "part").orderBy("position").rowsBetween(1 - window, Window.currentRow)
    rate = F.sum("bad").over(recent) * F.lit(100.0) / window
    return (
        spread.withColumn("failure_rate", rate)
        .where((F.col("part") == F.col("home")) & (F.col("position") >= window))
        .select(
            by,
            "ts",
            "request_id",
            "failure_rate",
            (F.col("failure_rate") >= threshold).alias("breached"),
        )
    )


def service_dependencies(spans: DataFrame) -> DataFrame:
    """Calls between services: parent, child and number of calls.

    Children are counted per parent span before the join, so a span with very
    many children is a single row by then.
    """
    keys = ["trace_id"] if "trace_id" in spans.columns else []
    children = (
        spans.where(F.col("parent_span_id").isNotNull())
        .groupBy(*keys, F.col("parent_span_id").alias("span_id"), F.col("service").alias("child"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    parents = spans.select(*keys, "span_id", F.col("service").alias("parent"))
    return (
        children.join(parents, [*keys, "span_id"])
        .groupBy("parent", "child")
        .agg(F.sum("calls").alias("callCount"))
    )


def progress_series(log: DataFrame, *, every: int = 100) -> DataFrame:
    """Cumulative outcome counts and speed after every so many requests and at the end."""
    status = F.col("status")

    def flag(value: str) -> Column:
        return F.when(status == value, 1).otherwise(0)

    counted = running_totals(
        log.select("ts", "request_id", "status"),
        [],
        minute_index(F.col("ts")),
        ["ts", "request_id"],
        {
            "completed": F.lit(1),
            "success": flag("success"),
            "fallback": flag("fallback"),
            "failed": flag("failed"),
        },
    )
    whole = log.agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    start, total = whole.select("start").scalar(), whole.select("n").scalar()
    return (
        counted.withColumns({"start": start, "total": total})
        .where((F.col("completed") % every == 0) | (F.col("completed") == F.col("total")))
        .select(
            "completed",
            percent(F.col("completed"), F.col("total")).alias("percent_done"),
            quotient(F.col("completed"), seconds_between(F.col("start"), F.col("ts"))).alias("speed"),
            "success",
            "fallback",
            "failed",
        )
        .orderBy("completed")
    )
