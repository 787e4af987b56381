"""Rankings, regressions and reports over query logs and session logs.

A query log has one row per query: query_id, query, calls, total_time, mean_time,
min_time, max_time, stddev_time, rows. A session log has one row per session:
pid, state, waiting, query_start, query and any further columns. Times are in
milliseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions import fixed
from orderloom.functions.scalars import (
    Day,
    flag_sum,
    mask_first_number,
    midnight,
    quotient,
    seconds_between,
    top_rows,
)
from orderloom.operators.ordered import value_rank
from orderloom.session import stored

SAMPLE_LENGTH = 100


def _instant(value: datetime | str) -> Column:
    return F.lit(value if isinstance(value, str) else value.isoformat(sep=" ")).cast("timestamp_ntz")


def most_frequent(log: DataFrame, top: int = 20) -> DataFrame:
    kept = log.select("query_id", "query", "calls", "total_time", "mean_time", "max_time", "rows")
    return top_rows(kept, top, F.col("calls").desc_nulls_first(), F.col("query_id"))


def slowest(log: DataFrame, *, min_calls: int = 10, top: int = 20) -> DataFrame:
    kept = log.where(F.col("calls") > min_calls).select(
        "query_id", "query", "calls", "total_time", "mean_time", "max_time", "min_time", "stddev_time"
    )
    return top_rows(kept, top, F.col("mean_time").desc_nulls_first(), F.col("query_id"))


def heaviest(log: DataFrame, top: int = 20) -> DataFrame:
    kept = log.select(
        "query_id",
        "query",
        "calls",
        "total_time",
        "mean_time",
        (F.col("total_time") / 1000 / 60).alias("total_minutes"),
        "rows",
    )
    return top_rows(kept, top, F.col("total_time").desc_nulls_first(), F.col("query_id"))


def performance_trend(log: DataFrame, *, min_calls: int = 5) -> DataFrame:
    """Queries called often enough to compare; register it with ``named_view``."""
    return log.where(F.col("calls") > min_calls).select(
        "query_id", "query", "calls", "total_time", "mean_time", "rows"
    )


def active_sessions(
    sessions: DataFrame, *, now: datetime | str, exclude: str | None = None, min_seconds: float = 0.0
) -> DataFrame:
    """Sessions that are not idle with their duration in seconds, longest first.

    ``exclude`` drops queries that contain a text, such as the monitor's own.
    """
    kept = sessions.where(F.col("state") != "idle")
    if exclude is not None:
        kept = kept.where(~F.col("query").contains(exclude))
    timed = kept.withColumn("duration", seconds_between(F.col("query_start"), _instant(now)))
    if min_seconds:
        timed = timed.where(F.col("duration") > min_seconds)
    return timed.orderBy(F.col("duration").desc_nulls_first(), "pid")


def long_running_sessions(
    sessions: DataFrame, *, now: datetime | str, minutes: float = 5
) -> DataFrame:
    return active_sessions(sessions, now=now, min_seconds=minutes * 60)


def waiting_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("waiting")).orderBy("query_start", "pid")


def regressions(log: DataFrame, baseline: DataFrame, *, factor: float = 1.5) -> DataFrame:
    """Queries slower than their baseline by a factor, worst first.

    A zero baseline has no percentage.
    """
    base, mean = F.col("baseline_mean_time"), F.col("mean_time")
    known = baseline.where(base.isNotNull()).select("query_id", base)
    return (
        log.join(known, "query_id")
        .where(mean > base * factor)
        .select(
            F.col("query_id").alias("queryid"),
            F.substring("query", 1, SAMPLE_LENGTH).alias("query_sample"),
            "calls",
            "mean_time",
            "total_time",
            "baseline_mean_time",
            (mean - base).alias("time_diff"),
            (quotient(mean - base, base) * 100).alias("performance_change_percent"),
        )
        .orderBy(F.col("performance_change_percent").desc_nulls_first(), "queryid")
    )


def baseline_of(log: DataFrame, *, recorded_at: datetime | str) -> DataFrame:
    """Baseline rows of the current log, ready to be appended to a baseline table."""
    return log.select(
        "query_id",
        F.md5("query").alias("query_hash"),
        F.col("query").alias("query_sample"),
        F.col("mean_time").cast("double").alias("baseline_mean_time"),
        F.col("calls").cast("int").alias("baseline_calls"),
        F.col("total_time").cast("double").alias("baseline_total_time"),
        _instant(recorded_at).alias("recorded_at"),
    )


def daily_activity(sessions: DataFrame, *, now: datetime | str, as_of: Day, days: int = 7) -> DataFrame:
    """Queries, durations and states per day of the last days, newest day first."""
    duration = seconds_between(F.col("query_start"), _instant(now))
    return (
        sessions.where(F.col("query_start") >= midnight(as_of, days))
        .groupBy(F.to_date("query_start").cast("timestamp_ntz").alias("report_date"))
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.avg(duration).alias("avg_query_duration"),
            F.max(duration).alias("max_query_duration"),
            flag_sum(F.col("state") == "active").alias("active_queries"),
            flag_sum(F.col("waiting")).alias("waiting_queries"),
        )
        .orderBy(F.col("report_date").desc())
    )


def query_patterns(log: DataFrame, *, min_calls: int = 10, top: int = 20) -> DataFrame:
    """Queries grouped by their text with the first number masked."""
    grouped = (
        log.where(F.col("calls") > min_calls)
        .groupBy(mask_first_number(F.col("query")).alias("query_pattern"))
        .agg(
            F.count(F.lit(1)).alias("pattern_count"),
            F.avg("mean_time").alias("avg_pattern_time"),
            F.sum("total_time").alias("total_pattern_time"),
        )
    )
    return top_rows(grouped, top, F.col("pattern_count").desc(), F.col("query_pattern"))


def impact_ranking(log: DataFrame, *, min_calls: int = 10) -> DataFrame:
    """Queries by calls times mean time, with a priority."""
    calls, mean = F.col("calls"), F.col("mean_time")
    priority = F.lit("LOW")
    for label, least_calls, least_mean in reversed(fixed.PRIORITIES):
        priority = F.when((calls > least_calls) & (mean > least_mean), label).otherwise(priority)
    return (
        log.where(calls > min_calls)
        .select(
            F.col("query_id").alias("queryid"),
            F.substring("query", 1, SAMPLE_LENGTH).alias("query_sample"),
            calls.alias("frequency"),
            mean.alias("avg_duration"),
            F.col("total_time").alias("total_duration"),
            (calls * mean).alias("impact_score"),
            priority.alias("optimization_priority"),
        )
        .orderBy(F.col("impact_score").desc_nulls_first(), "queryid")
    )


def value_width(df: DataFrame, column: str) -> Column:
    """Bytes of a value in storage; of texts their own, of other types a fixed number."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(F.col(column))
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(kind, T.DecimalType):
        return F.lit(8 if kind.precision <= 18 else 16)
    return F.lit(fixed.get(type(kind), 8))


def _key(df: DataFrame, column: str) -> Column:
    """Text that tells the values of a column apart; long values by their digest, and zero has no sign."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.md5(c.cast("binary"))
    return (c + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else c).cast("string")


def _exact_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value of every column is one narrow row, counted per column and value before the shuffle."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), _key(df, c).alias("key"), value_width(df, c).cast("double").alias("width"))
        for c in columns
    ]
    values = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.column_name", "e.key")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("e.width").alias("width"))
    )
    known = F.when(F.col("key").isNotNull(), F.col("rows"))
    profile = values.groupBy("column_name").agg(
        F.count("key").alias("distinct_values"),
        ((F.sum("rows") - F.coalesce(F.sum(known), F.lit(0))) / F.sum("rows")).alias("null_fraction"),
        (F.sum(known * F.col("width")) / F.sum(known)).alias("avg_column_width"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(profile, "column_name", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0)).cast("bigint")
    )


def _sketched_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All measures of all columns in one aggregation, with sketches of the distinct counts."""
    measures = []
    for i, c in enumerate(columns):
        column = F.col(c)
        measures += [
            F.approx_count_distinct(column).alias(f"d{i}"),
            F.avg(F.when(column.isNull(), 1.0).otherwise(0.0)).alias(f"n{i}"),
            F.avg(F.when(column.isNotNull(), value_width(df, c)).cast("double")).alias(f"w{i}"),
        ]
    entries = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"d{i}").cast("bigint").alias("distinct_values"),
                F.col(f"n{i}").alias("null_fraction"),
                F.col(f"w{i}").alias("avg_column_width"),
            )
            for i, c in enumerate(columns)
        )
    )
    return df.agg(*measures).select(F.inline(entries))


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    exact: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """Distinct values, share of nulls and mean width per column.

    Distinct counts are sketches unless ``exact``. With ``order_by`` the profile
    also has the correlation between the rank of a row in that order and the
    rank of the value; without it that column is null.
    """
    columns = list(columns or df.columns)
    profile = (_exact_profile if exact else _sketched_profile)(df, columns)
    if order_by is None:
        return profile.withColumn("column_correlation", F.lit(None).cast("double"))
    places = stored(value_rank(df, order_by), "places")
    correlations = None
    for c in columns:
        one = _correlation(df, c, order_by, places).select(F.lit(c).alias("column_name"), "column_correlation")
        correlations = one if correlations is None else correlations.unionByName(one)
    return profile.join(correlations, "column_name", "left")


def order_correlation(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Correlation between the rank of ``order_by`` and the rank of a column, one row.

    Ties share the mean of their ranks. Rows where either is null are left out.
    """
    return _correlation(df, column, order_by, None)


def _correlation(df: DataFrame, column: str, order_by: str, places: DataFrame | None) -> DataFrame:
    """``places`` has the ranks of ``order_by`` over all its values; they hold if the column has no nulls there."""
    both = df.where(F.col(column).isNotNull() & F.col(order_by).isNotNull())
    pairs = stored(
        both.groupBy(F.col(column).alias("value"), F.col(order_by).alias("position")).agg(F.count(F.lit(1)).alias("copies")),
        "pairs",
    )
    total = pairs.agg(F.sum("copies").alias("n")).first()["n"]
    if places is None or df.where(F.col(order_by).isNotNull()).count() != total:
        places = value_rank(pairs, "position", copies="copies")
    else:
        places = places.withColumnRenamed(order_by, "position")
    ranked = pairs.join(value_rank(pairs, "value", copies="copies").withColumnRenamed("rank", "value_rank"), "value").join(
        places.withColumnRenamed("rank", "position_rank"), "position"
    )
    weight = F.col("copies").cast("double")
    # Around the mean rank, so that the sums of squares do not cancel.
    mean = F.lit(((total or 0) + 1) / 2.0)
    dx, dy = F.col("value_rank") - mean, F.col("position_rank") - mean
    return ranked.agg(
        (
            F.sum(weight * dx * dy)
            / F.nullif(F.sqrt(F.sum(weight * dx * dx) * F.sum(weight * dy * dy)), F.lit(0.0))
        ).alias("column_correlation")
    )


def selective_columns(
    profile: DataFrame, *, min_distinct: int = 100, max_null_fraction: float = 0.1
) -> DataFrame:
    """Columns worth partitioning or bucketing by, most distinct values first."""
    return profile.where(
        (F.col("distinct_values") > min_distinct) & (F.col("null_fraction") < max_null_fraction)
    ).orderBy(F.col("distinct_values").desc(), "column_name")


def safe_ratio(
    df: DataFrame, hit: str, miss: str, *, empty: float = 0.0, name: str = "ratio"
) -> DataFrame:
    """Add the percentage of hits among hits and misses; ``empty`` when there are none."""
    both = F.col(hit) + F.col(miss)
    return df.withColumn(
        name, F.when(both > 0, F.col(hit).cast("double") / both * 100).otherwise(F.lit(float(empty)))
    )
