"""Mergeable summaries, kept per minute or day and merged to any range without the rows behind them.

Latencies are quantile sketches, distinct values are counting sketches, both
with a stated error. Shares of nulls, widths and counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.scalars import minute_index
from orderloom.operators.workload import value_width

QUANTILE_SIZE = 400
DISTINCT_BITS = 12


def quantile_rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far, as a share of all values, the rank of a sketched quantile may be off, 99 times in 100."""
    return 2.296 / size**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Three relative standard errors of a sketched number of values."""
    return 3 * 1.04 / 2 ** (bits / 2)


def latency_rollup(log: DataFrame, *, size: int = QUANTILE_SIZE) -> DataFrame:
    """Calls, failures and a sketch of the latencies per endpoint and minute.

    Sketches are built before the shuffle, so a busy endpoint sends one row per
    task and minute.
    """
    status = F.col("status")
    minute = F.timestamp_add("MINUTE", minute_index(F.col("ts")), F.lit("1970-01-01").cast("timestamp_ntz"))
    return log.groupBy("endpoint", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status == "fallback").alias("fallback"),
        F.count_if(status == "failed").alias("failed"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), size).alias("latencies"),
    )


def rolled_up_latency(
    rollup: DataFrame,
    by: Sequence[str] = ("endpoint",),
    *,
    start: Column | None = None,
    end: Column | None = None,
    quantile: float = 0.95,
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """Counts and the sketched quantile of the minutes from ``start`` to before ``end``; null without latencies."""
    if start is not None:
        rollup = rollup.where(F.col("minute") >= start)
    if end is not None:
        rollup = rollup.where(F.col("minute") < end)
    counts = [F.sum(c).alias(c) for c in ("calls", "success", "fallback", "failed")]
    merged = rollup.groupBy(*by).agg(*counts, F.kll_merge_agg_double("latencies", size).alias("latencies"))
    measured = F.kll_sketch_get_n_double("latencies") > 0
    value = F.when(measured, F.kll_sketch_get_quantile_double("latencies", F.lit(quantile)))
    return merged.withColumn(f"p{round(quantile * 100)}_latency", value).drop("latencies")


def profile_rollup(df: DataFrame, columns: Sequence[str], *, ts: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """Per day and column: rows, nulls, summed width, and a sketch of the values, found in one pass.

    Rows without a time have a day of their own, null.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        measures += [
            F.count_if(F.col(c).isNull()).alias(f"n{i}"),
            F.sum(F.when(F.col(c).isNotNull(), value_width(df, c)).cast("bigint")).alias(f"w{i}"),
            F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"d{i}"),
        ]
    entries = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows"),
                F.col(f"n{i}").alias("nulls"),
                F.coalesce(f"w{i}", F.lit(0).cast("bigint")).alias("width"),
                F.col(f"d{i}").alias("values"),
            )
            for i, c in enumerate(columns)
        )
    )
    return df.groupBy(F.to_date(ts).alias("day")).agg(*measures).select("day", F.inline(entries))


def rolled_up_profile(rollup: DataFrame, *, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Distinct values, share of nulls and mean width per column over the days from ``first`` to ``last``."""
    if first is not None:
        rollup = rollup.where(F.col("day") >= first)
    if last is not None:
        rollup = rollup.where(F.col("day") <= last)
    rows, nulls = F.sum("rows"), F.sum("nulls")
    return rollup.groupBy("column_name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"),
        (nulls.cast("double") / rows).alias("null_fraction"),
        (F.sum("width").cast("double") / F.nullif(rows - nulls, F.lit(0))).alias("avg_column_width"),
    )
