"""Query-log and session-log reports with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import fixed
from orderloom.operators import rollups, workload
from orderloom.registry.core import Registry

registry = Registry()
add = registry.add

NOW = "2024-01-31 00:00:00"
_SECONDS = f"date_diff('microsecond', query_start, timestamp '{NOW}') / 1e6"

add(
    "w01_most_frequent",
    lambda t: workload.most_frequent(t.v_query_log),
    """select query_id, query, calls, total_time, mean_time, max_time, rows from v_query_log
       order by calls desc nulls first, query_id limit 20""",
    doubles="total_time mean_time max_time",
)
add(
    "w02_slowest",
    lambda t: workload.slowest(t.v_query_log, min_calls=2),
    """select query_id, query, calls, total_time, mean_time, max_time, min_time, stddev_time
       from v_query_log where calls > 2 order by mean_time desc nulls first, query_id limit 20""",
    doubles="total_time mean_time max_time min_time stddev_time",
)
add(
    "w03_heaviest",
    lambda t: workload.heaviest(t.v_query_log),
    """select query_id, query, calls, total_time, mean_time, total_time / 1000 / 60 as total_minutes, rows
       from v_query_log order by total_time desc nulls first, query_id limit 20""",
    doubles="total_time mean_time total_minutes",
)
add(
    "w04_performance_trend",
    lambda t: workload.performance_trend(t.v_query_log, min_calls=2),
    "select query_id, query, calls, total_time, mean_time, rows from v_query_log where calls > 2",
    doubles="total_time mean_time",
)
add(
    "w05_active_sessions",
    lambda t: workload.active_sessions(t.v_sessions, now=NOW, exclude="select 1"),
    f"""select *, {_SECONDS} as duration from v_sessions
        where state <> 'idle' and query not like '%select 1%'""",
    doubles="duration",
    digits=6,
)
add(
    "w06_long_running_sessions",
    lambda t: workload.long_running_sessions(t.v_sessions, now=NOW, minutes=10_000),
    f"""select * from (select *, {_SECONDS} as duration from v_sessions where state <> 'idle') timed
        where duration > 600000""",
    doubles="duration",
    digits=6,
)
add(
    "w07_waiting_sessions",
    lambda t: workload.waiting_sessions(t.v_sessions),
    "select * from v_sessions where waiting",
)
_BASELINE_SPARK = """
    select query_id, case when query_id % 11 = 0 then 0.0 else mean_time / (1 + query_id % 3) end
               as baseline_mean_time
    from {v_query_log} where query_id % 5 > 0"""
add(
    "w08_regressions",
    lambda t: workload.regressions(
        t.v_query_log, t.spark.sql(_BASELINE_SPARK, v_query_log=t.v_query_log)
    ),
    """select q.query_id as queryid, substring(q.query, 1, 100) as query_sample, q.calls, q.mean_time,
              q.total_time, b.baseline_mean_time, q.mean_time - b.baseline_mean_time as time_diff,
              (q.mean_time - b.baseline_mean_time) / nullif(b.baseline_mean_time, 0) * 100
                  as performance_change_percent
       from v_query_log q join baseline b on b.query_id = q.query_id
       where q.mean_time > b.baseline_mean_time * 1.5""",
    doubles="mean_time total_time baseline_mean_time time_diff performance_change_percent",
    digits=6,
    named=(("baseline", _BASELINE_SPARK.replace("{v_query_log}", "v_query_log")),),
)
add(
    "w09_daily_activity",
    lambda t: workload.daily_activity(t.v_sessions, now=NOW, as_of="2024-01-31"),
    f"""select cast(date_trunc('day', query_start) as timestamp) as report_date, count(*) as total_queries,
               avg({_SECONDS}) as avg_query_duration, max({_SECONDS}) as max_query_duration,
               cast(sum(case when state = 'active' then 1 else 0 end) as bigint) as active_queries,
               cast(sum(case when waiting then 1 else 0 end) as bigint) as waiting_queries
        from v_sessions where query_start >= timestamp '2024-01-24' group by 1""",
    doubles="avg_query_duration max_query_duration",
)
add(
    "w10_query_patterns",
    lambda t: workload.query_patterns(t.v_query_log, min_calls=2),
    r"""select regexp_replace(query, '\d+', 'N') as query_pattern, count(*) as pattern_count,
               avg(mean_time) as avg_pattern_time, sum(total_time) as total_pattern_time
        from v_query_log where calls > 2 group by 1 order by pattern_count desc, query_pattern limit 20""",
    doubles="avg_pattern_time total_pattern_time",
)
_PRIORITIES = " ".join(
    f"when calls > {calls} and mean_time > {mean} then '{label}'" for label, calls, mean in fixed.PRIORITIES
)
add(
    "w11_impact_ranking",
    lambda t: workload.impact_ranking(t.v_query_log, min_calls=2),
    f"""select query_id as queryid, substring(query, 1, 100) as query_sample, calls as frequency,
              mean_time as avg_duration, total_time as total_duration, calls * mean_time as impact_score,
              case {_PRIORITIES} else 'LOW' end as optimization_priority
       from v_query_log where calls > 2""",
    doubles="avg_duration total_duration impact_score",
)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " union all ".join(
        f"""select '{c}' as column_name, count(distinct {c}) as distinct_values,
            avg(case when {c} is null then 1.0 else 0.0 end) as null_fraction,
            avg(cast({width} as double)) as avg_column_width, cast(null as double) as column_correlation
            from {table}"""
        for c, width in columns.items()
    )


_PROFILED = {
    "id": "8",
    "user_id": "case when user_id is not null then 8 end",
    "product_id": "8",
    "created_at": "8",
}
add(
    "w12_column_profile",
    lambda t: workload.column_profile(t.v_views, list(_PROFILED), exact=True),
    _profile_sql("v_views", _PROFILED),
    doubles="null_fraction avg_column_width column_correlation",
)
add(
    "w12_text_column_profile",
    lambda t: workload.column_profile(t.documents, ["lang", "source", "text"], exact=True),
    _profile_sql("documents", {c: f"octet_length(encode({c}))" for c in ("lang", "source", "text")}),
    doubles="null_fraction avg_column_width column_correlation",
)


def _correlation_sql(table: str, column: str, order_by: str) -> str:
    return f"""
        select corr(rv, rp) as column_correlation from (
            select rank() over (order by {column}) + (count(*) over (partition by {column}) - 1) / 2.0 as rv,
                   rank() over (order by {order_by})
                       + (count(*) over (partition by {order_by}) - 1) / 2.0 as rp
            from {table} where {column} is not null and {order_by} is not null) ranked"""


for _name, _table, _column, _order in (
    ("w12_correlation_of_amount", "v_orders", "total_amount", "created_at"),
    ("w12_correlation_of_name", "v_users", "name", "id"),
    ("w12_correlation_of_user", "v_views", "user_id", "created_at"),
):
    add(
        _name,
        lambda t, table=_table, column=_column, order=_order: workload.order_correlation(
            t[table], column, order
        ),
        _correlation_sql(_table, _column, _order),
        doubles="column_correlation",
    )

add(
    "w12_profile_with_order",
    lambda t: workload.column_profile(t.v_orders, ["total_amount", "user_id"], exact=True, order_by="created_at"),
    " union all ".join(
        f"""select '{c}' as column_name, count(distinct {c}) as distinct_values, 0.0 as null_fraction,
                   8.0 as avg_column_width, ({_correlation_sql("v_orders", c, "created_at")}) as column_correlation
            from v_orders"""
        for c in ("total_amount", "user_id")
    ),
    doubles="null_fraction avg_column_width column_correlation",
)


def _near_sketch(t):
    """Per column: whether the sketched number of values is within a fifth of the exact one; shares and widths as they are."""
    columns = list(_PROFILED)
    sketch = workload.column_profile(t.v_views, columns).withColumnRenamed("distinct_values", "sketched")
    exact = workload.column_profile(t.v_views, columns, exact=True).select("column_name", "distinct_values")
    near = F.abs(F.col("sketched") - F.col("distinct_values")) <= F.col("distinct_values") / 5
    return sketch.join(exact, "column_name").select("column_name", near.alias("near"), "null_fraction", "avg_column_width")


add(
    "w12_sketched_profile",
    _near_sketch,
    f"""select column_name, true as near, null_fraction, avg_column_width
        from ({_profile_sql("v_views", _PROFILED)}) profile""",
    doubles="null_fraction avg_column_width",
)


def _rolled_up(t):
    """Profile of all days from sketches per day: whether distinct counts are within the stated error of the exact ones."""
    columns = list(_PROFILED)
    rolled = rollups.rolled_up_profile(rollups.profile_rollup(t.v_views, columns, ts="created_at"))
    exact = workload.column_profile(t.v_views, columns, exact=True).select("column_name", F.col("distinct_values").alias("known"))
    near = F.abs(F.col("distinct_values") - F.col("known")) <= F.ceil(F.col("known") * F.lit(rollups.distinct_error()))
    return rolled.join(exact, "column_name").select("column_name", near.alias("near"), "null_fraction", "avg_column_width")


add(
    "w12_rolled_up_profile",
    _rolled_up,
    f"""select column_name, true as near, null_fraction, avg_column_width
        from ({_profile_sql("v_views", _PROFILED)}) profile""",
    doubles="null_fraction avg_column_width",
)
add(
    "w13_selective_columns",
    lambda t: workload.selective_columns(
        workload.column_profile(t.v_views, list(_PROFILED), exact=True), min_distinct=90
    ),
    f"""select * from ({_profile_sql("v_views", _PROFILED)}) profile
        where distinct_values > 90 and null_fraction < 0.1""",
    doubles="null_fraction avg_column_width column_correlation",
)
_COUNTERS_SPARK = """
    select user_id, sum(case when event_type = 'view' then 1 else 0 end) as hits,
           sum(case when event_type = 'error' then 1 else 0 end) as misses
    from {v_events} group by user_id, product_id"""
for _name, _empty in (("w14_hit_ratio", 0.0), ("w14_hit_ratio_else_100", 100.0)):
    add(
        _name,
        lambda t, empty=_empty: workload.safe_ratio(
            t.spark.sql(_COUNTERS_SPARK, v_events=t.v_events), "hits", "misses", empty=empty
        ),
        f"""select user_id, cast(hits as bigint) as hits, cast(misses as bigint) as misses,
                   case when hits + misses > 0 then cast(hits as double) / (hits + misses) * 100
                        else {_empty} end as ratio
            from counters""",
        doubles="ratio",
        named=(("counters", _COUNTERS_SPARK.replace("{v_events}", "v_events")),),
    )
