"""Request-log metrics with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.operators import requests, rollups
from orderloom.registry.core import Registry

registry = Registry()
add = registry.add

# Bodies as a client would see them: fallback, other JSON, empty, or broken.
_BODIES_SPARK = """
    select id, event_type = 'error' as failed,
           case when id % 5 = 0 then '{{"status": "fallback"}}' when id % 5 = 1 then props
                when id % 5 = 2 then '' when id % 5 = 3 then '{{"broken' end as body
    from (select event_id as id, event_type, props from {events}) e"""
add(
    "l01_outcome",
    lambda t: t.spark.sql(_BODIES_SPARK, events=t.events).select(
        "id", requests.outcome(F.col("failed"), F.col("body")).alias("status")
    ),
    """select id, case when failed or id % 5 = 3 then 'failed' when id % 5 = 0 then 'fallback'
                       else 'success' end as status
       from (select event_id as id, event_type = 'error' as failed from events) e""",
)
add(
    "l02_base_endpoint",
    lambda t: t.pages.select("page_id", requests.base_endpoint(F.col("url")).alias("endpoint")).unionByName(
        t.v_requests.select(
            F.col("request_id").alias("page_id"),
            requests.base_endpoint(F.concat("endpoint", F.lit("/7"))).alias("endpoint"),
        )
    ),
    """select page_id, case when contains(url, 'products') then '/api/products'
                            when contains(url, 'users') then '/api/users' else '/api/orders' end as endpoint
       from (select page_id, url from pages union all select request_id, endpoint from v_requests) u""",
)

_MEASURES = """count(*) as total,
    count(*) filter (status = 'success') as success, count(*) filter (status = 'fallback') as fallback,
    count(*) filter (status = 'failed') as failed,
    count(*) filter (status = 'success') * 100.0 / count(*) as success_pct,
    count(*) filter (status = 'fallback') * 100.0 / count(*) as fallback_pct,
    count(*) filter (status = 'failed') * 100.0 / count(*) as failed_pct,
    count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0) as rps,
    avg(latency_ms) as avg_latency"""
_DOUBLES = "success_pct fallback_pct failed_pct rps avg_latency p95_latency"


def _p95(groups: str) -> str:
    """Exclusive 95th percentile by sorting whole groups."""
    over = f"partition by {groups}" if groups else ""
    columns = f"{groups}, " if groups else ""
    tail = f"group by {groups}, n" if groups else "group by n"
    return f"""
        select {columns}sum(latency_ms * case when place = cut then 20 - (19 * (n + 1) - cut * 20)
                                       else 19 * (n + 1) - cut * 20 end) / 20 as p95
        from (select *, greatest(1, least(19 * (n + 1) // 20, n - 1)) as cut
              from (select *, row_number() over ({over} order by latency_ms) as place,
                           count(*) over ({over}) as n from v_requests) numbered) placed
        where place in (cut, cut + 1) {tail}"""


add(
    "l03_overall_summary",
    lambda t: requests.latency_summary(t.v_requests),
    f"""select m.*, case when m.total > 20 then p.p95 else m.avg_latency end as p95_latency
        from (select {_MEASURES} from v_requests) m, ({_p95('')}) p""",
    doubles=_DOUBLES,
)
_PER_ENDPOINT = f"""select m.*, case when m.total > 20 then p.p95 else m.avg_latency end as p95_latency
        from (select endpoint, {_MEASURES} from v_requests group by endpoint) m
        join ({_p95('endpoint')}) p on p.endpoint = m.endpoint"""
add(
    "l04_default_p95_per_endpoint",
    lambda t: requests.latency_summary(t.v_requests, "endpoint"),
    _PER_ENDPOINT,
    doubles=_DOUBLES,
)
# A coarse sketch, so that the bracket is in use at small scale as well.
add(
    "l04_exact_p95",
    lambda t: requests.latency_summary(t.v_requests, accuracy=200),
    f"""select m.*, case when m.total > 20 then p.p95 else m.avg_latency end as p95_latency
        from (select {_MEASURES} from v_requests) m, ({_p95('')}) p""",
    doubles=_DOUBLES,
)
add(
    "l04_exact_p95_per_endpoint",
    lambda t: requests.latency_summary(t.v_requests, "endpoint", accuracy=200),
    _PER_ENDPOINT,
    doubles=_DOUBLES,
)


def _sketch_error(t, accuracy: int = 100):
    """Per endpoint: whether the rank of the sketched value is within the sketch's stated error."""
    sketch = requests.approximate_p95(t.v_requests, ["endpoint"], accuracy)
    below = F.sum((F.col("latency_ms") < F.col("p95_latency")).cast("bigint"))
    upto = F.sum((F.col("latency_ms") <= F.col("p95_latency")).cast("bigint"))
    n = F.count("latency_ms")
    allowed = n / accuracy + 1
    near = (below - allowed <= 0.95 * n) & (0.95 * n <= upto + allowed)
    return t.v_requests.join(sketch, "endpoint").groupBy("endpoint").agg(near.alias("within_error"))


add(
    "l04_approximate_p95",
    _sketch_error,
    "select distinct endpoint, true as within_error from v_requests",
)


def _rolled_up_error(t):
    """Per endpoint, from sketches per minute: counts, and whether the rank of the p95 is within twice the stated error."""
    rolled = rollups.rolled_up_latency(rollups.latency_rollup(t.v_requests))
    latency, p95, n = F.col("latency_ms"), F.col("p95_latency"), F.count("latency_ms")
    allowed = n * (2 * rollups.quantile_rank_error()) + 1
    near = (F.count_if(latency < p95) - allowed <= 0.95 * n) & (0.95 * n <= F.count_if(latency <= p95) + allowed)
    counts = ["calls", "success", "fallback", "failed"]
    return t.v_requests.select("endpoint", "latency_ms").join(rolled, "endpoint").groupBy("endpoint", *counts).agg(near.alias("near"))


add(
    "l04_rolled_up_p95",
    _rolled_up_error,
    """select endpoint, count(*) as calls, count(*) filter (status = 'success') as success,
              count(*) filter (status = 'fallback') as fallback,
              count(*) filter (status = 'failed') as failed, true as near
       from v_requests group by endpoint""",
)
add(
    "l05_endpoint_summary",
    lambda t: requests.endpoint_summary(t.v_requests),
    """select endpoint, count(*) filter (status = 'success') as success,
              count(*) filter (status = 'fallback') as fallback,
              count(*) filter (status = 'failed') as failed, avg(latency_ms) as avg_latency
       from v_requests group by endpoint""",
    doubles="avg_latency",
)
_ROLLED = """select service, ts, request_id, failures * 10.0 as failure_rate, failures >= 3 as breached
       from (select endpoint as service, ts, request_id,
                    row_number() over (partition by endpoint order by ts, request_id) as place,
                    sum(case when status in ('failed', 'fallback') then 1 else 0 end) over (
                        partition by endpoint order by ts, request_id
                        rows between 9 preceding and current row) as failures
             from v_requests) rolled
       where place >= 10"""
# Short blocks as well, so that windows cross their borders at small scale.
for _name, _options in (("l06_default_failure_rate", {}), ("l06_rolling_failure_rate", {"block": 64})):
    add(
        _name,
        lambda t, options=_options: requests.rolling_failure_rate(
            t.v_requests.withColumnRenamed("endpoint", "service"), threshold=30.0, **options
        ),
        _ROLLED,
        doubles="failure_rate",
    )
add(
    "l07_service_dependencies",
    lambda t: requests.service_dependencies(t.v_spans),
    """select p.service as parent, c.service as child, count(*) as "callCount"
       from v_spans c join v_spans p on p.span_id = c.parent_span_id group by 1, 2""",
)
add(
    "l08_progress_series",
    lambda t: requests.progress_series(t.v_requests),
    """select completed, completed * 100.0 / total as percent_done,
              completed / nullif(date_diff('microsecond', first_ts, ts) / 1e6, 0) as speed,
              cast(success as bigint) as success, cast(fallback as bigint) as fallback,
              cast(failed as bigint) as failed
       from (select ts, row_number() over arrived as completed, count(*) over () as total,
                    min(ts) over () as first_ts,
                    sum(case when status = 'success' then 1 else 0 end) over arrived as success,
                    sum(case when status = 'fallback' then 1 else 0 end) over arrived as fallback,
                    sum(case when status = 'failed' then 1 else 0 end) over arrived as failed
             from v_requests
             window arrived as (order by ts, request_id rows unbounded preceding)) counted
       where completed % 100 = 0 or completed = total""",
    doubles="percent_done speed",
)
