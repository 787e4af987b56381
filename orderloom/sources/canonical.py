"""Commerce tables derived from the star-schema test data.

The test data has no reviews, views or searches, so each commerce table is a
fixed projection of it. The same text runs in Spark and in DuckDB; only the
tokens below differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKENS = {
    "spark": {
        "JSON_K": "cast(get_json_object(props, '$.k') as bigint)",
        "NAIVE": "timestamp_ntz",
    },
    "duckdb": {
        "JSON_K": "cast(json_extract_string(props, '$.k') as bigint)",
        "NAIVE": "timestamp",
    },
}

# Each {name} is a source table or another view.
VIEWS = {
    "v_users": """
        select c_custkey as id, c_name as name,
               concat('user', cast(c_custkey as string), '@example.com') as email,
               c_mktsegment as tier,
               case when c_acctbal >= 0 then 'ACTIVE' else 'INACTIVE' end as status,
               cast(date'1995-01-01' + cast((c_custkey * 37) % 730 as int) as NAIVE) as registration_date
        from {customer}""",
    "v_orders": """
        select o_orderkey as id, o_custkey as user_id,
               case when o_orderstatus = 'F' then 'DELIVERED'
                    when o_orderstatus = 'O' then 'PROCESSING'
                    when o_orderpriority = '5-LOW' then 'CANCELLED'
                    else 'PENDING' end as status,
               cast(o_totalprice as decimal(12,2)) as total_amount,
               o_orderdate as created_at
        from {orders}""",
    "v_order_items": """
        select l_orderkey * 10 + l_linenumber as id, l_orderkey as order_id,
               l_partkey as product_id, cast(l_quantity as int) as quantity,
               cast(l_extendedprice as decimal(12,2)) as total_price
        from {lineitem}""",
    "v_products": """
        select p_partkey as id, p_name as name, p_type as category_id, p_brand as brand_id,
               cast(p_retailprice as decimal(10,2)) as price, p_size * 20 as stock_quantity,
               case when p_partkey % 3 = 0 then 'INACTIVE' else 'ACTIVE' end as status
        from {part}""",
    "v_categories": "select distinct p_type as id, p_type as name from {part}",
    "v_brands": "select distinct p_brand as id, p_brand as name from {part}",
    "v_reviews": """
        select l_orderkey * 10 + l_linenumber as id, l_partkey as product_id,
               cast(1 + (l_orderkey + l_linenumber) % 5 as int) as rating,
               case when l_returnflag = 'R' then 'PENDING' else 'APPROVED' end as status
        from {lineitem}""",
    "v_events": """
        select event_id as id, ts as created_at, user_id, event_type, value,
               JSON_K as product_id
        from {events}""",
    "v_views": """
        select id, product_id, case when id % 10 < 3 then null else user_id end as user_id, created_at
        from {v_events} where event_type = 'view'""",
    "v_cart": """
        select id, user_id, product_id, created_at from {v_events} where event_type = 'click'""",
    "v_purchases": """
        select id, user_id, product_id, created_at from {v_events} where event_type = 'purchase'""",
    "v_search": """
        select id, user_id, concat('k', cast(product_id as string)) as search_query,
               cast(floor(value) as int) as results_count,
               case when event_type = 'click' then product_id end as clicked_product_id, created_at
        from {v_events} where event_type in ('view', 'click')""",
    "v_requests": """
        select id as request_id, created_at as ts,
               case when event_type in ('view', 'click') then '/api/products'
                    when event_type = 'signup' then '/api/users' else '/api/orders' end as endpoint,
               case when event_type = 'error' then 'failed'
                    when value > 100 then 'fallback' else 'success' end as status,
               value as latency_ms
        from {v_events}""",
    # Some figures are missing, for lists that put them first.
    "v_query_log": """
        select min(id) as query_id,
               concat('select ', cast(product_id as string), ' from ', event_type,
                      cast(user_id % 10 as string)) as query,
               case when min(id) % 103 <> 1 then count(*) end as calls,
               case when min(id) % 101 <> 2 then round(sum(value), 4) end as total_time,
               case when min(id) % 97 <> 3 then round(avg(value), 4) end as mean_time,
               min(value) as min_time, max(value) as max_time,
               round(stddev_samp(value), 4) as stddev_time, count(*) * 10 as rows
        from {v_events} group by product_id, event_type, user_id % 10""",
    "v_sessions": """
        select id as pid, user_id, case when event_type = 'signup' then 'idle' else 'active' end as state,
               event_type = 'error' as waiting,
               case when id % 53 > 0 then created_at end as query_start,
               concat('select ', cast(product_id as string)) as query
        from {v_events}""",
    # One span per event; every span but the first hangs below an earlier one.
    "v_spans": """
        select id as span_id, case when id > 0 then cast(floor(id / 3) as bigint) end as parent_span_id,
               concat(event_type, '-service') as service
        from {v_events}""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def _render(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for token, value in _TOKENS[dialect].items():
        text = text.replace(token, value)
    return text


class CanonicalTables:
    """Lazy access to source tables and derived views of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                text = _render(name, "spark")
                inputs = {ref: self[ref] for ref in _REFERENCE.findall(text)}
                self._cache[name] = self.spark.sql(text, **inputs)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._cache[name]


def duckdb_with(body: str, *extra: tuple[str, str]) -> str:
    """Prefix a DuckDB query with the views that it names, in dependency order.

    ``extra`` are further named subqueries, placed after the views.
    """
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in ordered:
                need(_render(name, "duckdb"))
                ordered.append(name)

    for _, text in extra:
        need(text)
    need(body)
    named = [(name, _REFERENCE.sub(r"\1", _render(name, "duckdb"))) for name in ordered]
    named += list(extra)
    if not named:
        return body
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in named) + "\n" + body
