"""Change sets and constraint checks with their SQL counterparts.

Changes are derived from the test tables: order lines change the order or the
product that they belong to, in order of ship date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators import bucketed, changes, constraints, delta_checks
from orderloom.registry.core import Registry
from orderloom.session import shared_folder
from orderloom.sources.schemas import declared_defaults

registry = Registry()
add = registry.add

# Replacement rows for orders; some keys lie beyond the snapshot and are inserted.
_ORDER_ROWS_SPARK = """
    select l_orderkey + case when l_linenumber = 1 then 1000000000 else 0 end as id,
           l_suppkey as user_id, case when l_linenumber = 2 then null else 'SHIPPED' end as status,
           cast(l_extendedprice as decimal(12,2)) as total_amount, l_shipdate as created_at,
           l_shipdate as ts,
           (l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as seq
    from {lineitem}"""
_ORDER_ROWS = ("changed", _ORDER_ROWS_SPARK.replace("{lineitem}", "lineitem"))


def _order_rows(t):
    return t.spark.sql(_ORDER_ROWS_SPARK, lineitem=t.lineitem)


_LAST = (
    "last_change",
    "select * from changed qualify row_number() over (partition by id order by ts desc, seq desc) = 1",
)
add(
    "m01_upsert_orders",
    lambda t: changes.upsert(t.v_orders, _order_rows(t)).snapshot,
    """select id, user_id, status, total_amount, created_at from last_change
       union all
       select o.id, o.user_id, o.status, o.total_amount, o.created_at from v_orders o
       where o.id not in (select id from changed)""",
    doubles="total_amount",
    named=(_ORDER_ROWS, _LAST),
)


def _upserted_in_buckets(t):
    folder, schema = shared_folder(t.spark, "orders"), t.v_orders.schema
    bucketed.write_buckets(t.v_orders, folder, buckets=16)
    bucketed.apply_to_buckets(t.spark, folder, schema, _order_rows(t), changes.upsert, buckets=16)
    return bucketed.read_buckets(t.spark, folder, schema)


add(
    "m01_bucketed_upsert",
    _upserted_in_buckets,
    """select id, user_id, status, total_amount, created_at from last_change
       union all
       select o.id, o.user_id, o.status, o.total_amount, o.created_at from v_orders o
       where o.id not in (select id from changed)""",
    doubles="total_amount",
    named=(_ORDER_ROWS, _LAST),
)


def _upserted_with_rejects(t):
    # Every third change has lost its key.
    keyless = F.when(F.col("seq") % 3 != 0, F.col("id"))
    found = changes.upsert(t.v_orders, _order_rows(t).withColumn("id", keyless))
    columns = [c for c in found.snapshot.columns if c != "id"]
    return found.snapshot.select(F.lit("row").alias("outcome"), "id", *columns).unionByName(
        found.rejects.select(F.lit("reject").alias("outcome"), "id", *columns)
    )


add(
    "m01_upsert_null_keys",
    _upserted_with_rejects,
    """select 'row' as outcome, id, user_id, status, total_amount, created_at from last_change where id is not null
       union all
       select 'row', o.id, o.user_id, o.status, o.total_amount, o.created_at from v_orders o
       where not exists (select 1 from keyless k where k.id = o.id)
       union all
       select 'reject', id, user_id, status, total_amount, created_at from keyless where id is null""",
    doubles="total_amount",
    named=(
        _ORDER_ROWS,
        ("keyless", "select * replace (case when seq % 3 <> 0 then id end as id) from changed"),
        (
            "last_change",
            "select * from keyless qualify row_number() over (partition by id order by ts desc, seq desc) = 1",
        ),
    ),
)

_USER_ROWS_SPARK = """
    select o_custkey + case when o_orderpriority = '1-URGENT' then 1000000000 else 0 end as id,
           concat('new', cast(o_orderkey as string), '@example.com') as email,
           concat('Name ', cast(o_orderkey as string)) as name,
           case when o_orderstatus = 'F' then concat('pw', cast(o_orderkey as string)) end as password,
           case when o_orderpriority <> '3-MEDIUM' then o_orderdate end as ts, o_orderkey as seq
    from {orders}"""
_USERS_SPARK = """
    select id, name, email, 'initial' as password, registration_date as created_at,
           registration_date as updated_at
    from {v_users}"""


def _accounts(t):
    return t.spark.sql(_USERS_SPARK, v_users=t.v_users)


def _user_rows(t):
    return t.spark.sql(_USER_ROWS_SPARK, orders=t.orders)


_USER_NAMED = (
    ("accounts", _USERS_SPARK.replace("{v_users}", "v_users")),
    ("changed", _USER_ROWS_SPARK.replace("{orders}", "orders")),
    (
        "reduced",
        """select l.id, l.email, l.name, p.password, t.ts
           from (select * from changed
                 qualify row_number() over (partition by id order by ts desc nulls last, seq desc) = 1) l
           join (select id, max(ts) as ts from changed group by id) t on t.id = l.id
           left join (select id, password from changed where password is not null
                      qualify row_number() over (partition by id order by ts desc nulls last, seq desc) = 1) p
             on p.id = l.id""",
    ),
)
add(
    "m02_update_users",
    lambda t: changes.update_users(_accounts(t), _user_rows(t)).snapshot,
    """select a.id, case when r.id is null then a.name else r.name end as name,
              case when r.id is null then a.email else r.email end as email,
              coalesce(r.password, a.password) as password, a.created_at,
              coalesce(r.ts, a.updated_at) as updated_at
       from accounts a left join reduced r on r.id = a.id""",
    named=_USER_NAMED,
)
add(
    "m02_update_users_rejects",
    lambda t: changes.update_users(_accounts(t), _user_rows(t)).rejects,
    "select * from changed where id not in (select id from accounts)",
    named=_USER_NAMED,
)

_CATALOGUE_SPARK = """
    select p_partkey as id, p_name as name, concat(p_brand, ' ', p_type) as description,
           cast(p_retailprice as decimal(18,2)) as price, p_size * 20 as stock, p_type as category
    from {part}"""
_PRODUCT_ROWS_SPARK = """
    select l_partkey as id, concat('renamed ', cast(l_orderkey as string)) as name,
           case when l_linenumber <= 3 then 'changed' end as description,
           cast(l_extendedprice as decimal(18,2)) as price, cast(l_quantity as int) as stock,
           l_returnflag as category, l_shipdate as ts,
           (l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as seq
    from {lineitem}"""


def _catalogue(t):
    return t.spark.sql(_CATALOGUE_SPARK, part=t.part)


_CATALOGUE = ("catalogue", _CATALOGUE_SPARK.replace("{part}", "part"))
add(
    "m03_update_products",
    lambda t: changes.update_products(
        _catalogue(t), t.spark.sql(_PRODUCT_ROWS_SPARK, lineitem=t.lineitem)
    ).snapshot,
    """select id, name, description, price, stock, category from last_change
       where id in (select id from catalogue)
       union all
       select id, name, description, price, stock, category from catalogue
       where id not in (select id from changed)""",
    doubles="price",
    named=(_CATALOGUE, ("changed", _PRODUCT_ROWS_SPARK.replace("{lineitem}", "lineitem")), _LAST),
)

_STATUS_SPARK = """
    select l_orderkey + case when l_linenumber = 7 then 1000000000 else 0 end as id,
           case when l_returnflag = 'R' then 'RETURNED' else 'SHIPPED' end as status, l_shipdate as ts,
           (l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as seq
    from {lineitem}"""
_STATUS = ("changed", _STATUS_SPARK.replace("{lineitem}", "lineitem"))


def _statuses(t):
    return t.spark.sql(_STATUS_SPARK, lineitem=t.lineitem)


def _orders_with_touch(t):
    return t.v_orders.withColumn("updated_at", F.col("created_at"))


add(
    "m04_update_order_status",
    lambda t: changes.update_order_status(_orders_with_touch(t), _statuses(t)).snapshot,
    """select o.id, o.user_id, coalesce(c.status, o.status) as status, o.total_amount, o.created_at,
              coalesce(c.ts, o.created_at) as updated_at
       from v_orders o left join last_change c on c.id = o.id""",
    doubles="total_amount",
    named=(_STATUS, _LAST),
)
add(
    "m04_status_rejects",
    lambda t: changes.update_order_status(_orders_with_touch(t), _statuses(t)).rejects,
    "select * from changed where id not in (select id from v_orders)",
    named=(_STATUS,),
)
add(
    "m04_status_events",
    lambda t: changes.status_events(t.v_orders, _statuses(t)),
    """select c.id, c.status, c.ts, o.user_id, o.total_amount, o.created_at
       from changed c join v_orders o on o.id = c.id""",
    doubles="total_amount",
    named=(_STATUS,),
)
add(
    "m05_add_stock",
    lambda t: changes.add_stock(
        _catalogue(t),
        t.lineitem.select(
            F.col("l_partkey").alias("id"), (F.lit(10) - F.col("l_quantity")).cast("int").alias("quantity")
        ),
    ).snapshot,
    """select c.id, c.name, c.description, c.price, cast(c.stock + coalesce(d.delta, 0) as int) as stock,
              c.category
       from catalogue c
       left join (select l_partkey, sum(cast(10 - l_quantity as int)) as delta
                  from lineitem group by 1) d on d.l_partkey = c.id""",
    doubles="price",
    named=(_CATALOGUE,),
)
add(
    "m06_delete_by_key",
    lambda t: changes.delete_keys(
        t.v_users, t.orders.where("o_totalprice >= 400000").select(F.col("o_custkey").alias("id"))
    ),
    "select * from v_users where id not in (select o_custkey from orders where o_totalprice >= 400000)",
)

add(
    "c01_not_null",
    lambda t: constraints.not_null(t.v_views, ["product_id", "user_id"]),
    """select 'not_null' as rule, cast(id as varchar) as key, 'user_id' as "column",
              cast(null as varchar) as value
       from v_views where user_id is null""",
)
add(
    "c02_unique",
    lambda t: constraints.unique(t.v_order_items, ["id"]),
    """select 'unique' as rule, cast(id as varchar) as key, 'id' as "column",
              cast(count(*) as varchar) as value
       from v_order_items group by id having count(*) > 1""",
)
add(
    "c02_unique_composite",
    lambda t: constraints.unique(t.v_views, ["user_id", "product_id"]),
    """select 'unique' as rule, concat(user_id, ',', product_id) as key, 'user_id,product_id' as "column",
              cast(count(*) as varchar) as value
       from v_views where user_id is not null and product_id is not null
       group by user_id, product_id having count(*) > 1""",
)
add(
    "c03_check_range",
    lambda t: constraints.in_range(t.v_reviews, "rating", 2, 4),
    """select 'check_range' as rule, cast(id as varchar) as key, 'rating' as "column",
              cast(rating as varchar) as value
       from v_reviews where rating not between 2 and 4""",
)
add(
    "c04_foreign_key",
    lambda t: constraints.foreign_key(t.v_orders, "user_id", t.v_users.where("status = 'ACTIVE'")),
    """select 'foreign_key' as rule, cast(id as varchar) as key, 'user_id' as "column",
              cast(user_id as varchar) as value
       from v_orders where user_id not in (select id from v_users where status = 'ACTIVE')""",
)
add(
    "c05_default_fill",
    lambda t: constraints.fill_defaults(t.v_views, {"user_id": -1}),
    "select id, product_id, coalesce(user_id, -1) as user_id, created_at from v_views",
)
add(
    "c06_max_length",
    lambda t: constraints.max_length(t.v_users, {"email": 20, "tier": 9}),
    """select 'max_length' as rule, cast(id as varchar) as key, c as "column", cast(n as varchar) as value
       from (select id, 'email' as c, length(email) as n, 20 as most from v_users
             union all select id, 'tier', length(tier), 9 from v_users) x
       where n > most""",
)
add(
    "c07_delete_cascade",
    lambda t: constraints.delete_cascade(
        t.v_order_items,
        "order_id",
        t.v_orders.join(t.v_users.where("id % 7 = 0").select(F.col("id").alias("user_id")), "user_id", "left_semi"),
    ),
    """select i.* from v_order_items i
       where i.order_id not in (select id from v_orders where user_id % 7 = 0)""",
    doubles="total_price",
)
add(
    "c08_delete_set_null",
    lambda t: constraints.delete_set_null(t.v_views, "user_id", t.v_users.where("id % 7 = 0")),
    """select w.id, w.product_id,
              case when w.user_id in (select id from v_users where id % 7 = 0) then null
                   else w.user_id end as user_id, w.created_at
       from v_views w""",
)
add(
    "c09_validate",
    lambda t: constraints.validate(
        t.v_reviews,
        [
            (constraints.not_null, ["product_id"]),
            (constraints.in_range, "rating", 1, 4),
            (constraints.max_length, {"status": 7}),
        ],
    ),
    """select 'check_range' as rule, cast(id as varchar) as key, 'rating' as "column",
              cast(rating as varchar) as value
       from v_reviews where rating > 4
       union all
       select 'max_length', cast(id as varchar), 'status', cast(length(status) as varchar)
       from v_reviews where length(status) > 7""",
)

# Some orders have lost their time, state or amount.
_HOLED_SPARK = """
    select id, user_id, case when id % 5 > 0 then status end as status,
           case when id % 11 > 0 then total_amount end as total_amount,
           case when id % 7 > 0 then created_at end as created_at
    from {v_orders}"""
_HOLED = ("holed", _HOLED_SPARK.replace("{v_orders}", "v_orders"))
_AS_OF = "2002-01-01 00:00:00"


def _holed(t):
    return t.spark.sql(_HOLED_SPARK, v_orders=t.v_orders)


add(
    "c05_declared_defaults",
    lambda t: constraints.fill_defaults(_holed(t), declared_defaults("orders", _AS_OF)),
    f"""select id, user_id, coalesce(status, 'PENDING') as status, total_amount,
               coalesce(created_at, timestamp '{_AS_OF}') as created_at
        from holed""",
    doubles="total_amount",
    named=(_HOLED,),
)

# Every third order has a shipment with two places on its way.
_SHIPMENTS_SPARK = "select id * 10 as id, id as order_id from {v_orders} where id % 3 = 0"
_SHIPMENTS = ("shipped", _SHIPMENTS_SPARK.replace("{v_orders}", "v_orders"))


def _delivery_tables(t):
    shipments = t.spark.sql(_SHIPMENTS_SPARK, v_orders=t.v_orders)
    tracking = shipments.select(
        F.explode(F.array(F.col("id") * 10 + 1, F.col("id") * 10 + 2)).alias("id"), F.col("id").alias("shipment_id")
    )
    return {"orders": t.v_orders, "order_items": t.v_order_items, "shipments": shipments, "shipment_tracking": tracking}


def _named_ids(tables, **more):
    named = {**tables, **more}
    parts = [df.select(F.lit(name).alias("name"), F.col("id").cast("bigint").alias("id")) for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def _deleted_orders(t):
    gone = t.v_orders.where("id % 5 = 0").select("id")
    result = constraints.delete_rows("orders", gone, _delivery_tables(t))
    return _named_ids(result.tables, blocked=result.blocked)


add(
    "c07_restricted",
    _deleted_orders,
    """select 'orders' as name, id from v_orders where id % 5 > 0 or id in (select order_id from shipped)
       union all
       select 'order_items', id from v_order_items
       where order_id % 5 > 0 or order_id in (select order_id from shipped)
       union all
       select 'blocked', id from v_orders where id % 5 = 0 and id in (select order_id from shipped)""",
    named=(_SHIPMENTS,),
)


def _deleted_chain(t):
    """Shipments with their places first, then the orders with their items, then users that nothing holds any more."""
    tables = _delivery_tables(t)
    orders = t.v_orders.where("user_id % 7 = 0")
    shipments = tables["shipments"].join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    tables |= constraints.delete_rows("shipments", shipments.select("id"), tables).tables
    tables |= constraints.delete_rows("orders", orders.select("id"), tables).tables
    tables["users"] = t.v_users
    users = t.v_users.where("id % 7 = 0 or id % 7 = 1").select("id")
    result = constraints.delete_rows("users", users, tables)
    return _named_ids({**tables, **result.tables}, blocked=result.blocked)


add(
    "c07_delete_chain",
    _deleted_chain,
    """select 'orders' as name, id from v_orders where user_id % 7 > 0
       union all
       select 'order_items', i.id from v_order_items i join v_orders o on o.id = i.order_id where o.user_id % 7 > 0
       union all
       select 'shipments', s.id from shipped s join v_orders o on o.id = s.order_id where o.user_id % 7 > 0
       union all
       select 'shipment_tracking', s.id * 10 + step from shipped s join v_orders o on o.id = s.order_id,
              (select unnest([1, 2]) as step) where o.user_id % 7 > 0
       union all
       select 'users', id from v_users
       where id % 7 > 1 or (id % 7 = 1 and id in (select user_id from v_orders))
       union all
       select 'blocked', id from v_users where id % 7 = 1 and id in (select user_id from v_orders)""",
    named=(_SHIPMENTS,),
)
add(
    "c10_table_violations",
    lambda t: constraints.table_violations("orders", {"orders": _holed(t), "users": t.v_users.where("status = 'ACTIVE'")}),
    """select 'not_null' as rule, cast(id as varchar) as key, 'total_amount' as "column", cast(null as varchar) as value
       from holed where total_amount is null
       union all
       select 'foreign_key', cast(id as varchar), 'user_id', cast(user_id as varchar)
       from holed where user_id not in (select id from v_users where status = 'ACTIVE')""",
    named=(_HOLED,),
)

# Orders of which some change user, state and amount, some go and some come; users that become inactive or active.
_MOVED_SPARK = """
    select case when id % 10 = 3 then id + 1000000000 else id end as id,
           case when id % 4 = 0 then user_id + 1000000 when id % 10 = 3 then user_id else user_id + 1 end as user_id,
           case when id % 6 > 0 then status end as status,
           cast(total_amount * (1 + id % 3) as decimal(12,2)) as total_amount, created_at
    from {v_orders} where id % 10 in (1, 2, 3)"""
_PARENTS_SPARK = "select id, name from {v_users} where (status = 'ACTIVE') <> (id % 9 = 0)"
_DELTA = (
    ("moved", _MOVED_SPARK.replace("{v_orders}", "v_orders")),
    ("now_orders", "select * from v_orders where id % 10 not in (0, 1, 2) union all select * from moved"),
    ("now_users", _PARENTS_SPARK.replace("{v_users}", "v_users")),
)
_LARGEST = 250000


def _delta_violations(t):
    """The checks of the new snapshot from those of the old one and the changes."""
    old, moved = t.v_orders, t.spark.sql(_MOVED_SPARK, v_orders=t.v_orders)
    rows = delta_checks.RowChanges(old.where("id % 10 in (0, 1, 2)"), moved)
    new = old.where("id % 10 not in (0, 1, 2)").unionByName(moved)
    before, after = t.v_users.where("status = 'ACTIVE'"), t.spark.sql(_PARENTS_SPARK, v_users=t.v_users)
    users = t.v_users.select("id", (F.col("status") == "ACTIVE").alias("was"), (F.col("id") % 9 == 0).alias("changes"))
    parents = delta_checks.RowChanges(users.where("changes and was"), users.where("changes and not was"))

    def states(df: DataFrame) -> DataFrame:
        return constraints.not_null(df, ["status"])

    def amounts(df: DataFrame) -> DataFrame:
        return constraints.in_range(df, "total_amount", 0, _LARGEST)

    keys = ["user_id", "created_at"]
    found = [delta_checks.row_check(check(old), rows, check) for check in (states, amounts)]
    found.append(delta_checks.unique_check(constraints.unique(old, keys), delta_checks.key_counts(old, keys), rows, keys))
    orphans = constraints.foreign_key(old, "user_id", before)
    found.append(delta_checks.foreign_key_check(orphans, new, rows, "user_id", after, parents))
    repeated = F.when(F.col("rule") == "unique", F.regexp_replace("key", r",(\S+).*$", ",$1")).otherwise(F.col("key"))
    values = F.when(F.col("rule") != "check_range", F.col("value"))
    return reduce(DataFrame.unionByName, found).withColumns({"key": repeated, "value": values})


add(
    "c11_delta_violations",
    _delta_violations,
    f"""select 'not_null' as rule, cast(id as varchar) as key, 'status' as "column", cast(null as varchar) as value
       from now_orders where status is null
       union all
       select 'check_range', cast(id as varchar), 'total_amount', null from now_orders
       where total_amount not between 0 and {_LARGEST}
       union all
       select 'unique', concat(user_id, ',', strftime(created_at, '%Y-%m-%d')), 'user_id,created_at', cast(count(*) as varchar)
       from now_orders where user_id is not null and created_at is not null group by user_id, created_at having count(*) > 1
       union all
       select 'foreign_key', cast(id as varchar), 'user_id', cast(user_id as varchar)
       from now_orders where user_id not in (select id from now_users)""",
    named=_DELTA,
)
