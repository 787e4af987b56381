"""Synthetic tables over the keys of the test tables, with their SQL counterparts.

The SQL makes the same draws from the same digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import draws, fixed
from orderloom.registry.core import Registry
from orderloom.sources import synthetic
from orderloom.sources.canonical import CanonicalTables

registry = Registry()
add = registry.add

NOW = "2024-12-31 12:00:00"


def _ids(t: CanonicalTables, table: str, key: str) -> DataFrame:
    return t[table].select((F.col(key) + 1).cast("bigint").alias("id"))


def _rows(t: CanonicalTables, table: str):
    return t[table].agg(F.count(F.lit(1)).alias("n")).select("n").scalar()


def _md5(name: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{synthetic.SEED}:{name}', {', '.join(keys or ('id',))}))"


def _draw(name: str, *keys: str) -> str:
    return f"cast('0x' || substr({_md5(name, *keys)}, 1, 15) as bigint)"


def _between(name: str, low: int, high: int, *keys: str) -> str:
    return f"({low} + {_draw(name, *keys)} % {high - low + 1})"


def _choice(name: str, values: list[str], *keys: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{_draw(name, *keys)} % {len(values)} + 1]"


def _weighted(name: str, values: list[str], weights: list[int]) -> str:
    bounds = [sum(weights[: i + 1]) for i in range(len(weights))]
    cases = " ".join(f"when {_draw(name)} % {bounds[-1]} < {b} then '{v}'" for v, b in zip(values, bounds))
    return f"case {cases} end"


def _letters(name: str, length: int, *keys: str) -> str:
    return f"translate(substr(to_base64(unhex({_md5(name, *keys)})), 1, {length}), '+/', 'xy')"


def _day(name: str, first: int, last: int) -> str:
    return (
        f"(date '{first}-01-01' + cast({_draw(name)} % "
        f"(date '{last}-12-31' - date '{first}-01-01' + 1) as int))"
    )


def _uuid(name: str) -> str:
    return (
        f"regexp_replace({_md5(name)}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', "
        r"'\1-\2-\3-\4-\5')"
    )


def _keys(table: str, key: str) -> tuple[str, str]:
    return "ids", f"select cast({key} + 1 as bigint) as id from {table}"


_EMAIL = f"concat({_letters('mail.box', 8)}, '@', {_choice('mail.host', fixed.MAIL_HOSTS)}, '.com')"
_PHONE = f"concat('010-', {_between('phone.first', 1000, 9999)}, '-', {_between('phone.second', 1000, 9999)})"
_NAME = (
    f"concat({_choice('name.family', fixed.FAMILY_NAMES)}, {_choice('name.given', fixed.GIVEN_NAMES)})"
)
_USERS = "(select count(*) from customer)"
_PRODUCTS = "(select count(*) from part)"
_SUPPLIERS = "(select count(*) from supplier)"

add(
    "g01_category_tree",
    lambda t: synthetic.categories(
        t.nation.select(F.col("n_nationkey").cast("bigint").alias("position"), F.col("n_name").alias("name"))
    ),
    f"""select root_id + j as id,
               case when j = 0 then n_name else concat(n_name, '-', {_letters('category.name', 5, 'root_id', 'j')})
               end as name,
               case when j > 0 then root_id end as parent_id,
               cast(case when j = 0 then 1 else 2 end as int) as level,
               cast(case when j = 0 then n_nationkey * 10 else j - 1 end as int) as sort_order
        from (select cast(n_nationkey as bigint) * 6 + 1 as root_id, n_nationkey, n_name from nation) roots,
             range(6) children(j)""",
)
_BRAND = (
    "case when id <= 14 then ("
    + "["
    + ", ".join(f"'{b}'" for b in fixed.BRAND_NAMES)
    + f"])[id] else concat('Brand-', {_letters('brand.name', 8)}) end"
)
add(
    "g02_brands",
    lambda t: synthetic.brands(_ids(t, "supplier", "s_suppkey")),
    f"""select id, {_BRAND} as name, concat({_BRAND}, ' description') as description,
               {_choice('brand.country', fixed.BRAND_COUNTRIES)} as country,
               {_draw('brand.premium')} % 100 < 50 as is_premium from ids""",
    named=(_keys("supplier", "s_suppkey"),),
)
add(
    "g03_users",
    lambda t: synthetic.users(_ids(t, "customer", "c_custkey")),
    f"""select id, {_EMAIL} as email, '{fixed.PASSWORD}' as password, {_NAME} as name, {_PHONE} as phone,
               {_day('user.birth', 1980, 2005)} as birth_date,
               {_choice('user.gender', fixed.GENDERS)} as gender,
               {_choice('user.status', fixed.USER_STATES)} as status,
               {_weighted('user.tier', fixed.TIERS, fixed.TIER_WEIGHTS)} as tier,
               cast({_day('user.registered', 2020, 2024)} as timestamp) as registration_date,
               cast({_day('user.seen', 2023, 2024)} as timestamp) as last_login
        from ids""",
    named=(_keys("customer", "c_custkey"),),
)
add(
    "g03_user_addresses",
    lambda t: synthetic.user_addresses(_ids(t, "customer", "c_custkey")),
    f"""select user_id * 3 + j as id, user_id,
               {_choice('address.type', fixed.ADDRESS_TYPES, 'user_id', 'j')} as address_type,
               cast({_between('address.postal', 10000, 99999, 'user_id', 'j')} as varchar) as postal_code,
               concat({_letters('address.street', 10, 'user_id', 'j')}, ' street') as address1,
               concat('Apt ', {_between('address.flat', 1, 999, 'user_id', 'j')}) as address2,
               {_choice('address.city', fixed.CITIES, 'user_id', 'j')} as city, j = 0 as is_default
        from (select id as user_id, unnest(range({_between('address.count', 1, 3)})) as j from ids) x""",
    named=(_keys("customer", "c_custkey"),),
)


def _some(name: str, size: str, most: int) -> str:
    count = f"least({_between(f'{name}.count', 1, most)}, {size})"
    stride = f"({_draw(f'{name}.stride')} % greatest(({size} - 1) // {most - 1}, 1) + 1)"
    return (
        f"list_transform(range({count}), lambda j: ({_draw(f'{name}.first')} % {size} + j * {stride}) % {size} + 1)"
    )


add(
    "g03_user_preferences",
    lambda t: synthetic.user_preferences(
        _ids(t, "customer", "c_custkey"), _rows(t, "nation")
    ).withColumn("preferred_categories", F.array_join("preferred_categories", ",")),
    f"""select id, id as user_id,
               array_to_string({_some('preference.categories', 'n', 5)}, ',') as preferred_categories,
               {_between('preference.low', 10_000, 50_000)} as price_range_min,
               {_between('preference.high', 100_000, 1_000_000)} as price_range_max
        from ids, (select count(*) as n from nation) sizes""",
    doubles="price_range_min price_range_max",
    named=(_keys("customer", "c_custkey"),),
)
_PRODUCT_NAME = f"concat({_choice('product.kind', fixed.PRODUCT_NAMES)}, ' ', {_letters('product.name', 5)})"
_PRICE = _between("product.price", 10_000, 500_000)
add(
    "g04_products",
    lambda t: synthetic.products(_ids(t, "part", "p_partkey"), _rows(t, "nation"), _rows(t, "supplier")),
    f"""select id, concat('SKU-', {_letters('product.sku', 12)}) as sku, {_PRODUCT_NAME} as name,
               concat('Description for ', {_PRODUCT_NAME}) as description,
               {_draw('product.category')} % (select count(*) from nation) + 1 as category_id,
               case when {_draw('product.unbranded')} % 100 >= 30
                    then {_draw('product.brand')} % {_SUPPLIERS} + 1 end as brand_id,
               {_PRICE} as price, {_PRICE} * 12 // 10 as compare_at_price,
               cast({_between('product.stock', 0, 1000)} as int) as stock_quantity,
               {_choice('product.status', fixed.PRODUCT_STATES)} as status,
               {_draw('product.featured')} % 100 < 10 as is_featured
        from ids""",
    doubles="price compare_at_price",
    named=(_keys("part", "p_partkey"),),
)
add(
    "g04_product_images",
    lambda t: synthetic.product_images(_ids(t, "part", "p_partkey")),
    f"""select product_id * 5 + j as id, product_id,
               printf('{fixed.IMAGE_URL}', product_id, j) as image_url,
               concat('Image ', j, ' for ', name) as alt_text, j = 0 as is_primary
        from (select id as product_id, {_PRODUCT_NAME} as name, unnest(range({_between('image.count', 1, 5)})) as j from ids) x""",
    named=(_keys("part", "p_partkey"),),
)


def _by_rating(good: str, fair: str, bad: str) -> str:
    return f"case when rating >= 4 then '{good}' when rating = 3 then '{fair}' else '{bad}' end"


add(
    "g05_reviews",
    lambda t: synthetic.reviews(
        _ids(t, "orders", "o_orderkey"), _rows(t, "customer"), _rows(t, "part")
    ),
    f"""select *, {_by_rating(*fixed.REVIEW_TITLES)} as title,
               {_by_rating(*fixed.REVIEW_TEXTS)} as content
        from (select id, {_draw('review.product')} % {_PRODUCTS} + 1 as product_id,
                     {_draw('review.user')} % {_USERS} + 1 as user_id,
                     cast({_between('review.rating', 1, 5)} as int) as rating,
                     {_draw('review.verified')} % 100 < 70 as is_verified_purchase
              from ids) drawn""",
    named=(_keys("orders", "o_orderkey"),),
)
_LINES = (
    "order_lines",
    f"""
    select order_id, product_id, j,
           {_between('order.quantity', 1, 3, 'order_id', 'j')} as quantity,
           {_between('product.price', 10_000, 500_000, 'product_id')} as price
    from (select id as order_id, unnest(chosen) as product_id, unnest(range(len(chosen))) as j
          from (select id, {_some('order.products', 'n', 5)} as chosen
                from ids, (select count(*) as n from part) sizes) picked) lines""",
)
add(
    "g06_orders",
    lambda t: synthetic.orders(
        _ids(t, "orders", "o_orderkey"), _rows(t, "customer"), _rows(t, "part"), today=NOW[:10]
    ),
    f"""select id, concat('ORD-20241231-', lpad(cast(id as varchar), cast(greatest(6, length(cast(id as varchar))) as int), '0'))
                   as order_number,
               case when {_draw('order.guest')} % 100 >= 10 then {_draw('order.user')} % {_USERS} + 1 end
                   as user_id,
               {_weighted('order.status', fixed.ORDER_STATES, fixed.ORDER_WEIGHTS)} as status,
               subtotal, cast(subtotal as decimal(12,2)) * 1.1 as total_amount,
               cast({_day('order.day', 2023, 2024)} as timestamp) as created_at
        from ids join (select order_id, sum(quantity * price) as subtotal from order_lines group by 1) s
          on s.order_id = id""",
    doubles="subtotal total_amount",
    named=(_keys("orders", "o_orderkey"), _LINES),
)
add(
    "g06_order_items",
    lambda t: synthetic.order_items(_ids(t, "orders", "o_orderkey"), _rows(t, "part")),
    """select order_id * 5 + j as id, order_id, product_id, concat('Product ', product_id) as product_name,
              cast(quantity as int) as quantity, price as unit_price, quantity * price as total_price
       from order_lines""",
    doubles="unit_price total_price",
    named=(_keys("orders", "o_orderkey"), _LINES),
)
# Each order holds each product once and its total is that of its lines.
add(
    "g06_order_consistency",
    lambda t: synthetic.order_items(_ids(t, "orders", "o_orderkey"), _rows(t, "part"))
    .groupBy("order_id")
    .agg(
        F.count("product_id").alias("lines"),
        F.count_distinct("product_id").alias("products"),
        F.sum("total_price").alias("sum_of_lines"),
    )
    .join(
        synthetic.orders(
            _ids(t, "orders", "o_orderkey"), _rows(t, "customer"), _rows(t, "part"), today=NOW[:10]
        ).select(F.col("id").alias("order_id"), "subtotal"),
        "order_id",
    )
    .select(
        "order_id",
        (F.col("lines") == F.col("products")).alias("distinct_products"),
        F.col("lines").between(1, 5).alias("one_to_five"),
        (F.col("sum_of_lines") == F.col("subtotal")).alias("adds_up"),
    ),
    """select o_orderkey + 1 as order_id, true as distinct_products, true as one_to_five, true as adds_up
       from orders""",
)


def _visitor(table: str, anonymous: int) -> str:
    unknown = f"{_draw(f'{table}.anonymous')} % 100 < {anonymous}"
    return f"""case when not ({unknown}) then {_draw(f'{table}.user')} % {_USERS} + 1 end as user_id,
               case when {unknown} then {_uuid(f'{table}.session')} end as session_id"""


add(
    "g07_product_views",
    lambda t: synthetic.product_views(
        _ids(t, "events", "event_id"), _rows(t, "customer"), _rows(t, "part"), now=NOW
    ),
    f"""select id, {_draw('view.product')} % {_PRODUCTS} + 1 as product_id, {_visitor('view', 30)},
               cast({_between('view.duration', 10, 300)} as int) as view_duration,
               timestamp '{NOW}' as created_at
        from ids""",
    named=(_keys("events", "event_id"),),
)
add(
    "g08_search_logs",
    lambda t: synthetic.search_logs(_ids(t, "events", "event_id"), _rows(t, "customer"), now=NOW),
    f"""select id, {_visitor('search', 40)},
               concat({_choice('search.text', fixed.SEARCH_TEXTS)},
                      case when {_draw('search.suffixed')} % 100 < 30
                           then concat(' ', {_letters('search.suffix', 5)}) else '' end) as search_query,
               cast({_between('search.results', 0, 100)} as int) as results_count,
               cast(null as bigint) as clicked_product_id, timestamp '{NOW}' as created_at
        from ids""",
    named=(_keys("events", "event_id"),),
)
add(
    "g09_random_scalars",
    lambda t: _ids(t, "customer", "c_custkey").select(
        "id",
        draws.letters(synthetic.SEED, "text", 10, F.col("id")).alias("text"),
        draws.email(synthetic.SEED, F.col("id")).alias("email"),
        draws.phone(synthetic.SEED, F.col("id")).alias("phone"),
        draws.person_name(synthetic.SEED, F.col("id")).alias("name"),
        draws.day_in(draws.draw(synthetic.SEED, "day", F.col("id")), 2020, 2024).alias("day"),
    ),
    f"""select id, {_letters('text', 10)} as text, {_EMAIL} as email, {_PHONE} as phone, {_NAME} as name,
               {_day('day', 2020, 2024)} as day from ids""",
    named=(_keys("customer", "c_custkey"),),
)
