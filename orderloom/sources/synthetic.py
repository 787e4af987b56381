"""Synthetic commerce tables.

Each table is a projection of a table of ids from 1 on, mostly
``spark.range(1, n + 1)``. What a row needs of another table, such as the price
of a product, is drawn again from the id of that row, so no table needs a join
or a shuffle. Sizes of other tables may be numbers or single-value columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import fixed
from orderloom.functions.draws import (
    between,
    chance,
    choice,
    day_in,
    draw,
    email,
    letters,
    person_name,
    phone,
    uuid_of,
    weighted,
)
from orderloom.functions.scalars import Day, as_day

SEED = 42
CHILDREN = 5
MAX_ITEMS = 5
Size = int | Column


def ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(1, rows + 1)


def _size(value: Size) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def _sized(rows: DataFrame, size: Size) -> DataFrame:
    """Put a size into a column, as functions over arrays take no subqueries."""
    return rows.withColumn("_size", _size(size))


def _some(seed: int, name: str, most: int, key: Column) -> Column:
    """Up to ``most`` distinct ids from 1 to ``_size``, spaced by a drawn stride."""
    size = F.col("_size")
    count = F.least(between(draw(seed, f"{name}.count", key), 1, most), size)
    first = draw(seed, f"{name}.first", key) % size
    room = F.greatest(F.floor((size - 1) / F.lit(most - 1)).cast("bigint"), F.lit(1))
    stride = draw(seed, f"{name}.stride", key) % room + 1
    return F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda j: (first + j * stride) % size + 1)


def root_categories(spark: SparkSession) -> DataFrame:
    """The fixed top categories as (position, name)."""
    return spark.createDataFrame(list(enumerate(fixed.ROOT_CATEGORIES)), "position bigint, name string")


def categories(roots: DataFrame, seed: int = SEED) -> DataFrame:
    """Each root with its children; ids are dense when positions are."""
    root_id = F.col("position") * (CHILDREN + 1) + 1
    members = F.array(*(F.lit(j) for j in range(CHILDREN + 1)))
    return roots.select(
        "position", F.col("name").alias("root"), root_id.alias("root_id"), F.explode(members).alias("j")
    ).select(
        (F.col("root_id") + F.col("j")).alias("id"),
        F.when(F.col("j") == 0, F.col("root"))
        .otherwise(
            F.concat("root", F.lit("-"), letters(seed, "category.name", 5, F.col("root_id"), F.col("j")))
        )
        .alias("name"),
        F.when(F.col("j") > 0, F.col("root_id")).alias("parent_id"),
        F.when(F.col("j") == 0, 1).otherwise(2).alias("level"),
        F.when(F.col("j") == 0, F.col("position") * 10).otherwise(F.col("j") - 1).cast("int").alias("sort_order"),
    )


def brands(rows: DataFrame, seed: int = SEED) -> DataFrame:
    key = F.col("id")
    known = F.array(*(F.lit(b) for b in fixed.BRAND_NAMES))
    name = F.when(key <= len(fixed.BRAND_NAMES), F.get(known, (key - 1).cast("int"))).otherwise(
        F.concat(F.lit("Brand-"), letters(seed, "brand.name", 8, key))
    )
    return rows.select(
        key,
        name.alias("name"),
        F.concat(name, F.lit(" description")).alias("description"),
        choice(draw(seed, "brand.country", key), fixed.BRAND_COUNTRIES).alias("country"),
        chance(draw(seed, "brand.premium", key), 50).alias("is_premium"),
    )


def users(rows: DataFrame, seed: int = SEED) -> DataFrame:
    key = F.col("id")

    def time(name: str, first: int, last: int) -> Column:
        return day_in(draw(seed, name, key), first, last).cast("timestamp_ntz")

    return rows.select(
        key,
        email(seed, key).alias("email"),
        F.lit(fixed.PASSWORD).alias("password"),
        person_name(seed, key).alias("name"),
        phone(seed, key).alias("phone"),
        day_in(draw(seed, "user.birth", key), 1980, 2005).alias("birth_date"),
        choice(draw(seed, "user.gender", key), fixed.GENDERS).alias("gender"),
        choice(draw(seed, "user.status", key), fixed.USER_STATES).alias("status"),
        weighted(draw(seed, "user.tier", key), fixed.TIERS, fixed.TIER_WEIGHTS).alias("tier"),
        time("user.registered", 2020, 2024).alias("registration_date"),
        time("user.seen", 2023, 2024).alias("last_login"),
    )


def user_addresses(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """One to three addresses per user, the first one the default."""
    key, j = F.col("user_id"), F.col("j")
    count = between(draw(seed, "address.count", F.col("id")), 1, 3)
    return rows.select(
        F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("j")
    ).select(
        (key * 3 + j).alias("id"),
        key,
        choice(draw(seed, "address.type", key, j), fixed.ADDRESS_TYPES).alias("address_type"),
        between(draw(seed, "address.postal", key, j), 10000, 99999).cast("string").alias("postal_code"),
        F.concat(letters(seed, "address.street", 10, key, j), F.lit(" street")).alias("address1"),
        F.concat(
            F.lit("Apt "), between(draw(seed, "address.flat", key, j), 1, 999).cast("string")
        ).alias("address2"),
        choice(draw(seed, "address.city", key, j), fixed.CITIES).alias("city"),
        (j == 0).alias("is_default"),
    )


def user_preferences(rows: DataFrame, category_count: Size, seed: int = SEED) -> DataFrame:
    key = F.col("id")
    return _sized(rows, category_count).select(
        key,
        key.alias("user_id"),
        _some(seed, "preference.categories", 5, key)
        .cast("array<string>")
        .alias("preferred_categories"),
        between(draw(seed, "preference.low", key), 10_000, 50_000).cast("decimal(10,2)").alias("price_range_min"),
        between(draw(seed, "preference.high", key), 100_000, 1_000_000)
        .cast("decimal(10,2)")
        .alias("price_range_max"),
    )


def product_price(product: Column, seed: int = SEED) -> Column:
    """The price of a product, from its id alone."""
    return between(draw(seed, "product.price", product), 10_000, 500_000)


def product_name(product: Column, seed: int = SEED) -> Column:
    """The name of a product, from its id alone."""
    return F.concat(
        choice(draw(seed, "product.kind", product), fixed.PRODUCT_NAMES),
        F.lit(" "),
        letters(seed, "product.name", 5, product),
    )


def products(rows: DataFrame, category_count: Size, brand_count: Size, seed: int = SEED) -> DataFrame:
    key = F.col("id")
    price = product_price(key, seed)
    name = product_name(key, seed)
    return rows.select(
        key,
        F.concat(F.lit("SKU-"), letters(seed, "product.sku", 12, key)).alias("sku"),
        name.alias("name"),
        F.concat(F.lit("Description for "), name).alias("description"),
        (draw(seed, "product.category", key) % _size(category_count) + 1).alias("category_id"),
        F.when(
            ~chance(draw(seed, "product.unbranded", key), 30),
            draw(seed, "product.brand", key) % _size(brand_count) + 1,
        ).alias("brand_id"),
        price.cast("decimal(10,2)").alias("price"),
        F.floor(price * 12 / 10).cast("decimal(10,2)").alias("compare_at_price"),
        between(draw(seed, "product.stock", key), 0, 1000).cast("int").alias("stock_quantity"),
        choice(draw(seed, "product.status", key), fixed.PRODUCT_STATES).alias("status"),
        chance(draw(seed, "product.featured", key), 10).alias("is_featured"),
    )


def product_images(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """One to five images per product, the first one the primary."""
    key, j = F.col("product_id"), F.col("j")
    count = between(draw(seed, "image.count", F.col("id")), 1, 5)
    return rows.select(
        F.col("id").alias("product_id"),
        product_name(F.col("id"), seed).alias("name"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("j"),
    ).select(
        (key * 5 + j).alias("id"),
        key,
        F.format_string(fixed.IMAGE_URL, key, j).alias("image_url"),
        F.format_string("Image %d for %s", j, F.col("name")).alias("alt_text"),
        (j == 0).alias("is_primary"),
    )


def reviews(rows: DataFrame, user_count: Size, product_count: Size, seed: int = SEED) -> DataFrame:
    key = F.col("id")
    rating = between(draw(seed, "review.rating", key), 1, 5).cast("int")

    def by_rating(good: str, fair: str, bad: str) -> Column:
        return F.when(rating >= 4, good).when(rating == 3, fair).otherwise(bad)

    return rows.select(
        key,
        (draw(seed, "review.product", key) % _size(product_count) + 1).alias("product_id"),
        (draw(seed, "review.user", key) % _size(user_count) + 1).alias("user_id"),
        rating.alias("rating"),
        by_rating(*fixed.REVIEW_TITLES).alias("title"),
        by_rating(*fixed.REVIEW_TEXTS).alias("content"),
        chance(draw(seed, "review.verified", key), 70).alias("is_verified_purchase"),
    )


def _order_lines(seed: int) -> Column:
    """The lines of an order as an array: position, product, quantity and price."""
    key = F.col("id")
    chosen = _some(seed, "order.products", MAX_ITEMS, key)
    return F.transform(
        chosen,
        lambda product, j: F.struct(
            j.cast("bigint").alias("j"),
            product.alias("product_id"),
            between(draw(seed, "order.quantity", key, j), 1, 3).alias("quantity"),
            product_price(product, seed).alias("price"),
        ),
    )


def orders(
    rows: DataFrame, user_count: Size, product_count: Size, *, today: Day, seed: int = SEED
) -> DataFrame:
    """Orders, a tenth of them by guests; the total is the sum of the lines plus a tenth.

    Order numbers carry the id, as a drawn number would repeat.
    """
    key = F.col("id")
    subtotal = F.aggregate(
        _order_lines(seed),
        F.lit(0).cast("bigint"),
        lambda total, line: total + line["quantity"] * line["price"],
    )
    return _sized(rows, product_count).select(
        key,
        F.concat(
            F.lit(f"ORD-{as_day(today):%Y%m%d}-"),
            F.lpad(key.cast("string"), F.greatest(F.length(key.cast("string")), F.lit(6)), F.lit("0")),
        ).alias("order_number"),
        F.when(
            ~chance(draw(seed, "order.guest", key), 10),
            draw(seed, "order.user", key) % _size(user_count) + 1,
        ).alias("user_id"),
        weighted(draw(seed, "order.status", key), fixed.ORDER_STATES, fixed.ORDER_WEIGHTS).alias("status"),
        subtotal.alias("subtotal"),
        day_in(draw(seed, "order.day", key), 2023, 2024).cast("timestamp_ntz").alias("created_at"),
    ).select(
        "id",
        "order_number",
        "user_id",
        "status",
        F.col("subtotal").cast("decimal(12,2)").alias("subtotal"),
        (F.col("subtotal").cast("decimal(12,2)") * F.lit("1.1").cast("decimal(2,1)"))
        .cast("decimal(12,2)")
        .alias("total_amount"),
        "created_at",
    )


def order_items(rows: DataFrame, product_count: Size, seed: int = SEED) -> DataFrame:
    """The one to five lines of each order, each of another product."""
    line = F.col("line")
    return _sized(rows, product_count).select(
        F.col("id").alias("order_id"), F.explode(_order_lines(seed)).alias("line")
    ).select(
        (F.col("order_id") * MAX_ITEMS + line["j"]).alias("id"),
        "order_id",
        line["product_id"].alias("product_id"),
        F.concat(F.lit("Product "), line["product_id"].cast("string")).alias("product_name"),
        line["quantity"].cast("int").alias("quantity"),
        line["price"].cast("decimal(10,2)").alias("unit_price"),
        (line["quantity"] * line["price"]).cast("decimal(10,2)").alias("total_price"),
    )


def _visitor(table: str, anonymous: int, user_count: Size, seed: int) -> list[Column]:
    """A user, or for a share of the rows a session without one."""
    key = F.col("id")
    unknown = chance(draw(seed, f"{table}.anonymous", key), anonymous)
    user = draw(seed, f"{table}.user", key) % _size(user_count) + 1
    return [
        F.when(~unknown, user).alias("user_id"),
        F.when(unknown, uuid_of(seed, f"{table}.session", key)).alias("session_id"),
    ]


def product_views(
    rows: DataFrame, user_count: Size, product_count: Size, *, now: str, seed: int = SEED
) -> DataFrame:
    key = F.col("id")
    return rows.select(
        key,
        (draw(seed, "view.product", key) % _size(product_count) + 1).alias("product_id"),
        *_visitor("view", 30, user_count, seed),
        between(draw(seed, "view.duration", key), 10, 300).cast("int").alias("view_duration"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    )


def search_logs(rows: DataFrame, user_count: Size, *, now: str, seed: int = SEED) -> DataFrame:
    """Searches; none of them has a clicked product."""
    key = F.col("id")
    suffix = F.when(
        chance(draw(seed, "search.suffixed", key), 30),
        F.concat(F.lit(" "), letters(seed, "search.suffix", 5, key)),
    ).otherwise("")
    return rows.select(
        key,
        *_visitor("search", 40, user_count, seed),
        F.concat(choice(draw(seed, "search.text", key), fixed.SEARCH_TEXTS), suffix).alias("search_query"),
        between(draw(seed, "search.results", key), 0, 100).cast("int").alias("results_count"),
        F.lit(None).cast("bigint").alias("clicked_product_id"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"),
    )


def data_set(spark: SparkSession, *, now: str, scale: float = 1.0, seed: int = SEED) -> dict[str, DataFrame]:
    """All synthetic tables, lazily; ``scale`` multiplies the row counts but for brands."""
    n = {
        name: rows if name == "brands" else max(int(rows * scale), 1) for name, rows in fixed.ROWS.items()
    }
    tree = categories(root_categories(spark), seed)
    category_count = len(fixed.ROOT_CATEGORIES) * (CHILDREN + 1)

    def rows(name: str) -> DataFrame:
        return ids(spark, n[name])

    return {
        "categories": tree,
        "brands": brands(rows("brands"), seed),
        "users": users(rows("users"), seed),
        "user_addresses": user_addresses(rows("users"), seed),
        "user_preferences": user_preferences(rows("users"), category_count, seed),
        "products": products(rows("products"), category_count, n["brands"], seed),
        "product_images": product_images(rows("products"), seed),
        "product_reviews": reviews(rows("reviews"), n["users"], n["products"], seed),
        "orders": orders(rows("orders"), n["users"], n["products"], today=now[:10], seed=seed),
        "order_items": order_items(rows("orders"), n["products"], seed),
        "product_views": product_views(rows("views"), n["users"], n["products"], now=now, seed=seed),
        "search_logs": search_logs(rows("searches"), n["users"], now=now, seed=seed),
    }
