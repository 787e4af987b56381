"""Row lookups: each is a filter that Spark pushes to the scan, or a keyed join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import Day, as_day


def by_key(df: DataFrame, value, key: str = "id") -> DataFrame:
    """Rows with one key: none or one when the key is unique."""
    return df.where(F.col(key) == F.lit(value))


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key occurs in the single column of ``keys``."""
    wanted = keys.select(F.col(keys.columns[0]).alias(key))
    return df.join(wanted, key, "left_semi")


def find_all(df: DataFrame) -> DataFrame:
    return df


def orders_of_user(orders: DataFrame, user_id: int) -> DataFrame:
    return by_key(orders, user_id, "user_id")


def orders_with_status(orders: DataFrame, status: str) -> DataFrame:
    return by_key(orders, status, "status")


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """Exact, case-sensitive match."""
    return by_key(users, email, "email")


def existing_emails(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requested e-mails, each once, with a flag that tells whether a user has it."""
    known = users.select("email", F.lit(True).alias("known")).distinct()
    return (
        requests.select("email")
        .distinct()
        .join(known, "email", "left")
        .select("email", F.coalesce("known", F.lit(False)).alias("exists"))
    )


def products_in_category(products: DataFrame, category) -> DataFrame:
    column = "category" if "category" in products.columns else "category_id"
    return by_key(products, category, column)


def products_named_like(products: DataFrame, part: str) -> DataFrame:
    """Products whose name contains a text, case-sensitive."""
    return products.where(F.col("name").contains(part))


def user_by_email_any_case(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == F.lower(F.lit(email)))


def active_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ACTIVE")


def recent_orders(orders: DataFrame, *, as_of: Day, months: int = 6) -> DataFrame:
    """Orders of the last months, newest first."""
    start = F.add_months(F.lit(as_day(as_of)), -months).cast("timestamp_ntz")
    return orders.where(F.col("created_at") >= start).orderBy(F.col("created_at").desc(), "id")


def high_rated_reviews(reviews: DataFrame, minimum: int = 4) -> DataFrame:
    """Approved reviews from a rating on, per product with the best first."""
    kept = reviews.where((F.col("rating") >= minimum) & (F.col("status") == "APPROVED"))
    return kept.orderBy("product_id", F.col("rating").desc())


def with_member(df: DataFrame, array: str, value) -> DataFrame:
    """Rows whose array column holds a value."""
    return df.where(F.array_contains(array, value))


def with_any_member(df: DataFrame, array: str, values: Sequence) -> DataFrame:
    """Rows whose array column holds at least one of the values."""
    wanted = F.array(*(F.lit(v) for v in values))
    return df.where(F.arrays_overlap(F.col(array), wanted))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int) -> DataFrame:
    """The first rows of each key in an order, e.g. the newest ones.

    Spark cuts each key to the wanted rows before the shuffle as well as after
    it, so a hot key does not travel whole.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= rows)


def clustered_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows ranged by key and then by order, the layout of a composite index.

    Ranges cut through a hot key where needed, so no task gets all of it.
    """
    by = [F.col(k) for k in keys] + list(order)
    return df.repartitionByRange(*by).sortWithinPartitions(*by)
