"""Seeded pseudo-random columns.

Every draw is a digest of the seed, a name and the key of the row. The same row
gets the same values whatever the partitioning, and again in a retried task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.fixed import FAMILY_NAMES, GIVEN_NAMES, MAIL_HOSTS


def digest(seed: int, name: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), *(k.cast("string") for k in keys)))


def draw(seed: int, name: str, *keys: Column) -> Column:
    """A uniform number of 60 bits."""
    return F.conv(F.substring(digest(seed, name, *keys), 1, 15), 16, 10).cast("bigint")


def between(number: Column, low: int, high: int) -> Column:
    """A number from a closed range."""
    return F.lit(low) + number % (high - low + 1)


def chance(number: Column, percent: int) -> Column:
    return number % 100 < percent


def choice(number: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def weighted(number: Column, values: Sequence[str], weights: Sequence[int]) -> Column:
    """One of the values, each as often as its share of the weights."""
    place, bound = number % sum(weights), 0
    picked = None
    for value, weight in zip(values, weights):
        bound += weight
        picked = F.when(place < bound, value) if picked is None else picked.when(place < bound, value)
    return picked


def letters(seed: int, name: str, length: int, *keys: Column) -> Column:
    """Up to 22 letters and digits."""
    text = F.base64(F.unhex(digest(seed, name, *keys)))
    return F.translate(F.substring(text, 1, length), "+/", "xy")


def uuid_of(seed: int, name: str, *keys: Column) -> Column:
    return F.regexp_replace(
        digest(seed, name, *keys), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"
    )


def day_in(number: Column, first_year: int, last_year: int) -> Column:
    """A day from the start of one year to the end of another."""
    start = date(first_year, 1, 1)
    days = (date(last_year, 12, 31) - start).days
    return F.date_add(F.lit(start), (number % (days + 1)).cast("int"))


def email(seed: int, *keys: Column) -> Column:
    host = choice(draw(seed, "mail.host", *keys), MAIL_HOSTS)
    return F.concat(letters(seed, "mail.box", 8, *keys), F.lit("@"), host, F.lit(".com"))


def phone(seed: int, *keys: Column) -> Column:
    def block(name: str) -> Column:
        return between(draw(seed, name, *keys), 1000, 9999)

    return F.format_string("010-%d-%d", block("phone.first"), block("phone.second"))


def person_name(seed: int, *keys: Column) -> Column:
    return F.concat(
        choice(draw(seed, "name.family", *keys), FAMILY_NAMES),
        choice(draw(seed, "name.given", *keys), GIVEN_NAMES),
    )
