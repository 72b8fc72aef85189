"""Checked values: money, numbers, identifiers, dates, and objects merged by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def text_or_error(x: Column, field: str, most: int) -> Column:
    """Struct of the trimmed text, cut to `most`, and an error where it is empty."""
    t = F.nullif(F.trim(x), F.lit(""))
    return F.struct(F.left(t, F.lit(most)).alias("value"), F.when(t.isNull(), f"missing_{field}").alias("error"))


def count_or_error(json: Column, field: str) -> Column:
    """Struct of a whole number of 0 or more, and an error for anything else, booleans too; json is the value as JSON text."""
    good = json.rlike(r"^[0-9]+$")
    return F.struct(F.when(good, json.try_cast("bigint")).alias("value"), F.when(~F.coalesce(good, F.lit(False)), f"invalid_{field}").alias("error"))


def day_bounds(day: Column) -> Column:
    """First and last second of a date, as seconds since 1970 in the session's zone."""
    start = F.unix_timestamp(day.cast("timestamp"))
    return F.struct(start.alias("first"), (start + 86_399).alias("last"))


def package_path(name: Column) -> Column:
    """A package's name as part of a URL, in which @ and / stay."""
    return F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%40"), F.lit("@")), F.lit("%2F"), F.lit("/"))


def merged(old: Column, new: Column) -> Column:
    """Two maps as one, in which the new one's values win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def uuid_or_null(x: Column) -> Column:
    return F.when(x.rlike(UUID), F.lower(x))


def decimal_or_null(x: Column) -> Column:
    return x.try_cast("decimal(38,6)")


def one_line(x: Column) -> Column:
    """Text with its blanks collapsed and without double quotes."""
    return F.trim(F.replace(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit('"'), F.lit("")))


def money(amount: Column, currency: Column, required: bool = False) -> Column:
    """Struct of the amount to two places, half to even, the currency in capitals, and what is wrong with them."""
    code = F.upper(F.trim(currency))
    none = amount.isNull() & currency.isNull()
    error = F.when(F.lit(not required) & none, F.lit(None)).when(amount.isNull() | (amount <= 0), "amount_not_positive").when(~F.coalesce(code.rlike("^[A-Z]{3}$"), F.lit(False)), "currency_not_iso")
    good = error.isNull() & ~none
    return F.struct(F.when(good, F.bround(amount.cast("decimal(18,6)"), 2)).alias("amount"), F.when(good, code).alias("currency"), error.alias("error"))


def sampling_frame(q: Column) -> Column:
    """Whether a search is one token that names a repository."""
    words = F.split(F.trim(q), r"\s+")
    return F.coalesce((F.size(words) == 1) & F.lower(F.get(words, F.lit(0))).startswith("repo:"), F.lit(False))
