"""Checks of number-like values, as native column expressions; null counts as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.text import digits

# Fixed value: area and mobile prefixes that telephone numbers begin with.
PHONE_PREFIX = "(?:01[016789]|02|0[3-6][1-5]|070|050[0-9])"


def _at(d: Column, k: int) -> Column:
    return F.coalesce(F.substr(d, F.lit(k + 1), F.lit(1)).try_cast("int"), F.lit(0))


def resident_number(c: Column) -> Column:
    """Month and day can be; a checksum isn't looked at, as newer numbers have none."""
    d = digits(c)
    month, day = F.substr(d, F.lit(3), F.lit(2)).try_cast("int"), F.substr(d, F.lit(5), F.lit(2)).try_cast("int")
    return F.coalesce((F.length(d) >= 6) & month.between(1, 12) & day.between(1, 31), F.lit(False))


def business_number(c: Column) -> Column:
    """Weighted sum of nine digits, with the tens of five times the ninth, against the tenth."""
    d = digits(c)
    total = sum((_at(d, k) * w for k, w in enumerate((1, 3, 7, 1, 3, 7, 1, 3, 5))), F.lit(0)) + F.floor(_at(d, 8) * 5 / 10)
    return F.coalesce((F.length(d) == 10) & ((F.lit(10) - total % 10) % 10 == _at(d, 9)), F.lit(False))


def card_number(c: Column) -> Column:
    d = digits(c)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def account_number(c: Column) -> Column:
    """10 to 16 digits that aren't all the same, and if 12 or fewer, don't begin like a telephone number."""
    d = digits(c)
    same = F.length(F.replace(d, F.left(d, F.lit(1)), F.lit(""))) == 0
    return F.coalesce(F.length(d).between(10, 16) & ~same & ~((F.length(d) <= 12) & d.rlike(f"^{PHONE_PREFIX}")), F.lit(False))
