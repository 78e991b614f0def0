"""Checks of identifiers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the CUIT check digit.
CUIT_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)


def cuit_ok(value: Column) -> Column:
    """eleven digits whose last completes the weighted sum to a multiple of 11; a digit of 10 doesn't exist."""
    digits = F.regexp_replace(value, "[^0-9]+", "")
    total = sum((F.substring(digits, k + 1, 1).try_cast("int") * w for k, w in enumerate(CUIT_WEIGHTS)), F.lit(0))
    last = F.substring(digits, 11, 1).try_cast("int")
    return F.when(F.length(digits) == 11, (total + last) % 11 == 0).otherwise(F.lit(False))


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits under Luhn."""
    digits = F.regexp_replace(value, "[^0-9]+", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def iban_ok(value: Column) -> Column:
    """remainder 1 modulo 97 with the first four characters moved to the end and A to Z read as 10 to 35."""
    bare = F.upper(F.regexp_replace(value, r"\s+", ""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.when(bare.rlike("^[A-Z0-9]{4,}$"), rest == 1).otherwise(F.lit(False))


def date_in_range(value: Column) -> Column:
    """F8: day 1 to 31 and month 1 to 12; no calendar."""
    p = F.split(value, "[/-]")
    day, month = F.try_element_at(p, F.lit(1)).try_cast("int"), F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.coalesce(day.between(1, 31) & month.between(1, 12), F.lit(False))
