"""Column functions on article numbers (GTIN-8, -12, -13, -14). Normalised numbers are strings of 14 digits."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, let, sql_let


def digits(value: Column | str) -> Column:
    return F.regexp_replace(col(value).cast("string"), r"[^0-9]+", "")


def weighted_sum(number: Column, digits_: int, first: int) -> Column:
    """Of a bigint's last digits from the right: every other one times three, the first times ``first`` (1 or 3)."""
    total, power = None, 1
    for i in range(digits_):
        digit = F.call_function("mod", F.call_function("div", number, F.lit(power).cast("bigint")) if i else number, F.lit(10).cast("bigint"))
        digit = digit * 3 if (i % 2 == 0) == (first == 3) else digit
        total = digit if total is None else total + digit
        power *= 10
    return total


def check_digit_of(number: Column, digits_: int = 13) -> Column:
    """Of a bigint of up to 13 digits. The number is read once for each digit: it should be cheap."""
    return F.call_function("mod", 10 - F.call_function("mod", weighted_sum(number, digits_, 3), F.lit(10).cast("bigint")), F.lit(10).cast("bigint")).cast("int")


def check_digit(body: Column | str) -> Column:
    """Of up to 13 digits: weights 3, 1, 3, ... from the left of the padded body."""
    return let(F.substring(F.lpad(digits(body), 13, "0"), 1, 13).cast("bigint"), lambda number: check_digit_of(number))


def normalize_gtin(value: Column | str) -> Column:
    """14 digits, or null if length or check digit are wrong or all digits are zero."""
    return bound(col(value).cast("string"), normalized_sql("t"))


@cache
def normalized_sql(t: str) -> str:
    """Of a SQL text. The check is integer arithmetic: digits from the right, every other one times three, the last once."""
    total = " + ".join(f"n DIV {10**i}L % 10 * {1 if i % 2 == 0 else 3}" for i in range(14))
    checked = f"n > 0 AND ({total}) % 10 = 0"
    return sql_let(f"regexp_replace({t}, '[^0-9]+', '')", "d", f"CASE WHEN length(d) IN (8, 12, 13, 14) AND {sql_let("try_cast(d AS BIGINT)", "n", checked)} THEN lpad(d, 14, '0') END")


def is_valid_gtin(value: Column | str) -> Column:
    return normalize_gtin(value).isNotNull()


def display_gtin(gtin14: Column | str) -> Column:
    """13 digits where they are enough."""
    g = col(gtin14)
    short = F.regexp_replace(g, "^0+", "")
    return F.when(F.length(short) <= 13, F.lpad(short, 13, "0")).otherwise(g)


def same_gtin(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(normalize_gtin(a) == normalize_gtin(b), F.lit(False))
