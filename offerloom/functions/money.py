"""Column functions on prices, pack sizes and unit prices.

Prices are doubles. Rounding is half up on the binary value plus 2**-52, so that both engines of a comparison can state it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, bound, col, decoded_sql, quoted, spaced_sql, sql_let

# fixed values: words for pieces, and words that name a size number
PIECES = r"stuks|stuk|st\.|luiers|luier|doekjes|doekje|wipes|tissues|billendoekjes|pants|broekjes"
SIZE_WORDS = r"maat|maten|size|mt\.?|nr\.?"
MEASURES = "ml|milliliter|l|liter|g|gr|gram|kg"
END = r"(?![A-Za-z0-9_])"
# a word end has to be one: behind "st." a word character has to follow, behind a letter none may
WORD_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PER_MONTH = 150


def round_half_up(x: Column, digits: int, epsilon: bool = True) -> Column:
    scale = float(10**digits)
    x = x + F.lit(2.0**-52) if epsilon else x
    return F.floor(x * scale + 0.5).cast("double") / scale


def parse_price(text: Column | str) -> Column:
    """The first number of a text in Dutch or English notation, rounded to cents; null without one.

    Of comma and dot the last one is the decimal mark; a comma alone with more than two digits behind it, or a dot alone with
    exactly three, parts thousands. Four or more digits that aren't grouped are cut after three (``1234,56`` is 123).
    """
    return bound(col(text), price_sql())


@cache
def price_sql() -> str:
    number = quoted(rf"(-?\d{{1,3}}(?:(?:[.,]|{WS})\d{{3}})*(?:[.,]\d{{1,2}})?)")
    raw = f"regexp_replace(regexp_extract({sql_let(decoded_sql("t"), "e", "e")}, {number}, 1), {quoted(WS)}, '')"
    # places of the last comma and dot, 0 without one
    comma, dot = "(length(r) - length(substring_index(r, ',', -1)))", "(length(r) - length(substring_index(r, '.', -1)))"
    point = f"regexp_replace({{r}}, {quoted("^([^,]*),")}, {quoted("$1.")})"
    clean = f"""CASE WHEN {comma} > 0 AND {dot} > 0 AND {comma} > {dot} THEN {point.format(r="replace(r, '.', '')")} WHEN {comma} > 0 AND {dot} > 0 THEN replace(r, ',', '')
      WHEN {comma} > 0 AND length(r) - {comma} <= 2 THEN {point.format(r="r")} WHEN {comma} > 0 THEN replace(r, ',', '')
      WHEN {dot} > 0 AND length(r) - {dot} = 3 THEN replace(r, '.', '') ELSE r END"""
    head = f"regexp_extract({clean}, {quoted(r"^(-?\d+(?:\.\d+)?)")}, 1)"
    return sql_let(raw, "r", sql_let(head, "h", f"CASE WHEN h <> '' THEN {half_up_sql("double(h)")} END"))


def half_up_sql(x: str) -> str:
    """``round_half_up`` to cents."""
    return f"double(floor(({x} + {2.0**-52!r}D) * 100D + 0.5D)) / 100D"


def parse_pack_size(text: Column | str) -> Column:
    """struct<amount, unit> in pieces (stuk), ml or g, from a title or a size field; null without one.

    In this order: ``a x b pieces``, ``a x b measure``, the first number of pieces that no size word precedes, the first measure.
    """
    return bound(col(text), pack_size_sql())


@cache
def pack_size_sql() -> str:
    plain = f"lower({sql_let(decoded_sql("t"), "w", spaced_sql("w"))})"
    times = quoted(rf"(\d{{1,3}})\s*[x×]\s*(\d{{1,4}})\s*(?:{PIECES}){WORD_END}")
    measures = quoted(rf"(\d{{1,3}})\s*[x×]\s*(\d{{1,4}}(?:[.,]\d+)?)\s*({MEASURES}){END}")
    one = quoted(rf"(\d{{1,4}}(?:[.,]\d+)?)\s*({MEASURES}){END}")
    counted = quoted(rf"((?:(?:{SIZE_WORDS})\s*)?\d{{1,4}}\s*(?:{PIECES}){WORD_END})")
    pack = lambda amount, unit: f"named_struct('amount', double({amount}), 'unit', {unit})"

    def base(amount: str, unit: str, factor: str = "1") -> str:
        """Litres and kilograms as millilitres and grams; null for an amount that isn't positive."""
        scaled = half_up_sql(f"(a * CASE WHEN {unit} IN ('l', 'liter', 'kg') THEN 1000D ELSE 1D END)")
        whole = scaled if factor == "1" else half_up_sql(f"({scaled} * {factor})")
        kind = f"CASE WHEN {unit} IN ('ml', 'milliliter', 'l', 'liter') THEN 'ml' ELSE 'g' END"
        return sql_let(f"double(replace({amount}, ',', '.'))", "a", f"CASE WHEN a > 0 THEN {pack(whole, kind)} END")

    part = lambda pattern, k: f"regexp_extract(p, {pattern}, {k})"
    pieces = f"try_element_at(filter(transform(filter(regexp_extract_all(p, {counted}, 1), c -> c RLIKE '^[0-9]'), c -> int(regexp_extract(c, '^([0-9]+)', 1))), n -> n > 0), 1)"
    product = f"CASE WHEN {part(times, 1)} <> '' THEN {pack(f"int({part(times, 1)}) * int({part(times, 2)})", "'stuk'")} END"
    many = f"CASE WHEN {part(measures, 1)} <> '' THEN {base(part(measures, 2), part(measures, 3), f"int({part(measures, 1)})")} END"
    some = sql_let(pieces, "n", f"CASE WHEN n IS NOT NULL THEN {pack("n", "'stuk'")} END")
    single = f"CASE WHEN {part(one, 1)} <> '' THEN {base(part(one, 1), part(one, 2))} END"
    return sql_let(plain, "p", f"CASE WHEN p RLIKE '[0-9]' THEN coalesce({product}, {many}, {some}, {single}) END")


def base_unit_price(price: Column, amount: Column) -> Column:
    return F.when((amount != 0) & price.isNotNull(), round_half_up(price / F.when(amount != 0, amount), 4))


def unit_price(price: Column, amount: Column, unit: Column) -> Column:
    """Per piece, or per 100 ml or g; rounded before and after the multiplication."""
    base = base_unit_price(price, amount)
    return F.when(unit == "stuk", round_half_up(base, 4)).otherwise(round_half_up(base * 100, 4))


def unit_label(unit: Column) -> Column:
    return F.when(unit == "stuk", "per stuk").when(unit == "ml", "per 100 ml").when(unit == "g", "per 100 g")


def monthly_cost(price: Column, per_month: int = PER_MONTH) -> Column:
    return round_half_up(price * per_month, 2, epsilon=False)


def piece_label(category: Column, labels: dict[str, str]) -> Column:
    out = F.lit("per stuk")
    for k, v in labels.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def format_unit_price(price: Column) -> Column:
    """Three decimals under one euro, two from there on."""
    return F.when(price < 1, F.format_number(price, 3)).otherwise(F.format_number(price, 2))


def pack_label(amount: Column, unit: Column, noun: Column) -> Column:
    number = F.regexp_replace(amount.cast("string"), r"\.0$", "")
    return F.when(unit == "stuk", F.concat(number, F.lit(" "), noun, F.when(amount == 1, "").otherwise("s"))).otherwise(F.concat_ws(" ", number, unit))
