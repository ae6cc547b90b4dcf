"""Literal expectations of the column functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.functions import text as T


def each(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_prices(spark):
    texts = ["€ 12,99", "12.99", "1.234,56", "€1,234.56", "Nu voor 9,-", "geen prijs", "1.234", "1234,56", "1,234,56", "12 345,50", "-3,5", "&euro; 7,5", None, ""]
    assert each(spark, M.parse_price, *texts) == [12.99, 12.99, 1234.56, 1234.56, 9.0, None, 1234.0, 123.0, 1.23, 12345.5, -3.5, 7.5, None, None]


def test_pack_sizes(spark):
    texts = ["12 x 52 doekjes", "400ml", "1,5 liter", "2 kg", "maat 4 luiers", "maat 12 luiers", "maat 4 luiers 160 stuks", "3x500 ml", "44 st.", "0 stuks 5 stuks", "luierbroekjes", None]
    got = [r and (r["amount"], r["unit"]) for r in each(spark, M.parse_pack_size, *texts)]
    assert got == [(624, "stuk"), (400, "ml"), (1500, "ml"), (2000, "g"), None, None, (160, "stuk"), (1500, "ml"), None, (5, "stuk"), None, None]


def test_unit_prices(spark):
    df = spark.createDataFrame([(39.99, 160.0, "stuk"), (9.49, 30.0, "g"), (None, 3.0, "g"), (1.0, None, "ml"), (1.0, 0.0, "ml")], "p double, a double, u string")
    got = [r[0] for r in df.select(M.unit_price(F.col("p"), F.col("a"), F.col("u"))).collect()]
    assert got == [0.2499, 31.63, None, None, None]
    assert [r[0] for r in df.select(M.monthly_cost(F.lit(0.18))).collect()][0] == 27.0


def test_labels(spark):
    df = spark.range(1).select(
        M.format_unit_price(F.lit(0.25)), M.format_unit_price(F.lit(12.5)), M.pack_label(F.lit(44.0), F.lit("stuk"), F.lit("luier")), M.pack_label(F.lit(400.0), F.lit("ml"), F.lit("x")), M.unit_label(F.lit("g"))
    )
    assert list(df.first()) == ["0.250", "12.50", "44 luiers", "400 ml", "per 100 g"]


def test_article_numbers(spark):
    assert each(spark, G.is_valid_gtin, "2000000000039", "2000000000015", "2000000000030", "12345", "0000000000000", None) == [True, True, False, False, False, False]
    assert each(spark, G.check_digit, "200000000003") == [9]
    assert each(spark, lambda c: G.display_gtin(G.normalize_gtin(c)), "20-0000 0000039", "73513537") == ["2000000000039", "0000073513537"]


@settings(max_examples=20, deadline=None)
@given(bodies=st.lists(st.integers(1, 10**12 - 1), min_size=1, max_size=20))
def test_check_digit_makes_a_number_valid(spark, bodies):
    texts = [str(b).zfill(12) for b in bodies]
    assert all(each(spark, lambda c: G.is_valid_gtin(F.concat(c, G.check_digit(c).cast("string"))), *texts))


def test_plain_text_and_entities(spark):
    assert each(spark, T.plain, "Crème Bébé, 100 g!", "", None) == ["creme bebe 100 g", "", None]
    assert each(spark, T.decode_entities, "a &amp;lt; &#233; &#x1F600; &euro; &foo; &#1114112;", "x", None) == ["a &lt; é 😀 € &foo; ", "x", None]
    assert each(spark, T.strip_tags, "<p>a<script>x</script> b&nbsp;c</p>") == ["a b c"]


@pytest.mark.parametrize(("href", "want"), [("b", "https://a.nl/x/b"), ("/c", "https://a.nl/c"), ("//d.nl/e", "https://d.nl/e"), ("http://q/", "http://q/"), ("?r=1", "https://a.nl/x/y?r=1")])
def test_resolve(spark, href, want):
    assert each(spark, lambda c: T.resolve(c, F.lit("https://a.nl/x/y?z=1")), href) == [want]


def test_url_parts(spark):
    assert each(spark, T.url_host, "https://www.Shop.nl/a b?c", "no url", None) == ["shop.nl", None, None]
    assert each(spark, T.slug_title, "https://a.b/x/pampers-baby-dry/p/123?q=1", "https://a.b/some_thing.html", "https://a.b/") == ["pampers baby dry", "some thing", ""]
    html = '<meta content="5 &amp; 6" name="k"><meta property="og:x" content="y"><title> A\n&euro; </title>'
    assert each(spark, lambda c: T.meta_content(c, "k"), html, "") == ["5 & 6", None]
    assert each(spark, lambda c: T.meta_content(c, "og:x"), html) == ["y"]
    assert each(spark, T.page_title, html, "none") == ["A €", None]


def test_trim_and_equal_numbers(spark):
    assert each(spark, T.trim, "\t a b\u00a0\u2003\n", "\r\n", None) == ["a b", "", None]
    df = spark.createDataFrame([("73513537", "0000073513537", True), ("73513537", "73513538", False), (None, None, False), ("99999999999999999999", "1", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(G.same_gtin("a", "b"), "want").collect())
    labels = [r[0] for r in spark.createDataFrame([("k",), ("z",)], "c string").select(M.piece_label(F.col("c"), {"k": "per kan"})).collect()]
    assert labels == ["per kan", "per stuk"]
