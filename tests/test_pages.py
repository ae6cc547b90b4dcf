"""Product pages, candidates, links and robots rules."""

import json

import pytest
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.operators import pages as PG


def ld(*nodes, kind='"application/ld+json"'):
    return "".join(f"<script type={kind}>{n if isinstance(n, str) else json.dumps(n)}</script>" for n in nodes)


def facts(spark, *pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return [r.asDict() for r in PG.product_facts(df).orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def gtin(spark):
    return spark.range(1).select(F.concat(F.lit("200000000003"), G.check_digit(F.lit("200000000003")).cast("string"))).first()[0]


def test_facts(spark, gtin):
    lamp = {"@type": "Product", "name": "Bureaulamp <b>Sol</b>, 3 stuks", "sku": "bl-7", "image": [[{"url": "https://beeld.example/l.png"}]]}
    lamp["offers"] = {"price": "61.20", "priceCurrency": "chf", "availability": "https://schema.org/PreOrder", "gtin13": gtin}
    graph = ld("{not json", {"@graph": [{"@type": "BreadcrumbList"}, lamp]})
    meta = f'<meta content="8,05" property="og:price:amount"><meta name="og:title" content="Zeep 75 g &amp; doos"><meta property="product:availability" content="in stock"><p>barcode nr {gtin}</p>'
    two = ld([{"@type": ["Thing", "Product"], "name": "Mok", "offers": [{"price": "11,00"}, {"offers": [{"lowPrice": "4,75", "availability": "SoldOut"}]}]}], kind="'application/ld+json'")
    a, b, c, d, e = facts(spark, graph, meta, two, None, '<title> Kan\n</title><i data-product-price="1.050,00">')
    assert (a["page_source"], a["page_price"], a["currency"], a["in_stock"], a["title"], a["amount"], a["page_gtin"], a["sku"], a["image"]) == ("json-ld", 61.2, "CHF", True, "Bureaulamp Sol , 3 stuks", 3.0, "0" + gtin, "bl-7", "https://beeld.example/l.png")
    assert (b["page_source"], b["page_price"], b["in_stock"], b["title"], b["amount"], b["unit"], b["page_gtin"]) == ("meta", 8.05, True, "Zeep 75 g & doos", 75.0, "g", "0" + gtin)
    assert (c["page_price"], c["in_stock"], c["title"]) == (4.75, False, "Mok")
    assert d["page_price"] is None and d["page_source"] is None and d["in_stock"] is None
    assert (e["page_price"], e["page_source"], e["title"]) == (1050.0, "attribute", "Kan")


def test_what_json_leaves_open_is_read_from_meta(spark):
    """A condition isn't a stock word, nulls are passed over, and a product without a price takes the page's."""
    stock = '<meta property="product:availability" content="in stock">'
    node = {"@type": "Product", "name": "Vaas", "offers": {"price": 3, "availability": None, "itemCondition": "https://schema.org/NewCondition"}}
    spec = {"@type": "Product", "name": "Vaas", "offers": {"price": None, "lowPrice": None, "priceSpecification": {"price": "2,40", "priceCurrency": "eur"}}}
    none = {"@type": "Product", "name": "Vaas"}
    a, b, c, d = facts(spark, ld(node) + stock, ld(node), ld(spec), ld(none) + '<meta name="price" content="9,10"><meta property="og:availability" content="Uitverkocht">')
    assert (a["in_stock"], b["in_stock"]) == (True, None)
    assert (c["page_price"], c["currency"]) == (2.4, "EUR")
    assert (d["page_price"], d["page_source"], d["in_stock"]) == (9.1, "json-ld", False)


def test_numbers_stay_numbers(spark):
    """A JSON number is the price; a text goes by the rules for texts, when offers are ordered too."""
    lamp = lambda **offer: ld({"@type": "Product", "name": "Lamp", "offers": offer})
    many = lambda *prices: ld({"@type": "Product", "name": "Lamp", "offers": [{"price": p} for p in prices]})
    rows = facts(spark, lamp(price=1299), lamp(price=1299.5), lamp(price=45000), lamp(lowPrice=0.005), many("1234,56", "500"), many(2200, "2.100,00", None, "gratis"), lamp(price=["12,50"]), lamp(price={"value": 3}), lamp(price=1e308))
    assert [r["page_price"] for r in rows] == [1299.0, 1299.5, 45000.0, 0.01, 123.0, 2100.0, 12.5, None, None]


def test_hostile_pages_are_rows(spark, gtin):
    """Lists for images, half a surrogate pair, deep nesting and odd types cost nothing but themselves."""
    good = {"@type": "Product", "name": "Lamp", "offers": {"price": 5}}
    images = [{"url": ["https://beeld.example/a.png"]}, [[{"contentUrl": "https://beeld.example/b.png"}]], {"url": {"x": 1}}, [], 7]
    pages = [ld(good | {"image": i}) for i in images] + [ld('{"@type":"Product","name":"Lamp \\ud83d","offers":{"price":5}}'), ld("[" * 200_000) + ld(good), ld('{"a":' * 5000) + ld(good)]
    pages += [ld({"@type": ["Product", 3, None], "name": ["Lamp", "x"], "offers": [None, 4, [], {"price": 5}]}), ld({"@type": {"a": 1}}, good), ld([[[{"@graph": {"@graph": [good | {"sku": 12, "gtin": int(gtin)}]}}]]])]
    rows = facts(spark, *pages)
    assert [r["page_price"] for r in rows] == [5.0] * len(pages)
    assert [r["image"] for r in rows[:5]] == ["https://beeld.example/a.png", "https://beeld.example/b.png", None, None, None]
    assert rows[5]["title"].startswith("Lamp ") and rows[8]["title"] == "Lamp,x" and (rows[10]["sku"], rows[10]["page_gtin"]) == ("12", "0" + gtin)


def test_identifiers_below_a_product(spark, gtin):
    """The nearest in the order offers, variants; at most three steps down; a second product's where the first lacks them."""
    deep = {"@type": "Product", "hasVariant": [{"offers": {"gtin": gtin}}]}
    deeper = {"@type": "Product", "hasVariant": [{"offers": [{"gtin13": gtin}]}], "isVariantOf": {"sku": " v-1 ", "mpn": "m"}}
    two = ld({"@type": "Product", "name": "A", "productID": "ean:" + gtin}, {"@type": "ProductGroup", "sku": "s", "mpn": "m2"}, {"@type": "Product", "mpn": "m3"})
    a, b, c = facts(spark, ld(deep), ld(deeper), two)
    assert a["page_gtin"] == "0" + gtin and b["page_gtin"] is None and (b["sku"], b["mpn"]) == ("v-1", "m")
    assert (c["page_gtin"], c["sku"], c["mpn"]) == ("0" + gtin, "s", "m2")


def test_meta_elements(spark):
    """Either order of attributes, several names on one element, the first of equal keys, keys in any case; no Python in the plan."""
    page = '<META NAME="SKU" itemprop="og:title" content="k&amp;1 "><meta content="8,05" property="og:price:amount"><meta property="og:price:amount" content="7,10"><meta name="skuu" content="x">'
    (r,) = facts(spark, page)
    assert (r["sku"], r["title"], r["page_price"], r["page_source"]) == ("k&1", "k&1", 7.1, "meta")
    df = PG.product_facts(spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_candidates(spark):
    html = """<a href="\n/rode-stoel/art/5?kleur=rood" title="\tRode stoel met leuning\n">Kijk</a><a href="/rode-stoel/art/5#x">Rode stoel met leuning en kussen</a>
<a href="https://elders.example/stoel/art/6">Elders</a><a href="/contact">Contact</a><a href="/groene-kruk/art/71"><img></a><a href="/verborgen/art/9">"""
    only_bare = '<a href="/losse-plank/art/3"><a href="/contact">'
    sites = spark.createDataFrame([("m", "meubel.example", r"^/[a-z-]+/art/\d+")], "shop string, host string, path_pattern string")
    pages = spark.createDataFrame([(1, "https://www.meubel.example/alle?p=1", html), (2, "https://meubel.example/", only_bare)], "page_id int, url string, html string")
    got = {r["url"]: r["title"] for r in PG.candidates(pages, sites).collect()}
    assert got == {"https://www.meubel.example/rode-stoel/art/5": "Rode stoel met leuning en kussen", "https://www.meubel.example/groene-kruk/art/71": "art", "https://meubel.example/losse-plank/art/3": "art"} or got == {
        "https://www.meubel.example/rode-stoel/art/5": "Rode stoel met leuning en kussen", "https://www.meubel.example/groene-kruk/art/71": "groene kruk", "https://meubel.example/losse-plank/art/3": "losse plank",
    }


def test_hosts_and_paths(spark):
    urls = {
        "https://my_shop.example/p/a|b?x=1": ("my_shop.example", "/p/a|b"), "http://WWW.Winkel.Example:8080": ("winkel.example", "/"), "https://u:p@h.example/p/[x]#y": ("h.example", "/p/[x]"),
        "https://h.example/50%korting": ("h.example", "/50%korting"), "https://h.example/a b": ("h.example", "/a%20b"), "https://[2001:db8::1]:80/x": ("[2001:db8::1]", "/x"), "https://h.example?q": ("h.example", "/"),
        "https://café.example/ü": ("café.example", "/ü"), "/p/1": (None, None), "https://": (None, None), "https://a b/c": (None, None), "https://a|b/c": (None, None), "mailto:x@y.example": (None, None), "": (None, None), None: (None, None),
    }
    from offerloom.functions import text as T

    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: (r["h"], r["p"]) for r in df.select("url", T.url_host("url").alias("h"), T.url_path("url").alias("p")).collect()} == urls


def test_links(spark):
    df = spark.createDataFrame([(1, "u", '<a href="\n/q&amp;r\t"><a href="#top"><a href=" javascript:go()"><a href="/q&amp;r"><A HREF=\'\u00a0s \'>')], "page_id int, url string, html string")
    assert [(r["pos"], r["href"]) for r in PG.links(df).orderBy("pos").collect()] == [(0, "/q&r"), (1, "s")]


ROBOTS = """User-agent:\t*
Disallow:\t/mandje
\u00a0Allow :\t/mandje/hulp\u00a0
Disallow: /*.zip$
Disallow:
Crawl-delay:\t2,5

User-agent: OfferBot
User-agent: Tweede
Disallow: /intern # niet voor bots
"""


def test_robots(spark):
    files = spark.createDataFrame([("h", ROBOTS), ("e", "")], "host string, body string")
    rules = PG.robots_rules(files)
    urls = ["/mandje?a=b", "/mandje/hulp", "/alles.zip", "/alles.zip?z", "/intern", "/"]
    df = spark.createDataFrame([(i, "h", u) for i, u in enumerate(urls)] + [(99, "e", "/mandje")], "url_id int, host string, path string")
    star = {r["path"]: r["allowed"] for r in PG.allowed(df.where("host = 'h'"), rules, "Iemand/3").collect()}
    assert star == {"/mandje?a=b": False, "/mandje/hulp": True, "/alles.zip": False, "/alles.zip?z": True, "/intern": True, "/": True}
    own = {r["path"]: r["allowed"] for r in PG.allowed(df, rules, "OfferBot/2.0").collect()}
    assert own == {"/mandje?a=b": True, "/mandje/hulp": True, "/alles.zip": True, "/alles.zip?z": True, "/intern": False, "/": True, "/mandje": True}
    assert PG.own_rules(rules, "Iemand").select(F.max("delay")).first()[0] == 2.5


def test_robots_against_every_rule(spark):
    """Each URL with each rule of its host, one by one: the longest that matches, allow on ties. A hot host with many rules, repeated and null paths."""
    import random
    import re

    r = random.Random(6)
    part = lambda: "".join(r.choices("ab/.", k=r.randint(0, 4)))
    rules = sorted({("hot" if i % 3 else f"h{i % 4}", r.random() < 0.4, "/" + part() + r.choice(["", "", "*", "$", "*" + part(), "(b"])) for i in range(300)} | {("hot", True, ""), ("hot", False, "/a"), ("hot", True, "/a")})
    body = {}
    for h, allow, path in rules:
        body.setdefault(h, ["User-agent: *"]).append(f"{'Allow' if allow else 'Disallow'}: {path}")
    urls = [(i, r.choice(["hot", "hot", "h1", "h2", "none"]), "/" + part() + part()) for i in range(500)] + [(900, "hot", None), (901, None, "/a"), (902, "hot", "/a"), (903, "hot", "/a")]

    def verdict(host, path):
        best = (-1, True)
        for h, allow, rule in rules:
            if h == host and path is not None:
                pattern = re.escape(rule.removesuffix("$")).replace(r"\*", ".*") + (r"\Z" if rule.endswith("$") else "")
                if re.match(pattern, path):
                    best = max(best, (len(rule.removesuffix("$")), allow))
        return best[1]

    files = spark.createDataFrame([(h, "\n".join(b)) for h, b in body.items()], "host string, body string")
    df = spark.createDataFrame(urls, "url_id int, host string, path string")
    got = {x["url_id"]: x["allowed"] for x in PG.allowed(df, PG.robots_rules(files), "Iemand").collect()}
    assert got == {i: verdict(h, p) for i, h, p in urls} and 50 < sum(not v for v in got.values())


@pytest.mark.parametrize("rules_broadcast", [100_000, 3])
def test_rules_of_a_hot_host(spark, monkeypatch, rules_broadcast):
    """Rules by broadcast, and by shuffle with the hot host's repeated: the longest that fits, as by trying all."""
    import random

    r = random.Random(3)
    monkeypatch.setattr(PG, "RULES_BROADCAST", rules_broadcast)
    monkeypatch.setattr(PG, "HOT_PATHS", 50)
    monkeypatch.setattr(PG, "SALTS", 5)
    word = lambda n: "".join(r.choices("ab/", k=r.randint(0, n)))
    rules = sorted({(h, f"/{word(4)}", r.random() < 0.5) for h in ("big.example", "few.example") for _ in range(15)})
    urls = [(i, r.choice(["big.example"] * 6 + ["few.example", "none.example"]), f"/{word(7)}") for i in range(400)]
    listed = spark.createDataFrame([(h, "*", 1, p, a, None) for h, p, a in rules], "host string, agent string, group_no int, path string, allow boolean, crawl_delay double")
    got = {x["url_id"]: x["allowed"] for x in PG.allowed(spark.createDataFrame(urls, "url_id int, host string, path string"), listed, "bot").collect()}
    want = {i: max(((len(p), a) for g, p, a in rules if g == h and path.startswith(p)), default=(0, True))[1] for i, h, path in urls}
    assert got == want and len({v for v in want.values()}) == 2
