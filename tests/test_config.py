"""Configuration documents and missing files."""

import json

from offerloom.operators import quality as Q
from offerloom.sources import config as CF


def test_documents(spark, tmp_path):
    catalog = {
        "categories": [{"id": "thee", "label": "Thee"}],
        "products": [
            {"id": "t7", "name": "Larix muntthee maat 7", "brand": "Larix", "category": "thee", "size": "7", "match": {"must": ["munt"]}, "links": {"noord": "u", "far": "v"}, "gtins": []},
            {"id": "t7", "name": "Kaneel", "category": "hout", "gtins": ["200000000003" + "0"], "strictGtin": True, "shops": ["noord", "oost"]},
        ],
    }
    shops = {
        "noord": {"name": "Noord", "site": "https://noord.example", "searchUrl": "https://noord.example?q={q}", "productPathPattern": "^/(t"}, "dicht": {"name": "", "site": "s", "enabled": False},
        "named": {"name": "N", "site": "s", "searchUrl": "{q}", "productPathPattern": r"^/(?<slug>[a-z-]+)/\\d++"}, "python": {"name": "P", "site": "s", "searchUrl": "{q}", "productPathPattern": "^/(?P<slug>x)"},
    }
    feeds = {"feeds": [{"id": "f", "shop": "noord", "urlEnv": "https://raw"}, {"id": "f", "shop": "west", "urlEnv": "A", "format": "yaml"}]}
    for name, doc in (("catalog", catalog), ("shops", shops), ("feeds", feeds)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    c, s, f = CF.read_catalog(spark, f"{tmp_path}/catalog.json"), CF.read_shops(spark, f"{tmp_path}/shops.json"), CF.read_feed_config(spark, f"{tmp_path}/feeds.json")
    assert c.count() == 2 and {r["shop"]: r["enabled"] for r in s.where("shop IN ('noord', 'dicht')").collect()} == {"noord": True, "dicht": False}
    found = {(r["subject"], r["rule"]) for r in Q.catalog_violations(c, CF.read_categories(spark, f"{tmp_path}/catalog.json"), s).where("level = 'error'").collect()}
    assert found == {("t7", r) for r in ("duplicate id", "unknown category", "unknown shop", "link to an unknown shop", "invalid article number")}
    assert {(r["subject"], r["rule"]) for r in Q.feed_violations(f, s).collect()} == {("f", "duplicate id"), ("f", "unknown shop"), ("f", "location is a raw url"), ("f", "unknown format")}
    assert {(r["subject"], r["rule"]) for r in Q.shop_violations(s).collect()} == {("dicht", "no name"), ("noord", "invalid path pattern"), ("python", "invalid path pattern")}
    assert Q.catalog_violations(c, CF.read_categories(spark, f"{tmp_path}/absent.json"), s).where("rule = 'unknown category'").isEmpty()
    assert [r["subject"] for r in Q.catalog_violations(c, CF.read_categories(spark, f"{tmp_path}/catalog.json"), s).where("rule = 'empty list of article numbers'").collect()] == ["t7"]
    assert CF.scope(c, s, only_products=["t7"], first=1)[0].count() == 1


def test_missing_files_are_empty(spark, tmp_path):
    for read in (CF.read_catalog, CF.read_categories, CF.read_shops, CF.read_feed_config):
        assert read(spark, f"{tmp_path}/absent.json").count() == 0
