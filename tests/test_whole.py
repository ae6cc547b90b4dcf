"""Whole jobs: queries that take every row, and operators against brute force on fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from offerloom.jobs import queries as J
from offerloom.operators import matching as MA
from offerloom.operators import offers as O
from offerloom.operators import publish as P
from offerloom.sources import config as CF
from offerloom.sources import domain as D
from offerloom.sources import feeds as FE

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

CATALOG = "product long, name string, brand string, size string, query string, must array<string>, none array<string>, match_pack double, gtins array<string>"
PRODUCTS = [
    (1, "Dry", "Larix", "4", None, ["dry"], ["pants"], None, []),
    (2, "Dry", "Larix", "5", None, ["dry"], ["pants"], None, []),
    (3, "Dry", "Larix", None, None, ["dry"], ["pants"], 44.0, []),
    (4, "Dry", "Larix", "4", None, ["dry"], ["pants"], 20.0, []),
    (5, "Pants", "Larix", "4", None, ["pants", "night"], [], None, []),
    (6, "Zalf", "Spar", None, None, ["zalf"], [], None, []),
    (7, "Listed", "Larix", "4", None, ["dry"], [], None, ["2000000000015"]),
    (4, "Night", "Larix", "4", None, ["night"], [], None, []),
]
TITLES = ["Larix Dry maat 4 - 44 stuks"] * 3 + ["larix dry MAAT 4, 20 stuks", "Larix dry pants maat 5", "Larix Spar zalf", "Huggies dry maat 4", "Larix night pants s4", "", None]


def test_diagnosis_against_brute_force(spark):
    catalog, rows = spark.createDataFrame(PRODUCTS, CATALOG), spark.createDataFrame([(t,) for t in TITLES], "title string")
    pairs = rows.withColumn("plain_title", MA.plain(F.coalesce("title", F.lit("")))).crossJoin(MA.prepared(catalog)).where(F.contains("plain_title", F.col("rule_brand")))
    rule = {"plain_title": F.col("plain_title"), "must": F.col("must"), "none": F.col("none"), "brand": F.col("rule_brand"), "size": F.col("rule_size"), "pack": F.col("rule_pack")}
    want = pairs.select("product", MA.verdict(F.col("title"), rule).alias("reason")).groupBy("product", "reason").count()
    got = MA.diagnose(rows, catalog)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ("size" in {r["reason"] for r in got.collect()}) and got.where("product = 1 AND reason = 'ok'").first()["n"] == 4


@with_data
def test_diagnosis_takes_every_shop(spark):
    got = J.QUERIES["d6_match_diagnosis_all"](spark, SF).agg(F.sum("n")).first()[0]
    brands = D.catalog(spark, SF).where("size(gtins) = 0").select(MA.plain("brand").alias("b"))
    titles = J.usable_feed(spark, SF).select(MA.plain("title").alias("t"))
    assert got == titles.crossJoin(brands).where(F.contains("t", F.col("b"))).count()
    assert titles.count() > J.usable_feed(spark, SF).where("shop < 5").count()


def test_coverage_counts_the_pairs_of_the_work_list(spark, monkeypatch):
    products = spark.createDataFrame([(1, None, None), (2, None, {"9": "l", "1": "m"}), (3, [1, 9, 77], None), (4, [9], {"9": "l"}), (5, [], None)], "product long, shops array<long>, links map<string,string>")
    shops = spark.createDataFrame([(1, True), (2, None), (9, False), (8, False)], "shop long, enabled boolean")
    offers = spark.createDataFrame([(p, s, "g" if p % 2 else None) for p in range(1, 7) for s in (1, 9, 8)], "product long, shop long, gtin string")
    want = sorted(map(tuple, P.coverage(O.work_list(products, shops), offers).collect()))
    assert sorted(map(tuple, P.catalog_coverage(products, shops, offers).collect())) == want and len(want) == 3
    pairs = sorted(map(str, O.work_list(products, shops).collect()))
    monkeypatch.setattr(O, "SHOPS_BROADCAST", 2)
    assert sorted(map(str, O.work_list(products, shops).collect())) == pairs


@with_data
def test_catalog_violations_of_large_ids(spark, tmp_path):
    """Ids of seven digits and one more may make a valid number of eight: a wrong number has to be wrong for every id."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    got = J.QUERIES["d4_catalog_violations"](spark, str(tmp_path)).where("rule = 'invalid article number'")
    assert sorted(int(r["subject"]) for r in got.collect()) == sorted(r[0] + 1_000_000 for r in part.where("p_partkey % 50 = 7").select("p_partkey").collect())


def test_work_that_no_feed_covers(spark, monkeypatch):
    """The pairs of the anti join, without a shuffle of pairs: lists, links, disabled shops, null keys, shops too many to be broadcast."""
    products = spark.createDataFrame([(1, None, None), (2, None, {"9": "l", "1": "m"}), (3, [1, 9, 77], None), (4, [9, 9], {"9": "l"}), (5, [], None), (None, None, None), (6, None, {})], "product long, shops array<long>, links map<string,string>")
    shops = spark.createDataFrame([(1, True), (2, None), (9, False), (8, False)], "shop long, enabled boolean")
    offers = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (4, 9), (6, 1), (None, 1), (3, None)], "product long, shop long")
    want = sorted(map(str, O.not_covered(O.work_list(products, shops), offers).collect()))
    got = O.work_not_covered(products, shops, offers)
    assert sorted(map(str, got.collect())) == want and len(want) == 7
    assert "hashpartitioning(product" in got._jdf.queryExecution().executedPlan().toString() and "shop#" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(product" in x)
    monkeypatch.setattr(O, "SHOPS_BROADCAST", 2)
    assert sorted(map(str, O.work_not_covered(products, shops, offers).collect())) == want


@with_data
def test_work_list_takes_every_product(spark):
    work = J.QUERIES["j3_work_list_all"](spark, SF)
    assert work.where("product % 3 > 0").select("product").distinct().count() == D.catalog(spark, SF).where("product % 3 > 0").count()
    assert J.QUERIES["a12_coverage_all"](spark, SF).agg(F.sum("wanted")).first()[0] == work.count()


@with_data
def test_many_feeds_read_back_every_row(spark):
    got = J.QUERIES["s5_many_feeds_all"](spark, SF).where("shop >= 0")
    want = D.feed_text(spark, SF).select("shop", F.col("row_no").cast("string"))
    assert sorted(map(tuple, got.select("shop", "row_no").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("price IS NULL").isEmpty()


@with_data
def test_scope_takes_every_product_and_enabled_shop(spark):
    got = {(r["kind"], r["id"]) for r in J.QUERIES["p1_scope_all"](spark, SF).collect()}
    want = {("product", r[0]) for r in D.catalog(spark, SF).select("product").collect()} | {("shop", r[0]) for r in D.shops(spark, SF).where("enabled").select("shop").collect()}
    assert got == want and any(i % 2 == 0 for k, i in got if k == "product")


def test_scope_of_the_first_products(spark):
    products = spark.createDataFrame([(i,) for i in (8, 2, 5, 4, 1)], "product long")
    shops = spark.createDataFrame([(1, True), (2, False), (3, None)], "shop long, enabled boolean")
    p, s = CF.scope(products, shops, first=3)
    assert sorted(r[0] for r in p.collect()) == [1, 2, 4] and sorted(r[0] for r in s.collect()) == [1, 3]


def test_xml_feed_with_a_long_head(spark, tmp_path):
    head = "".join(f"<category>{i}</category>\n" for i in range(5000))
    late, none = tmp_path / "late.xml", tmp_path / "none.xml"
    late.write_text(f"<?xml version='1.0'?><rss>\n{head}<Item><id>1</id></Item>\n<Item><id>2</id></Item>\n</rss>")
    none.write_text(f"<?xml version='1.0'?><rss>\n{head}</rss>")
    assert sorted(r["fields"]["id"] for r in FE.read_xml(spark, str(late)).collect()) == ["1", "2"]
    feeds = [{"id": "a", "shop": "x", "path": str(late)}, {"id": "b", "shop": "x", "path": str(none)}]
    rows, problems = FE.read_feeds(spark, feeds, ["x"])
    assert rows.count() == 2 and [p["feed"] for p in problems] == ["b"] and "no item tag" in problems[0]["error"]


@with_data
def test_the_whole_history_is_written(spark, monkeypatch):
    first = []
    write = J.H.write_days
    monkeypatch.setattr(J.H, "write_days", lambda h, path: (first.append(h.agg(F.min("d")).first()[0]), write(h, path)))
    assert J.QUERIES["s8_history_by_day"](spark, SF).agg(F.min("d").cast("string")).first()[0] >= "2001-06-01"
    assert first[0] == J.history(spark, SF).agg(F.min("d")).first()[0]


@with_data
def test_payload_is_packed_and_offers_travel_slim(spark, tmp_path):
    """What follows from an offer's own columns isn't shuffled with it, and the published JSON is packed."""
    exchanges = [x for x in J.one_offers(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert exchanges and not any("unit_label" in x or "gtin_text" in x for x in exchanges)
    P.publish(spark.range(3), f"file://{tmp_path}/p")
    assert list(tmp_path.glob("p/v=*/*.json.gz")) and not list(tmp_path.glob("p/v=*/*.json"))


@with_data
def test_candidates_have_titles(spark):
    assert J.QUERIES["u4_candidates"](spark, SF).where("title IS NULL").isEmpty()


def test_a_round_and_the_next(spark, tmp_path):
    """Feed rows to payload and state twice: packs of the catalog, changed numbers, offers without a URL, a dry run, and an empty round."""
    from offerloom.operators import round as R

    valid = [r[0] for r in spark.range(2).select(D.ean13("200", F.col("id") + 1)).collect()]
    catalog = spark.createDataFrame([("p", "Kan", "Bo", "k", "", None, ["kan"], [], None, [], None, 5.0, "stuk")], "product string, name string, brand string, category string, size string, query string, must array<string>, none array<string>, match_pack double, gtins array<string>, strict boolean, pack_amount double, pack_unit string")
    shops = spark.createDataFrame([("a", "Aa"), ("b", "Bee"), ("c", "Cee")], "shop string, shop_name string")
    schema = "shop string, n int, gtin string, sku string, title string, price double, currency string, url string, in_stock boolean, amount double, unit string"
    path = f"file://{tmp_path}/round"

    def play(rows, day, **options):
        offers = R.feed_offers(spark.createDataFrame(rows, schema), catalog, shops, "n")
        payload, report, done = R.run_round(offers, catalog, path, F.lit(day).cast("timestamp"), order=[F.col("n")], **options)
        return payload, sorted((r["shop"], r["type"]) for r in report.collect()), done

    first = [("a", 1, "0" + valid[0], "s1", "Bo kan", 10.0, "EUR", "ua", True, None, None), ("b", 2, "0" + valid[0], None, "Bo kan 2 stuks", 8.0, "EUR", "ub", None, 2.0, "stuk"), ("c", 3, None, None, "Bo kan", 1.0, "EUR", None, True, None, None)]
    payload, issues, done = play(first, "2001-03-01 10:00:00", dry_run=True)
    assert not done and not (tmp_path / "round").exists() and payload.count() == 1
    payload, issues, done = play(first, "2001-03-01 10:00:00")
    row = P.read_published(spark, path, payload.schema).first()
    assert done and [(o["shop"], o["shop_name"], o["url"], o["unit_price"], o["amount"], o["gtin"]) for o in row["offer_list"]] == [("a", "Aa", "ua", 2.0, 5.0, valid[0]), ("b", "Bee", "ub", 4.0, 2.0, valid[0])]
    assert row["lowest30"] == 8.0 and issues == [("b", "verpakking-wijkt-af")]
    second = [("a", 1, "0" + valid[1], "s1", "Bo kan", 12.0, "EUR", "ua", True, None, None)]
    payload, issues, done = play(second, "2001-03-05 10:00:00")
    row = P.read_published(spark, path, payload.schema).first()
    assert done and ("a", "gtin-gewijzigd") in issues and row["offer_list"][0]["gtin_changed"] and row["lowest30"] == 8.0
    identity = {r["shop"]: r for r in R.read_state(spark, path, "identity", "string").collect()}
    assert (identity["a"]["gtin"], str(identity["a"]["first_seen"])[:10], str(identity["a"]["last_seen"])[:10]) == ("0" + valid[1], "2001-03-01", "2001-03-05") and "b" in identity
    assert R.read_state(spark, path, "history", "string").count() == 3
    _, _, done = play([], "2001-03-06 10:00:00")
    assert not done and P.read_published(spark, path, payload.schema).first()["best_price"] == 12.0


def test_what_a_round_leaves(spark, tmp_path):
    """Prices of deviating offers in the history, feed and page outcomes in the resolved pages, changes of numbers, heads, days and deltas instead of snapshots."""
    from offerloom.operators import round as R

    own, other = [r[0] for r in spark.range(2).select(D.ean13("200", F.col("id") + 1)).collect()]
    columns = "product string, name string, brand string, category string, size string, query string, must array<string>, none array<string>, match_pack double, gtins array<string>, strict boolean, pack_amount double, pack_unit string, weight string"
    catalog = spark.createDataFrame([("p", "Kan", "Bo", "k", "", None, ["kan"], [], None, [own], True, None, None, "2 kg"), ("q", "Vaas", "Bo", "k", "", None, ["vaas"], [], None, [], None, None, None, None)], columns)
    shops = spark.createDataFrame([("a", "Aa", "https://a.example"), ("b", "Bee", "https://b.example"), ("z", "Zet", "https://z.example")], "shop string, shop_name string, site string")
    path, order = f"file://{tmp_path}/round", [F.col("n")]
    offer = "product string, shop string, n int, gtin_text string, sku string, title string, price double, url string, in_stock boolean, amount double, unit string, unit_price double, unit_label string, source string, shop_name string"

    def play(rows, day, outcomes=None, **options):
        offers = spark.createDataFrame([(p, s, i, g, k, "t", price, f"{s}/{p}", True, None, None, None, None, source, None) for i, (p, s, g, k, price, source) in enumerate(rows)], offer)
        tried = None if outcomes is None else spark.createDataFrame(outcomes, "product string, shop string, url string, title string, at timestamp, source string, error string")
        return R.run_round(offers, catalog, path, F.lit(day).cast("timestamp"), order=order, shops=shops, outcomes=tried, **options)

    feed, page = "feed", "page"
    payload, report, done = play([("p", "a", own, "s", 10.0, feed), ("p", "b", other, None, 5.0, feed), ("q", "a", None, None, 4.0, page), ("q", "a", None, None, 3.0, feed)], "2001-03-01 10:00:00", [("q", "a", "a/q", "t", None, "zoek", None)])
    assert done and [r["type"] for r in report.collect()] == ["gtin-niet-in-catalogus"]
    assert sorted(map(tuple, R.read_state(spark, path, "history", "string").select("product", "shop", "p").collect())) == [("p", "a", 10.0), ("p", "b", 5.0), ("q", "a", 4.0)]
    rows = {r["product"]: r for r in P.read_published(spark, path, payload.schema).collect()}
    assert rows["p"]["lowest30"] == 5.0 and len(rows["p"]["offer_list"]) == 1 and rows["p"]["weight"] == "2 kg" and rows["q"]["best_price"] == 3.0
    head = P.read_head(spark, path).first()
    assert head["stats"].asDict() == {"products": 2, "products_with_offers": 2, "offers": 2, "shops": 1, "verified_offers": 1} and [(s["shop"], s["site"]) for s in head["shops"]] == [("a", "https://a.example")]
    assert {(r["product"], r["shop"]): r["source"] for r in R.read_state(spark, path, "resolved", "string").collect()} == {("p", "a"): "feed", ("p", "b"): "feed", ("q", "a"): "zoek"}

    # the same day again, with another number and no problems: one point a day, and a report with its head
    _, report, done = play([("q", "a", own, None, 6.0, feed)], "2001-03-01 18:00:00")
    assert done and report.isEmpty() and R.read_report(spark, path)[0].first().asDict() | {"ran_at": None} == {"ran_at": None, "published": True, "shops": ["a", "b", "z"], "product_count": 2, "offer_count": 1}
    assert {r["p"] for r in R.read_state(spark, path, "history", "string").where("product = 'q'").collect()} == {6.0}
    for day, number in ((2, other), (3, own), (4, None)):
        play([("q", "a", number, "k", 6.0, feed)], f"2001-03-0{day} 10:00:00", [("p", "a", None, None, None, None, "pagina past niet meer"), ("p", "b", None, None, None, None, "HTTP 500")])
    state = lambda name: sorted(map(str, R.read_state(spark, path, name, "string").collect()))
    (q,) = R.read_state(spark, path, "identity", "string").where("product = 'q'").collect()
    assert (q["gtin"], q["sku"], str(q["first_seen"])[:10], str(q["last_seen"])[:10]) == ("0" + own, "k", "2001-03-01", "2001-03-04")
    assert [(c["from_gtin"], c["to_gtin"], str(c["at"])[8:10]) for c in q["changes"]] == [("0" + other, "0" + own, "03"), ("0" + own, "0" + other, "02")]
    # a page that is wrong goes at once, one that fails goes at the third time
    assert {(r["product"], r["shop"]) for r in R.read_state(spark, path, "resolved", "string").collect()} == {("q", "a")}
    deltas = [spark.read.parquet(f"{R.state_path(path, 'identity')}/{f}").count() for f in R.folders(spark, R.state_path(path, "identity"))]
    assert deltas == [1] * 5 and len(R.folders(spark, R.state_path(path, "history"))) == 4
    for name in ("identity", "resolved"):
        was = state(name)
        R.compact(spark, path, name, "string")
        assert state(name) == was and any(f.startswith("base=") for f in R.folders(spark, R.state_path(path, name)))
    many = spark.createDataFrame([(own, [(str(i), "x", None) for i in range(5)])], "gtin string, changes array<struct<from_gtin:string,to_gtin:string,at:timestamp>>")
    old = F.struct("gtin", "changes", *[F.lit(None).cast("string").alias(c) for c in ("sku", "amount", "unit", "first_seen")])
    seen = many.select(F.lit("p").alias("product"), F.lit("a").alias("shop"), F.lit(other).alias("gtin"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("amount"), F.lit(None).cast("string").alias("unit"), old.alias("old"))
    (delta,) = R.identity_delta(seen, F.lit("2001-03-05")).collect()
    assert [c["from_gtin"] for c in delta["changes"]] == [own, "0", "1", "2", "3"]
    _, _, done = play([], "2001-03-09 10:00:00")
    assert not done and R.read_report(spark, path)[0].first()["published"] is False and P.read_published(spark, path, payload.schema).count() == 1


def test_page_results_become_offers(spark):
    from offerloom.operators import round as R

    work = spark.createDataFrame([("p", "a", "u1"), ("p", "b", None), ("q", "a", "gone")], "product string, shop string, link string")
    resolved = spark.createDataFrame([("p", "b", "u2")], "product string, shop string, url string")
    pages = spark.createDataFrame([("u1", True, True, 4.0, "One", "s", True, None, None), ("u2", True, False, 5.0, "Two", None, None, 2.0, "stuk")], "url string, fits boolean, allowed boolean, price double, title string, sku string, in_stock boolean, amount double, unit string")
    again = spark.createDataFrame([("p", "b", "u3", 6.0, "Three")], "product string, shop string, url string, price double, title string")
    found = O.known_page_offers(work, resolved, pages, again)
    assert {(r["product"], r["shop"]): (r["url"], r["title"], r["error"], r["from_known"]) for r in found.collect()} == {
        ("p", "a"): ("u1", "One", None, True), ("p", "b"): ("u3", "Three", None, False), ("q", "a"): (None, None, "pagina niet gevonden; geen passend resultaat", False),
    }
    catalog = spark.createDataFrame([("p", 8.0, "stuk")], "product string, pack_amount double, pack_unit string")
    offers = {r["shop"]: r for r in R.page_offers(found, catalog, spark.createDataFrame([("a", "Aa")], "shop string, shop_name string")).collect()}
    assert (offers["a"]["unit_price"], offers["a"]["shop_name"], offers["a"]["source"], offers["b"]["shop_name"]) == (0.5, "Aa", "page", None) and len(offers) == 2
