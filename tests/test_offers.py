"""Verification, history, ranking, comparison, cache and publishing on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.operators import compare as C
from offerloom.operators import history as H
from offerloom.operators import offers as O
from offerloom.operators import publish as P
from offerloom.operators import verify as V

P1, A1 = "2000000000039", "2000000000015"


def offers(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], "product string, shop string, gtin_text string, amount double")


def catalog(spark, gtins=(), strict=None):
    return spark.createDataFrame([("p", list(gtins), strict)], "product string, gtins array<string>, strict boolean")


@pytest.mark.parametrize(
    ("rows", "gtins", "strict", "want", "source"),
    [
        ([("a", P1), ("b", P1), ("c", A1), ("d", None)], [], None, {"a": "exact", "b": "exact", "c": "variant", "d": "onbekend"}, "consensus"),
        ([("a", P1), ("b", None)], [], None, {"a": "onbekend", "b": "onbekend"}, "geen"),
        ([("a", P1), ("b", A1)], [], None, {"a": "variant", "b": "variant"}, "geen"),
        ([("a", P1), ("b", A1)], [P1], None, {"a": "exact"}, "catalogus"),
        ([("a", P1), ("b", A1)], [P1], False, {"a": "exact", "b": "afwijkend"}, "catalogus"),
    ],
)
def test_verification(spark, rows, gtins, strict, want, source):
    v = V.without_mismatches(V.verified(offers(spark, *[(*r, 1.0) for r in rows]), catalog(spark, gtins, strict))).collect()
    assert {r["shop"]: r["verification"] for r in v} == want and {r["reference_source"] for r in v} == {source}


def test_issues(spark):
    v = V.verified(offers(spark, ("a", A1, 160.0), ("b", A1, 82.0), ("c", P1, 1.0)), catalog(spark, [P1]))
    before = spark.createDataFrame([("p", "c", A1)], "product string, shop string, gtin string")
    got = {(r["shop"], r["type"]) for r in V.issues(V.with_changes(v, before)).collect()}
    assert got == {("a", "gtin-niet-in-catalogus"), ("b", "gtin-niet-in-catalogus"), ("c", "gtin-gewijzigd"), ("b", "verpakking-wijkt-af")}


def test_identity_over_two_days(spark):
    seen = spark.createDataFrame([("p", "k", "P", "A1", 1.0, 1), ("p", "k", None, None, None, 2), ("p", "k", "A", "A2", None, 3)], "product string, shop string, gtin string, sku string, amount double, at int")
    s = V.snapshot(seen, F.col("at")).first()
    assert (s["first_seen"], s["last_seen"], s["gtin"], s["sku"], s["amount"]) == (1, 3, "A", "A2", 1.0)
    log = V.change_log(seen, [F.col("at")]).collect()
    assert [(r["from_gtin"], r["to_gtin"], r["at"]) for r in log] == [("P", "A", 3)]


def test_history(spark):
    d = lambda day: dt.date(2026, 8, day)
    h = spark.createDataFrame([("p", "s", d(24), 11.0, 0.22), ("p", "s", d(25), 8.5, 0.17)], "product string, shop string, d date, p double, u double")
    again = spark.createDataFrame([("p", "s", d(24), 10.0, 0.2)], h.schema)
    got = H.upsert(H.upsert(h, again), again).orderBy("d").collect()
    assert [(r["d"], r["p"], r["u"]) for r in got] == [(d(24), 10.0, 0.2), (d(25), 8.5, 0.17)]
    ten = spark.createDataFrame([("p", "s", d(k), float(k), None) for k in range(1, 11)], h.schema)
    kept = H.retain(ten, keep=5).orderBy("d").collect()
    assert len(kept) == 5 and kept[0]["d"] == d(6)
    old = spark.createDataFrame([("p", "s", dt.date(2026, 6, 1), 4.0, None), ("p", "t", dt.date(2026, 7, 26), 9.5, None), ("p", "s", d(1), 12.0, None)], h.schema)
    assert [r["lowest"] for r in H.lowest_in_period(old, F.lit("2026-08-25").cast("date")).collect()] == [9.5]


def test_rank_and_summary(spark):
    rows = [("p", "a", 9.0, 0.3, None), ("p", "b", 8.0, 0.2, False), ("p", "c", 10.0, 0.25, True), ("p", "d", 7.0, None, True), ("p", "e", 10.0, 0.25, None)]
    o = spark.createDataFrame(rows, "product string, shop string, price double, unit_price double, in_stock boolean")
    assert [r["shop"] for r in P.rank_offers(o).orderBy("rank").collect()] == ["c", "e", "a", "d", "b"]
    o = o.withColumns({"verification": F.lit("exact"), "reference": F.lit("0" + P1), "reference_source": F.lit("consensus"), "unit_label": F.lit("per stuk")})
    s = P.product_summary(o).first()
    assert (s["best_shop"], s["best_price"], s["offers"], s["gtin"]) == ("c", 10.0, 5, P1)


def test_result_does_not_depend_on_partitions(spark):
    rows = [("p", f"s{i % 7}", float(i % 5), float(i % 3), None, "feed" if i % 2 else "page", i) for i in range(60)]
    o = spark.createDataFrame(rows, "product string, shop string, price double, unit_price double, in_stock boolean, source string, ord int")
    one, many = (sorted(map(str, O.one_per_shop(x, [F.col("ord")]).collect())) for x in (o.coalesce(1), o.orderBy(F.rand(3)).repartition(7)))
    assert one == many and len(one) == 7


def test_comparison(spark):
    products = spark.createDataFrame([("a", "A", "Larix", "thee", "4"), ("b", "B", "Den", "thee", "4"), ("c", "C", "Iep", "thee", "10")], "product string, name string, brand string, category string, size string")
    rows = [("a", "k", 60.0, 0.3, True, "exact"), ("a", "zuid", 48.0, 0.24, False, "variant"), ("b", "k", 11.0, 0.22, None, "exact"), ("c", "k", 5.0, None, True, "exact")]
    o = spark.createDataFrame(rows, "product string, shop string, price double, unit_price double, in_stock boolean, verification string")
    r = C.comparison_rows(products, o)
    assert [(x["brand"], x["shop"], x["rank"]) for x in C.comparison_rank(r).orderBy("rank").collect()] == [("Den", "k", 1), ("Larix", "zuid", 2), ("Larix", "k", 3)]
    assert {x["brand"]: x["unit_price"] for x in C.cheapest_per_brand(r).collect()} == {"Den": 0.22, "Larix": 0.24}
    s = C.comparison_summary(r).first()
    assert (s["monthly_difference"], s["brands"], s["shops"]) == (12.0, 2, 2)
    assert C.default_size(products, o).first()["size"] == "4"
    assert [x["value"] for x in C.facets(products, o).where("kind = 'size'").orderBy("position").collect()] == ["4", "10"]
    assert C.visible(o).count() == 3 and C.savings(C.visible(o)).where("saving > 0").count() == 0


def test_cache_forgets(spark):
    old = spark.createDataFrame([("p", k, "u", "t", 1, "zoek", n) for k, n in (("a", 0), ("b", 2), ("c", 0), ("d", 1))], "product string, shop string, url string, title string, resolved_at int, source string, failures int")
    out = [("p", "a", None, None, 2, "zoek", "HTTP 500"), ("p", "b", None, None, 2, "zoek", "HTTP 500"), ("p", "c", None, None, 2, "zoek", "pagina past niet meer"), ("p", "e", "n", "new", 2, "feed", None)]
    out = spark.createDataFrame(out, "product string, shop string, url string, title string, at int, source string, error string")
    got = {r["shop"]: tuple(r)[2:] for r in O.merge_resolved(old, out).collect()}
    assert got == {"a": ("u", "t", 1, "zoek", 1), "d": ("u", "t", 1, "zoek", 1), "e": ("n", "new", 2, "feed", 0)}


def test_sizes_of_all_kinds(spark):
    products = spark.createDataFrame([("a", "A", "X", "k", "newborn"), ("b", "B", "Y", "k", "4+"), ("c", "C", "Z", "k", "10"), ("d", "D", "Z", "k", None)], "product string, name string, brand string, category string, size string")
    some = spark.createDataFrame([(p,) for p in "abcd"], "product string")
    assert C.default_size(products, some).first()["size"] == "4+"
    assert [x["value"] for x in C.facets(products, some).where("kind = 'size'").orderBy("position").collect()] == ["4+", "10", "newborn"]


def test_an_empty_payload_leaves_the_last_one(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "product long, name string")
    path = f"file://{tmp_path}/out"
    assert P.publish(df, path)
    assert not P.publish(df.where("false"), path) and not P.publish(df, path, dry_run=True)
    assert P.read_published(spark, path, df.schema).collect() == df.collect()


def test_gtin_gate(spark):
    rows = [(None, [P1], A1, False), (None, [P1], P1, True), (False, [P1], A1, True), (None, [], A1, True), (None, [P1], None, True), (None, ["12"], A1, True)]
    df = spark.createDataFrame(rows, "strict boolean, gtins array<string>, gtin string, want boolean")
    assert all(r[0] == r[1] for r in df.select(O.gtin_allowed(F.col("strict"), F.col("gtins"), F.col("gtin")), "want").collect())


def test_rank_of_a_hot_group(spark):
    """A group with most of the rows is ranked in many ranges: the ranks of a window, with nulls as keys, and ranges of like size."""
    r = random.Random(9)
    rows = [("hot" if i % 10 else r.choice(["a", "b", None]), r.choice(["1", None]) if i % 10 == 0 else "4", float(r.choice([1, 1, 1, r.randint(2, 400)])), float(r.randint(1, 5)), i // 7, i % 7) for i in range(6000)]
    df = spark.createDataFrame(rows, "category string, size string, unit_price double, price double, product int, shop int").repartition(6)
    got = C.comparison_rank(df, range_rows=100)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("category", "size").orderBy("unit_price", "price", "product", "shop")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, C.comparison_rank(df).collect())) == sorted(map(str, want.collect()))
    assert C.comparison_rank(df.where("false"), range_rows=100).count() == 0
    dealt, _ = C.deal_ranges(df, ["category", "size"], ["unit_price", "price", "product", "shop"], 100)
    sizes = [x["count"] for x in dealt.where("category = 'hot'").groupBy("_range").count().collect()]
    assert len(sizes) == 54 and max(sizes) < 3 * 100 and dealt.where("category <> 'hot' AND size IS NOT NULL").select("_range").distinct().count() <= 3


def test_ids_present_in_a_period_against_brute_force(spark):
    r = random.Random(6)
    first = dt.date(2024, 2, 20)
    rows = [(r.choice([0, 5, 40_000, 70_001, 9_000_000_000, None]), r.choice([1, 2, -3]), first + dt.timedelta(r.choice([0, 1, 2, 9, 40, 41, 75])), 1.0, None) for _ in range(40)]
    h = spark.createDataFrame(rows, "product long, shop long, d date, p double, u double")
    seen = H.presence(h)
    for days in (0, 1, 6, 30):
        got = {x["d"]: (x["products"], x["shops"]) for x in H.present_in_period(seen, days).collect()}
        want = {}
        for d in {x[2] for x in rows}:
            near = [x for x in rows if d - dt.timedelta(days) <= x[2] <= d]
            want[d] = (len({x[0] for x in near} - {None}), len({x[1] for x in near}))
        assert got == want
    assert H.present_in_period(H.presence(h.where("false"))).count() == 0


def test_distinct_ids_of_a_period_against_brute_force(spark):
    """Repeated rows, days of a null id only, periods that touch and overlap; one sort by id, and then a row a day."""
    r = random.Random(8)
    first = dt.date(2024, 2, 20)
    rows = [(r.choice([0, 5, 40_000, 9_000_000_000, None]), r.choice([1, 2, -3, None]), first + dt.timedelta(r.choice([0, 1, 2, 9, 31, 40, 41, 75]))) for _ in range(60)]
    rows += [(None, None, first + dt.timedelta(5)), (None, 1, first + dt.timedelta(60)), (1, 1, None), *rows[:9]]
    h = spark.createDataFrame(rows, "product long, shop long, d date")
    for days in (0, 1, 6, 30):
        got = {x["d"]: (x["products"], x["shops"]) for x in H.distinct_in_period(h, days).collect()}
        want = {}
        for d in {x[2] for x in rows if x[2] and x[:2] != (None, None)}:
            near = [x for x in rows if x[2] and d - dt.timedelta(days) <= x[2] <= d]
            want[d] = tuple(len({x[i] for x in near} - {None}) for i in (0, 1))
        assert got == want
    assert H.distinct_in_period(h.where("false")).count() == 0
    plan = H.distinct_in_period(h)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "bitmap" not in plan
