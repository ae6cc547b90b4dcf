"""Feeds: sniffing, delimited and XML files, white space, normalisation, isolation of broken feeds, matching."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.operators import matching as MA
from offerloom.sources import feeds as FE

def number(spark, body):
    return spark.range(1).select(F.concat(F.lit(body), G.check_digit(F.lit(body)).cast("string"))).first()[0]


def feed_text(good, bad, glue):
    return (
        f"\ufeffid|Title |merk|prijs|valuta|barcode|link|voorraad\n"
        f"k-1|Orlo fluitketel staal maat 3, 2 stuks|Orlo|24,50|EUR|{good}|https://ketel.example/1|ja\n"
        f'k-2|"Orlo fluitketel | klein, ""mini"" maat 3"|Orlo|19,95|eur|{bad}|https://ketel.example/2|op voorraad\n'
        f"k-3|Losse dop||0,99|||https://ketel.example/3|nee\n"
        f"|||||||\n"
        f"k-4|Houtlijm 250 ml|Bindra|7,25||{glue}|https://ketel.example/4|1\n"
    )


def xml_text(good):
    return f"""
  <?xml version="1.0"?><rss><channel><title>Alles</title>
<product><sku>\n x-1\t</sku><title>\u00a0<![CDATA[Orlo fluitketel staal maat 3 &amp; deksel]]>\n</title><g:brand>Orlo</g:brand><g:price>\n24.50 EUR </g:price>
<gtin>{good}</gtin><link> \t\n</link><link>\n https://dop.example/1 \r\n</link><link>https://dop.example/later</link><g:availability>\n in stock\t</g:availability><delivery><price>1</price></delivery></product>
<product><sku>x-2</sku><title>Gar&ccedil;on</title><g:price>5.00</g:price><link>https://dop.example/2</link><g:availability>out of stock</g:availability></product></channel></rss>"""


CATALOG = "product string, name string, brand string, category string, size string, query string, must array<string>, none array<string>, match_pack double, gtins array<string>, strict boolean, position int"


def catalog(spark, glue):
    none = []
    rows = [
        ("kettle", "Orlo fluitketel maat 3", "Orlo", "ketels", "3", "orlo fluitketel staal maat 3", ["orlo", "ketel"], ["mini"], None, none, None, 0),
        ("glue", "Bindra houtlijm", "Bindra", "lijm", None, None, ["lijm"], none, None, [glue], None, 1),
        ("absent", "Zilt", "Zilt", "ketels", "3", None, ["zilt"], none, None, none, None, 2),
    ]
    return spark.createDataFrame(rows, CATALOG)


@pytest.fixture(scope="module")
def numbers(spark):
    good, glue = number(spark, "200000000001"), number(spark, "200000000002")
    return good, good[:-1] + str((int(good[-1]) + 1) % 10), glue


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sniffing():
    assert [FE.sniff_delimiter(h) for h in ("x;y;z", "x\ty", "x,y", "x|y|z", "x", "a,b;c")] == [";", "\t", ",", "|", ",", ","]
    heads = ['\n\n <?xml version="1.1"?>', "<PRODUCTS>", "p;q", "first line\n\n<item nr=1>", " " * 600 + "<rss", "<items>"]
    assert [FE.sniff_format(h) for h in heads] == ["xml", "xml", "csv", "xml", "csv", "csv"]


def test_head_of_a_file(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "_SUCCESS").write_text("")
    (tmp_path / "f" / "a.csv").write_text("")
    (tmp_path / "f" / "b.csv").write_text("\ufeff\none;two\n" + "x" * 5000)
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("zip;ped\n")
    assert FE.head_of(spark, str(tmp_path / "f"), 12) == "\none;two\n" and FE.head_of(spark, str(tmp_path / "f" / "b*")).startswith("\none")
    assert FE.head_of(spark, str(tmp_path / "z.csv.gz")) == "zip;ped\n" and FE.head_of(spark, str(tmp_path / "absent")) == ""


def test_delimited_feed(spark, tmp_path, numbers):
    rows = FE.normalize_rows(FE.read_feed(spark, write(tmp_path / "f.csv", feed_text(*numbers)))).orderBy("sku").collect()
    assert [r["sku"] for r in rows] == ["k-1", "k-2", "k-3", "k-4"]
    a, b, c, d = rows
    assert (a["price"], a["gtin"], a["amount"], a["unit"], a["in_stock"], a["currency"]) == (24.5, "0" + numbers[0], 2.0, "stuk", True, "EUR")
    assert b["title"] == 'Orlo fluitketel | klein, "mini" maat 3' and b["gtin"] is None and b["currency"] == "EUR" and b["in_stock"] is True
    assert c["in_stock"] is False and (d["amount"], d["unit"]) == (250.0, "ml")


def test_line_break_in_quotes(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'nr;what\n1;"top\nbottom"\n2;y\n')
    assert [r["what"] for r in FE.read_delimited(spark, path).collect()] == ["top\nbottom", "y"]


def by_character(text, sep):
    """The rules for records, read character by character: quotes anywhere, as pairs; line ends outside them end a record."""
    records, record, field, quoted = [], [], "", False
    for c in text:
        if c == '"':
            if not quoted and field.endswith("\0"):
                field = field[:-1] + '"'
            elif quoted:
                field += "\0"
            quoted = not quoted
        elif quoted:
            field += c
        elif c in sep + "\n\r":
            record.append(field.replace("\0", ""))
            field = ""
            if c != sep:
                records.append(record)
                record = []
        else:
            field = field.replace("\0", "") + c
    return [r for r in [*records, [*record, field.replace("\0", "")]] if any(r)]


def test_records_over_splits(spark, tmp_path):
    """Files with line breaks, delimiters and pairs of quotes in quotes, cut into splits of a few bytes: the same records as read whole."""
    r = random.Random(11)
    bits = ["a", "bc", ";", "\n", '"q"', '"x\ny"', '"one;two\n\nthree\n"', '"say ""hi""\n"', 'mid"dle\n;"end', "\r\n", '""', " é "]
    (tmp_path / "many").mkdir()
    for n in range(6):
        text = "k;w;z\n" + "".join(r.choices(bits, k=300)) + ("\n" if n % 2 else "")
        (tmp_path / "many" / f"{n}.csv").write_bytes(text.encode())
    want = [(x + ["", "", ""])[:3] for n in range(6) for x in by_character((tmp_path / "many" / f"{n}.csv").read_bytes().decode().replace("\r\n", "\n"), ";")[1:]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = FE.read_delimited(spark, str(tmp_path / "many"), ";")
        assert got.rdd.getNumPartitions() > 30
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_where_few_files_span_splits(spark, tmp_path):
    """Splits as large as all files' bytes allow: files without quotes, one with them and a broken one don't move the others' ends of splits."""
    r = random.Random(4)
    (tmp_path / "few").mkdir()
    want = []
    for n in range(5):
        rows = [(f"{n}-{i}", f'"{"x" * r.randint(1, 30)}\n\n{i}"' if n == 2 else "y" * r.randint(1, 20)) for i in range(400)]
        (tmp_path / "few" / f"{n}.csv").write_text("k;w\n" + "".join(f"{k};{w}\n" for k, w in rows))
        want += [(k, w.strip('"')) for k, w in rows]
    broken = write(tmp_path / "open.csv", "k;w\n" + "z;z\n" * 9000 + '1;"x\n')
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert sorted(map(tuple, FE.read_delimited(spark, str(tmp_path / "few"), ";").collect())) == sorted(want)
        feeds = [{"id": "few", "shop": "x", "path": str(tmp_path / "few"), "keep": ["k", "w"]}, {"id": "open", "shop": "x", "path": broken}]
        rows, problems = FE.read_feeds(spark, feeds, ["x"])
        assert [p["feed"] for p in problems] == ["open"]
        assert sorted(map(tuple, rows.select("k", "w").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_headers_of_all_kinds(spark, tmp_path):
    """Equal names in any case or with blanks: the last counts; a name with a dot or none at all loses nothing else; short and long rows."""
    path = write(tmp_path / "h.csv", '\ufeff id ;price;g.tin;; Price ;"na\nme"\n1;5,00;x;y;6,50;n\n2;1,00\n;;;;;\n3;1;2;3;4;5;6;7\n')
    rows = FE.read_feed(spark, path)
    assert rows.columns == ["id", "price", "g.tin", "na\nme"]
    assert sorted(map(tuple, rows.collect())) == [("1", "6,50", "x", "n"), ("2", "", "", ""), ("3", "4", "2", "5")]
    assert [r["price"] for r in FE.normalize_rows(rows).orderBy("sku").collect()] == [6.5, None, 4.0]
    lone = write(tmp_path / "m.csv", "a;b\r1;x\r\n2;y\r3;z")
    assert sorted(map(tuple, FE.read_feed(spark, lone).collect())) == [("1", "x"), ("2", "y"), ("3", "z")]


def test_broken_feeds_cost_only_themselves(spark, tmp_path, numbers):
    """A cut-off gzip file, an open quote, a file without items and an empty one are problems; all other feeds' rows come."""
    body = feed_text(*numbers).encode()
    many = body + b"".join(b"n-%d|Plank %d||%d,00|||https://plank.example/%d|ja\n" % (i, i * 7919 % 1000, i % 90 + 1, i) for i in range(3000))
    packed = gzip.compress(many)
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "two.csv.gz").write_bytes(gzip.compress(body) + gzip.compress(b"n-1|Plank||2,00|||https://plank.example/1|ja\n"))
    (tmp_path / "whole.csv.gz").write_bytes(packed)
    xml = xml_text(numbers[0])
    (tmp_path / "cut.xml.gz").write_bytes(gzip.compress((xml * 200).encode())[:-900])
    (tmp_path / "whole.xml.gz").write_bytes(gzip.compress(xml.encode()))
    files = {
        "plain": write(tmp_path / "p.csv", feed_text(*numbers)), "cut": tmp_path / "cut.csv.gz", "two": tmp_path / "two.csv.gz", "packed": tmp_path / "whole.csv.gz", "open": write(tmp_path / "o.csv", 'id;name\n1;"x\n2;y\n'),
        "xml": write(tmp_path / "f.xml", xml), "cutxml": tmp_path / "cut.xml.gz", "xmlgz": tmp_path / "whole.xml.gz", "noitem": write(tmp_path / "n.xml", "<?xml version='1.0'?><a><b>1</b></a>"), "empty": write(tmp_path / "e.csv", ""),
    }
    rows, problems = FE.read_feeds(spark, [{"id": k, "shop": "x", "path": str(v), "mapping": {"brand": ["merk", "g:brand"]} if k == "xml" else None} for k, v in files.items()], ["x"])
    assert {p["feed"] for p in problems} == {"cut", "open", "cutxml", "noitem", "empty"}
    assert {r["feed"]: r["n"] for r in rows.groupBy("feed").agg(F.count("*").alias("n")).collect()} == {"plain": 4, "two": 5, "packed": 3004, "xml": 2, "xmlgz": 2}
    assert {r["brand"] for r in rows.where("feed = 'xml'").collect()} == {"Orlo", None}


def test_many_feeds_are_one_scan(spark, tmp_path, numbers):
    """Forty feeds with columns in different orders: the plan doesn't grow with them."""

    def plan(n):
        feeds = []
        for i in range(n):
            order = ["id;name;price;url", "url;price;name;id", "name;url;extra;id;price"][i % 3]
            values = {"id": f"s{i}", "name": "Kom", "price": f"{i},50", "url": "u", "extra": "-"}
            feeds.append({"id": f"f{i}", "shop": "x", "path": write(tmp_path / f"{n}-{i}.csv", order + "\n" + ";".join(values[k] for k in order.split(";")) + "\n")})
        rows, problems = FE.read_feeds(spark, feeds, ["x"])
        assert not problems and {(r["sku"], r["price"]) for r in rows.collect()} == {(f"s{i}", i + 0.5) for i in range(n)}
        return len([x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x or "Join" in x or "Union" in x])

    assert plan(3) == plan(40)


def test_item_tags_of_any_case(spark, tmp_path):
    path = write(tmp_path / "c.xml", "<rss><Product><id>1</id></Product><product><id>2</id></product>\n<PRODUCT a='1'><ID>3</ID></PRODUCT><Product><id>4</id></Product></rss>")
    assert sorted(r["fields"]["id"] for r in FE.read_xml(spark, path).collect()) == ["1", "2", "3", "4"]


def test_xml_feed_with_white_space(spark, tmp_path, numbers):
    path = write(tmp_path / "f.xml", xml_text(numbers[0]))
    rows = FE.normalize_rows(FE.read_feed(spark, path)).orderBy("sku").collect()
    a, b = rows
    assert (a["sku"], a["price"], a["in_stock"], a["gtin"], a["url"], a["title"]) == ("x-1", 24.5, True, "0" + numbers[0], "https://dop.example/1", "Orlo fluitketel staal maat 3 & deksel")
    assert b["title"] == "Garçon" and b["in_stock"] is False and b["gtin"] is None
    one_line = write(tmp_path / "g.xml", xml_text(numbers[0]).replace("\n", " "))
    assert FE.read_feed(spark, one_line).count() == 2


def test_blank_values_are_passed_over(spark):
    rows = spark.createDataFrame([("\t", "\n\u00a0", " \u2003named ", "3")], "name string, title string, product_name string, price string")
    assert FE.normalize_rows(rows).first()["title"] == "named"


def test_mapping_replaces_a_field(spark):
    rows = spark.createDataFrame([("x", "1,50", "2,50")], "name string, price string, special string")
    assert FE.normalize_rows(rows, {"price": ["special"]}).first()["price"] == 2.5


def test_matching(spark, tmp_path, numbers):
    rows = FE.usable(FE.normalize_rows(FE.read_feed(spark, write(tmp_path / "f.csv", feed_text(*numbers))))).withColumn("n", F.monotonically_increasing_id()).withColumn("shop", F.lit("s"))
    best = MA.best_rows(MA.match_rows(rows, catalog(spark, numbers[2])), ["shop", "product"], F.col("n")).collect()
    assert {r["product"]: (r["sku"], r["score"] == 100.0) for r in best} == {"kettle": ("k-1", False), "glue": ("k-4", True)}


def test_a_number_listed_twice_is_the_last_products(spark, numbers):
    c = catalog(spark, numbers[2]).withColumn("gtins", F.array(F.lit(numbers[2])))
    rows = spark.createDataFrame([("0" + numbers[2], "t")], "gtin string, title string")
    assert MA.match_by_gtin(rows, c).first()["product"] == "absent"
    assert MA.match_by_gtin(rows, c.drop("position")).first()["product"] == "kettle"


def test_title_matches_against_brute_force(spark):
    """Words inside words, short and missing words, odd and repeated sizes, brands that are parts of others: each title with each product by the verdict."""
    r = random.Random(3)
    words = ["ketel", "fluit", "tel", "a", "st", "staal", "orlo", "orlo 2", "x9"]
    products = [
        (i, "n", r.choice(["", "Orlo", "Orlo 2", None, "Él"]), r.choice([None, "", "4", "04", "4+", "xl", "0", "3 6"]), None, r.sample(words, r.randint(0, 3)), r.sample(["mini", "tweede"], r.randint(0, 1)), r.choice([None, None, 6.0]), r.choice([[], [], None, ["123"]]))
        for i in range(60)
    ]
    titles = [" ".join(r.choices([*words, "El", "maat 4", "maat04", "size xl", "s4", "t0", "mini", "6 stuks", "maat maat 4", "nr 3 6", "Fluitketel!"], k=r.randint(1, 7))) for _ in range(120)] + [None, "", "?"]
    c = spark.createDataFrame(products, "product long, name string, brand string, size string, query string, must array<string>, none array<string>, match_pack double, gtins array<string>")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "n int, title string")
    rule = {"plain_title": F.col("plain_title"), "must": F.col("must"), "none": F.col("none"), "brand": F.col("rule_brand"), "size": F.col("rule_size"), "pack": F.col("rule_pack")}
    pairs = rows.withColumn("plain_title", MA.plain(F.coalesce("title", F.lit("")))).where("plain_title <> ''").crossJoin(MA.prepared(c))
    want = pairs.where(MA.verdict(F.col("title"), rule) == "ok").select("n", "product", MA.score(MA.tokens("plain_title"), F.col("query_tokens")).alias("score"))
    got = MA.match_by_title(rows, c).select("n", "product", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_best_matches_are_found_once_a_group(spark, numbers):
    """Products with equal rules share their best rows: those of all matches, also where a product is listed twice; rows aren't shuffled for each product."""
    r = random.Random(9)
    kinds = [("Orlo", "4", ["ketel"], [], []), ("Orlo", "4", ["ketel"], ["mini"], []), ("Orlo", None, ["ketel"], [], []), ("", "4", [], [], []), ("Bo", "4", ["lijm"], [], [numbers[2]]), ("Bo", "4", ["lijm"], [], ["no number"])]
    products = [(i, "n", *r.choice(kinds)) for i in range(40)]
    columns = "product long, name string, brand string, size string, must array<string>, none array<string>, gtins array<string>"
    more = {"query": F.lit("orlo ketel"), "match_pack": F.lit(None).cast("double")}
    rows = spark.createDataFrame([(r.choice("ab"), i, r.choice(["0" + numbers[2], None, "0" + numbers[0]]), " ".join(r.choices(["Orlo", "ketel", "maat 4", "mini", "Bo lijm"], k=4)), float(r.randint(1, 3))) for i in range(80)], "shop string, n int, gtin string, title string, price double")
    for twice in ([], [products[0][:2] + kinds[2], products[1][:2] + kinds[4]]):
        c = spark.createDataFrame([*products, *twice], columns).withColumns(more)
        got = MA.best_matches(rows, c, F.col("n"))
        want = MA.best_rows(MA.match_rows(rows, c), ["shop", "product"], F.col("n"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 20
    rules = MA.title_rules(spark.createDataFrame(products, columns).withColumns(more))
    grouped = MA.best_rows(MA.match_groups(rows, rules), ["shop", "group"], F.col("n"))
    assert 0 < grouped.count() < MA.with_products(grouped, rules).count()


def test_many_feeds_and_their_problems(spark, tmp_path, numbers):
    good = write(tmp_path / "f.csv", feed_text(*numbers))
    feeds = [{"id": "a", "shop": "x", "path": good}, {"id": "b", "shop": "nobody", "path": good}, {"id": "c", "shop": "x", "path": str(tmp_path / "absent.csv")}, {"id": "d", "shop": "x", "path": None}]
    rows, problems = FE.read_feeds(spark, feeds, ["x"])
    assert rows.count() == 4 and [p["feed"] for p in problems] == ["b", "c"]


def test_verdicts(spark, numbers):
    c = MA.prepared(catalog(spark, numbers[2])).where("product = 'kettle'")
    titles = ["Orlo fluitketel maat 3", "Orlo ketel maat 8", "Orlo ketel mini maat 3", "ketel size 03 orlo", "Orlo s3 ketel", "", "Zilt ketel maat 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string").withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k")
    df = df.withColumn("plain_title", MA.plain("title"))
    rule = {"plain_title": F.col("plain_title"), "must": F.col("must"), "none": F.col("none"), "brand": F.col("rule_brand"), "size": F.col("rule_size"), "pack": F.col("rule_pack")}
    got = [r[0] for r in df.orderBy("i").select(MA.verdict(F.col("title"), rule)).collect()]
    assert got == ["ok", "size", "has mini", "ok", "ok", "no title", "misses orlo"]
