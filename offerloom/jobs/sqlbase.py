"""SQL for DuckDB of the derived tables, as common table expressions that the queries' oracles start with."""

from __future__ import annotations


def check_digit(body: str) -> str:
    """Of a body of twelve digits."""
    total = " + ".join(f"CAST(substr({body}, {j}, 1) AS INTEGER) * {3 if j % 2 == 0 else 1}" for j in range(1, 13))
    return f"CAST((10 - ({total}) % 10) % 10 AS VARCHAR)"


def ean13(prefix: str, number: str) -> str:
    body = f"('{prefix}' || lpad(CAST({number} AS VARCHAR), 9, '0'))"
    return f"({body} || {check_digit(body)})"


def half_up(x: str, digits: int, epsilon: bool = True) -> str:
    x = f"({x} + 2.220446049250313e-16::DOUBLE)" if epsilon else f"({x})"
    return f"(floor({x} * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE)"


CATALOG = f"""
catalog AS (SELECT p_partkey AS product, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS VARCHAR) AS size, {ean13("200", "p_partkey")} AS own,
  p_partkey % 5 = 0 AS listed FROM part)"""
BASE = half_up("price / amount", 4)
OFFERS = f"""
raw_offers AS (SELECT l_partkey AS product, l_suppkey AS shop, l_extendedprice AS price, l_quantity AS amount,
  CASE l_partkey % 3 WHEN 0 THEN 'stuk' WHEN 1 THEN 'ml' ELSE 'g' END AS unit,
  CASE WHEN l_linenumber % 5 <> 0 THEN l_linestatus = 'O' END AS in_stock, CASE WHEN l_returnflag = 'A' THEN 'feed' ELSE 'page' END AS source,
  CASE l_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN {ean13("201", "l_partkey")} ELSE {ean13("200", "l_partkey")} END AS gtin_text,
  'S' || l_partkey AS sku, CAST(l_shipdate AS DATE) AS day, l_orderkey * 8 + l_linenumber AS ord FROM lineitem),
offers AS (SELECT *, CASE WHEN unit = 'stuk' THEN {half_up(BASE, 4)} ELSE {half_up(BASE + " * 100", 4)} END AS unit_price,
  CASE unit WHEN 'stuk' THEN 'per stuk' WHEN 'ml' THEN 'per 100 ml' ELSE 'per 100 g' END AS unit_label FROM raw_offers)"""
ONE = """
one AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY source <> 'feed', ord, price, amount) = 1)"""
VERIFIED = """
votes AS (SELECT product, gtin_text AS g, count(*) AS n FROM one WHERE gtin_text IS NOT NULL GROUP BY ALL),
con AS (SELECT product, count(*) AS distinct_gtins, (SELECT arg_min(v.g, struct_pack(a := -v.n, b := v.g)) FROM votes v WHERE v.product = votes.product AND v.n >= 2) AS voted FROM votes GROUP BY product),
ver AS (SELECT one.*, lpad(gtin_text, 14, '0') AS gtin, lpad(CASE WHEN listed THEN own ELSE voted END, 14, '0') AS reference,
  CASE WHEN listed THEN 'catalogus' WHEN voted IS NOT NULL THEN 'consensus' ELSE 'geen' END AS reference_source,
  CASE WHEN gtin_text IS NULL THEN 'onbekend' WHEN listed THEN CASE WHEN gtin_text = own THEN 'exact' ELSE 'afwijkend' END
       WHEN voted IS NOT NULL THEN CASE WHEN gtin_text = voted THEN 'exact' ELSE 'variant' END WHEN distinct_gtins > 1 THEN 'variant' ELSE 'onbekend' END AS verification,
  listed AS strict FROM one LEFT JOIN con USING (product) JOIN catalog USING (product)),
kept AS (SELECT * FROM ver WHERE NOT (strict AND verification = 'afwijkend'))"""
HISTORY = """
hist AS (SELECT product, shop, day AS d, price AS p, unit_price AS u FROM offers QUALIFY row_number() OVER (PARTITION BY product, shop, day ORDER BY ord DESC, price DESC, amount DESC) = 1)"""
ROWS = f"""
cmp AS (SELECT kept.*, name, brand, category, size, {half_up("unit_price * 150", 2, epsilon=False)} AS monthly FROM kept JOIN catalog USING (product) WHERE unit_price IS NOT NULL)"""
FEED = f"""
feed AS (SELECT l_suppkey AS shop, l_orderkey * 8 + l_linenumber AS row_no, l_partkey AS product, p_brand AS brand, p_name, p_size, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE AS price,
  CASE WHEN l_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 = 1 THEN '01234567890128' ELSE '0' || {ean13("200", "l_partkey")} END AS gtin,
  CASE WHEN l_orderkey % 11 <> 0 THEN 'https://shop' || l_suppkey || '.example/p/' || l_partkey END AS url,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linestatus = 'O' END AS in_stock,
  p_brand || ' ' || p_name || ' maat ' || p_size || ' - ' || CAST(l_quantity AS INTEGER) || ' stuks & meer' AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'),
usable AS (SELECT * FROM feed WHERE url IS NOT NULL)"""
MATCHED = """
pl AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS plain FROM usable),
by_gtin AS (SELECT pl.*, c.product AS matched, 100.0::DOUBLE AS score FROM pl JOIN catalog c ON c.listed AND pl.gtin = '0' || c.own),
cat2 AS (SELECT product AS m, name, trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) AS pb, size, string_split(lower(name), ' ') AS words, product % 7 = 0 AS refurb FROM catalog WHERE NOT listed),
by_title AS (SELECT pl.*, m AS matched, len(list_intersect(words, list_distinct(string_split(plain, ' ')))) AS hit, len(list_distinct(words)) AS nq, len(list_distinct(string_split(plain, ' '))) AS nt
  FROM (SELECT pl.* FROM pl LEFT JOIN by_gtin b ON b.row_no = pl.row_no AND b.shop = pl.shop AND b.price = pl.price AND b.gtin = pl.gtin WHERE b.row_no IS NULL) pl
  JOIN cat2 ON contains(plain, pb) AND contains(plain, ' maat ' || size || ' ') AND len(list_filter(words, lambda w: NOT contains(plain, w))) = 0 AND NOT (refurb AND contains(plain, 'refurbished'))),
matched AS (SELECT shop, row_no, title, price, matched AS product, score FROM by_gtin
  UNION ALL SELECT shop, row_no, title, price, matched, round(hit * 10.0::DOUBLE / nq + 1 / (1 + greatest(nt - nq, 0) / 10.0::DOUBLE), 4) FROM by_title)"""


def sql(*parts: str, then: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + then
