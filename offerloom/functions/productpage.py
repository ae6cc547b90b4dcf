"""What a product page's JSON-LD says about its product, by VARIANT.

JSON-LD has no fixed schema: types, offers, images and numbers may be single values, lists or lists of lists. Each block is parsed once to a VARIANT
in the JVM and read by paths, so numbers stay numbers, and a block that isn't JSON (or too deep or too large to be parsed) is null
and costs nothing but itself. The rules are SQL texts over lambda variables; each function here gives the text for a value's text.
"""

from __future__ import annotations

from functools import cache
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gtin import normalized_sql
from .money import half_up_sql, price_sql
from .text import WHITE, WS, quoted, sql_let, stripped_sql

# fixed values: keys that hold an article number, and those below which it may be
NUMBER_KEYS = ("gtin14", "gtin13", "gtin12", "gtin8", "gtin", "ean", "europeanArticleNumber")
BELOW = ("offers", "hasVariant", "isVariantOf", "additionalProperty")
BELOW_DEPTH = 3
#: Lists and graphs inside each other that are opened to find a page's nodes.
GRAPH_DEPTH = 8
NUMERIC = "^(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
_NUMBERS = count()


def let(value: str, body) -> str:
    """body(name) with the value computed once under a name of its own."""
    name = f"v{next(_NUMBERS)}"
    return sql_let(value, name, body(name))


def get(v: str, path: str, kind: str = "variant") -> str:
    """What stands at a path; null where nothing does and where it can't be of that kind."""
    return f"try_variant_get({v}, {quoted(path)}, '{kind}')"


def first_at(v: str, *paths: str) -> str:
    """The first of several paths at which something other than a JSON null stands."""
    return "coalesce(" + ", ".join(let(get(v, p), lambda x: f"CASE WHEN NOT is_variant_null({x}) THEN {x} END") for p in paths) + ")"


def as_list(v: str) -> str:
    """A list as it is, another value as a list of one; empty for null."""
    return let(v, lambda x: f"coalesce({get(x, '$', 'array<variant>')}, filter(array({x}), y -> y IS NOT NULL))")


def text_of(v: str) -> str:
    """A value as text, a list's parts with commas between them; null for an object."""
    return let(v, lambda x: f"coalesce(array_join({get(x, '$', 'array<string>')}, ','), CASE WHEN {get(x, '$', 'map<string,variant>')} IS NULL THEN {get(x, '$', 'string')} END)")


def filled(text: str) -> str:
    return f"nullif(trim(BOTH {quoted(WHITE)} FROM {text}), '')"


def first_of(values: str) -> str:
    """The first that isn't null."""
    return f"try_element_at(filter({values}, y -> y IS NOT NULL), 1)"


def price_of(v: str) -> str:
    """A JSON number as it is, anything else by the rules for prices in texts; in cents."""
    number = lambda x: let(get(x, "$", "double"), lambda n: f"CASE WHEN abs({n}) < 1e300D THEN {half_up_sql(n)} END")
    return let(v, lambda x: f"CASE WHEN schema_of_variant({x}) RLIKE '{NUMERIC}' THEN {number(x)} ELSE {sql_let(text_of(x), 't', price_sql())} END")


def nodes_of(blocks: str) -> str:
    """All values of JSON-LD blocks in their order, lists and @graph opened: array<struct<v, done>>."""
    clean = f"regexp_replace(regexp_replace(b, {quoted(rf"^{WS}*<!\[CDATA\[")}, ''), {quoted(rf"\]\]>{WS}*\z")}, '')"
    found = f"transform({blocks}, b -> named_struct('v', try_parse_json(trim(BOTH {quoted(WHITE)} FROM {clean})), 'done', false))"
    parts = f"transform({get('x.v', '$', 'array<variant>')}, e -> named_struct('v', e, 'done', false))"
    itself = f"filter(array(named_struct('v', x.v, 'done', true), named_struct('v', {get('x.v', "$['@graph']")}, 'done', false)), y -> y.v IS NOT NULL)"
    for _ in range(GRAPH_DEPTH):
        found = f"flatten(transform({found}, x -> CASE WHEN x.done THEN array(x) ELSE coalesce({parts}, {itself}) END))"
    return f"filter({found}, x -> x.done)"


def is_product(node: str) -> str:
    types = as_list(get(node, "$['@type']"))
    return f"exists({types}, t -> lower({get('t', '$', 'string')}) IN ('product', 'productgroup'))"


def lowest_offer(node: str) -> str:
    """The offer with the lowest price, of those that name one, offers inside offers too; the first of equal ones."""
    offers = f"flatten(transform({as_list(get(node, '$.offers'))}, o -> concat(array(o), {as_list(get('o', '$.offers'))})))"
    named = f"transform({offers}, o -> named_struct('offer', o, 'price', {first_at('o', '$.price', '$.lowPrice', '$.priceSpecification.price')}))"
    order = lambda p: f"transform({p}, (x, i) -> named_struct('p', coalesce({price_of('x.price')}, double('Infinity')), 'i', i))"
    return let(f"filter({named}, x -> x.price IS NOT NULL)", lambda p: f"try_element_at({p}, array_min({order(p)}).i + 1).offer")


def identifiers(node: str) -> str:
    """struct<gtin, sku, mpn>: the first of each in a node and what lies below it, a node before its offers and variants."""
    item = lambda v, d, done: f"named_struct('v', {v}, 'd', {d}, 'done', {done})"
    parts = f"transform({get('x.v', '$', 'array<variant>')}, e -> {item('e', 'x.d + 1', 'false')})"
    own = ", ".join([item("x.v", "x.d", "true"), *[item(get("x.v", f"$.{k}"), "x.d + 1", "false") for k in BELOW]])
    found = f"array({item(node, '0', 'false')})"
    for _ in range(BELOW_DEPTH + 1):
        found = f"flatten(transform({found}, x -> CASE WHEN x.done THEN array(x) ELSE filter(coalesce({parts}, array({own})), y -> y.v IS NOT NULL AND y.d <= {BELOW_DEPTH}) END))"

    def named(items: str) -> str:
        prefixed = f"regexp_replace({text_of(get('x.v', '$.productID'))}, '^(?i:ean|gtin|upc)[:_-]?', '')"
        texts = f"flatten(transform({items}, x -> array({', '.join(text_of(get('x.v', f'$.{k}')) for k in NUMBER_KEYS)}, {prefixed})))"
        numbers = f"transform(filter({texts}, g -> g IS NOT NULL), g -> {normalized_sql('g')})"
        texts_at = lambda k: f"transform({items}, x -> {filled(text_of(get('x.v', f'$.{k}')))})"
        return f"named_struct('gtin', {first_of(numbers)}, 'sku', {first_of(texts_at('sku'))}, 'mpn', {first_of(texts_at('mpn'))})"

    return let(f"filter({found}, x -> x.done)", named)


def image_of(v: str) -> str:
    """The address of the first image: a text, or an object's, however the lists around it are nested (three deep)."""
    inner = lambda x: f"coalesce({get(x, '$[0]')}, {x})"
    for step in (inner, inner, inner, lambda x: f"coalesce({first_at(x, '$.url', '$.contentUrl')}, {x})", inner, inner, inner):
        v = let(v, step)
    return let(v, lambda x: f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN {get(x, '$', 'string')} END")


@cache
def products_sql(blocks: str) -> str:
    products = f"filter({nodes_of(blocks)}, x -> {is_product('x.v')})"
    return f"transform({products}, n -> named_struct('node', n.v, 'offer', {lowest_offer('n.v')}, 'ids', {identifiers('n.v')}))"


def product_nodes(blocks: str) -> Column:
    """array<struct<node, offer, ids>> of a page's products, for a column of JSON-LD blocks."""
    return F.expr(products_sql(blocks))


def chosen(products: str) -> Column:
    """The first product with a priced offer, or else the first."""
    return F.expr(f"coalesce(try_element_at(filter({products}, p -> p.offer IS NOT NULL), 1), try_element_at({products}, 1))")


def other_ids(products: str) -> Column:
    """struct<gtin, sku, mpn> over all products in order; mpn only up to the product by which both others are found."""
    where = lambda k: f"array_position(transform({products}, p -> p.ids.{k} IS NOT NULL), true)"
    last = f"CASE WHEN {where('gtin')} > 0 AND {where('sku')} > 0 THEN greatest({where('gtin')}, {where('sku')}) ELSE size({products}) END"
    mpns = let(last, lambda n: first_of(f"transform({products}, (p, i) -> CASE WHEN i < {n} THEN p.ids.mpn END)"))
    of = lambda k: first_of(f"transform({products}, p -> p.ids.{k})")
    return F.expr(f"named_struct('gtin', {of('gtin')}, 'sku', {of('sku')}, 'mpn', {mpns})")


@cache
def facts_sql(product: str) -> str:
    node, offer = f"{product}.node", f"{product}.offer"
    name = sql_let(text_of(get(node, "$.name")), "t", stripped_sql("t"))
    size = let(first_at(node, "$.size", "$.weight.value"), lambda x: f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN {get(x, '$', 'string')} END")
    return f"""named_struct('found', {node} IS NOT NULL, 'title', nullif({name}, ''),
      'price', {price_of(first_at(offer, "$.price", "$.lowPrice", "$.highPrice", "$.priceSpecification.price"))},
      'currency', upper(nullif({text_of(first_at(offer, "$.priceCurrency", "$.priceSpecification.priceCurrency"))}, '')),
      'stock_text', {text_of(first_at(offer, "$.availability", "$.itemCondition"))}, 'size_text', {size}, 'image', {image_of(get(node, "$.image"))})"""


def facts(product: str) -> Column:
    """struct of a chosen product's title, price, currency, stock and size texts, image, and whether there is one."""
    return F.expr(facts_sql(product))
