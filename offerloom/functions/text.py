r"""Column functions on text: entities, tags, normalised text, URLs. JVM built-ins only.

White space means Unicode white space, as in web pages: ``WS`` is used where Java's ``\s`` would be ASCII only.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# fixed values: the same characters, for trimming
WHITE = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# fixed values: the named entities that are decoded
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "euro": "€", "eacute": "é", "egrave": "è", "euml": "ë",
    "iuml": "ï", "ouml": "ö", "uuml": "ü", "auml": "ä", "ccedil": "ç", "reg": "®", "trade": "™", "copy": "©", "deg": "°", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, body: str) -> Column:
    """A SQL expression over ``t``, which is the value, computed once. For long rules: one text is parsed, where Column functions would need hundreds of calls to the JVM."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"t -> {body}")), 1)


def sql_let(value: str, name: str, body: str) -> str:
    """The same inside such an expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def trim(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(col(text), F.lit(WHITE))


def decode_entities(text: Column | str) -> Column:
    """Hexadecimal, then decimal, then named entities, each once. Texts without an ampersand are passed through."""
    return bound(col(text), decoded_sql("t"))


@cache
def decoded_sql(t: str) -> str:
    # empty beyond Unicode and for surrogates
    character = "CASE WHEN {n} BETWEEN 1 AND 1114111 AND NOT {n} BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') ELSE '' END"
    of_hex = f"regexp_replace({character.format(n="bigint(conv(x, 16, 10))")}, {quoted(r"([\\$])")}, {quoted(r"\\$1")})"
    hexed = f"aggregate(array_distinct(regexp_extract_all({t}, '&#[xX]([0-9a-fA-F]{{1,6}});', 1)), {t}, (acc, x) -> regexp_replace(acc, concat('&#[xX]', x, ';'), {of_hex}))"
    decimal = f"aggregate(array_distinct(regexp_extract_all(h, {quoted("&#([0-9]{1,9});")}, 1)), h, (acc, x) -> replace(acc, concat('&#', x, ';'), {character.format(n="bigint(x)")}))"
    known = "map(" + ", ".join(quoted(x) for e in ENTITIES.items() for x in e) + ")"
    # the ampersand last, so that nothing is decoded twice
    order = "concat(filter(names, n -> lower(n) <> 'amp'), filter(names, n -> lower(n) = 'amp'))"
    one = f"aggregate({order}, d, (acc, n) -> replace(acc, concat('&', n, ';'), coalesce(try_element_at({known}, lower(n)), concat('&', n, ';'))))"
    named = sql_let("array_distinct(regexp_extract_all(d, '&([a-zA-Z][a-zA-Z0-9]*);', 1))", "names", one)
    numbered = f"CASE WHEN contains({t}, '&#') THEN {sql_let(hexed, "h", decimal)} ELSE {t} END"
    # most ampersands begin no entity
    return f"CASE WHEN contains({t}, '&') AND {t} RLIKE '&[#a-zA-Z][a-zA-Z0-9]*;' THEN {sql_let(numbered, "d", named)} ELSE {t} END"


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return bound(col(text), f"trim(BOTH ' ' FROM {spaced_sql("t")})")


def spaced_sql(t: str) -> str:
    """Of a SQL text: runs of white space become one space. Texts of single blanks and characters that are no white space are passed through."""
    return f"CASE WHEN {t} RLIKE {quoted(r"  |[^ -~\x{A1}-\x{167F}]")} THEN regexp_replace({t}, {quoted(f"{WS}+")}, ' ') ELSE {t} END"


def strip_tags(html: Column | str) -> Column:
    return bound(col(html), stripped_sql("t"))


@cache
def stripped_sql(t: str) -> str:
    no_code = f"regexp_replace({t}, {quoted(r"(?i)<(script|style|noscript)\b[^>]*>[\s\S]*?</\1>")}, ' ')"
    no_tags = sql_let(f"regexp_replace({no_code}, '<[^>]+>', ' ')", "s", decoded_sql("s"))
    return f"trim(BOTH ' ' FROM {sql_let(no_tags, "w", spaced_sql("w"))})"


@cache
def _accent_table() -> tuple[str, str]:
    """All characters that decompose into a lower- or upper-case ASCII letter or digit with marks, and that base."""
    src, dst = [], []
    for n in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(n))
        base = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F).lower()
        if base != chr(n) and len(base) == 1 and base.isascii() and base.isalnum():
            src.append(chr(n))
            dst.append(base)
    return "".join(src), "".join(dst)


def plain(text: Column | str) -> Column:
    """Without accents, lower-case, other than a-z and 0-9 one space: the form in which titles are compared."""
    src, dst = _accent_table()
    marks = "".join(map(chr, range(0x300, 0x370)))
    t = F.lower(F.translate(col(text), src + marks, dst))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def tokens(plain_text: Column | str) -> Column:
    return F.filter(F.array_distinct(F.split(col(plain_text), " ")), lambda w: w != "")


# a host ends at a port or where path, query or fragment begin; a user's name before it isn't part of it
URL_PARTS = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)*(\[[0-9a-fA-F:.]+\]|[^/?#:@]+)(?::\d*)?([^?#]*)"
#: Characters that no host has; underscores and letters beyond ASCII are allowed.
NOT_IN_HOST = r"[\x00-\x20%<>\\^|\x7F]|^[^\[].*[\[\]]"


def url_host(url: Column | str) -> Column:
    """Host in lower case without www.; null for what isn't a URL with a host."""
    host = F.regexp_extract(col(url), URL_PARTS, 1)
    return F.when((host != "") & ~host.rlike(NOT_IN_HOST), F.regexp_replace(F.lower(host), r"^www\.", ""))


def url_path(url: Column | str) -> Column:
    """The path as it is written, blanks percent-encoded; null where there is no host."""
    host, path = F.regexp_extract(col(url), URL_PARTS, 1), F.regexp_extract(col(url), URL_PARTS, 2)
    return F.when((host != "") & ~host.rlike(NOT_IN_HOST), F.when(path.startswith("/"), F.replace(path, F.lit(" "), F.lit("%20"))).when(path == "", "/"))


def without_query(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"[?#][\s\S]*$", "")


def resolve(href: Column | str, base: Column | str) -> Column:
    """Absolute form of an href: absolute, protocol-relative, root-relative, or relative to the base's folder."""
    h, b = col(href), col(base)
    scheme = F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(without_query(b), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(without_query(b), h))
        .otherwise(F.concat(folder, h))
    )


def slug_title(url: Column | str) -> Column:
    """A readable title from the last part of the path that is neither a number nor ``p``."""
    parts = F.filter(F.split(F.regexp_replace(without_query(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/"), lambda p: (p != "") & ~p.rlike(r"^\d+$") & (p != "p"))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.html?$", ""), "[-_]+", " "))


def page_title(html: Column | str) -> Column:
    raw = F.regexp_extract(col(html), r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    return F.when(col(html).rlike(r"(?i)<title[^>]*>[\s\S]*?</title>"), collapse(decode_entities(raw)))


def meta_content(html: Column | str, key: str) -> Column:
    """Content of a meta element by property, name or itemprop, whichever attribute comes first; null if there is none."""
    import re

    k = re.escape(key)
    name, content = rf"(?:property|name|itemprop)\s*=\s*[\"']{k}[\"']", r"content\s*=\s*[\"']([^\"']*)[\"']"
    found = F.regexp_extract_all(col(html), F.lit(rf"(?i)<meta[^>]+{name}[^>]*{content}"), F.lit(1))
    other = F.regexp_extract_all(col(html), F.lit(rf"(?i)<meta[^>]+{content}[^>]*{name}"), F.lit(1))
    return trim(decode_entities(F.coalesce(F.try_element_at(found, F.lit(1)), F.try_element_at(other, F.lit(1)))))
