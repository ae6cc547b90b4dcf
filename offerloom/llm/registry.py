"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, clusters, codes, decontamination, jaccard, media, mixing, packing, substrings, tokencount, toxicity, urls, warc

MODULES = [mixing, chat, urls, warc, packing, media, toxicity, decontamination, substrings, jaccard, codes, tokencount, clusters]


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out |= getattr(m, "ORACLES", {})
    return out
