"""Domains and web addresses of a line of text, without what only looks like them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.functions import lookups as lk
from lurescope.functions.urls import root_domain

_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
#: Names of two to 126 labels: longer ones are no host names, and an unbounded loop exhausts the stack of the regex engine.
DOMAIN = rf"(?<![a-zA-Z0-9/\-_%.:])({_LABEL}(?:\.{_LABEL}){{0,124}}\.[a-zA-Z]{{2,6}})(?![/\p{{L}}\p{{N}}_.])"
# Syntax that a broad URL pattern takes along, and where a literal of a script ends.
TRAILING = r"['\";,)\]}>\\]+$"
LITERAL_END = r"['\"]\s*\+|['\"]\s*,\s*['\"]"
STYLE_PARTS = r"[*{}<>]|::?(?:before|after|hover|focus|active|visited|placeholder|root)"
ENTITY = r"&[a-zA-Z]+;?|&#[0-9]+;?|&#x[0-9a-fA-F]+;?"


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of([text.contains(w) for w in words])


def among(value: Column, names: Sequence[str]) -> Column:
    """Whether a value is one of the names, which have no spaces; a folded constant, as lists of hundreds are slow to build name by name."""
    return F.array_contains(F.split(F.lit(" ".join(names)), " "), value)


def authority_host(url: Column) -> Column:
    """Lower-case host of a URL whose other parts may break the rules; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@\[\]]*)", 1))


def trimmed(url: Column) -> Column:
    """A URL without trailing syntax, cut where the literal that it stands in ends."""
    return F.regexp_replace(F.regexp_replace(url, TRAILING, ""), rf"(?s)(?:{LITERAL_END}).*$", "")


def in_service(url: Column, services: Sequence[str]) -> Column:
    """Whether a URL, without character references, is at a known service."""
    return among(root_domain(authority_host(F.regexp_replace(url, ENTITY, ""))), services)


def own(host: Column, own_root: Column | None) -> Column:
    """Whether a host has the root of the file's source; false without a source."""
    return F.lit(False) if own_root is None else F.coalesce(root_domain(host) == own_root, F.lit(False))


def socket_urls(found: Column, services: Sequence[str] = lk.SERVICES, own_root: Column | None = None) -> Column:
    """Of socket URLs as matched, those at hosts that are neither local, services nor the source's own."""
    def keep(u: Column) -> Column:
        h = authority_host(u)
        return h.contains(".") & (h != "127.0.0.1") & ~in_service(u, services) & ~own(h, own_root)

    return F.filter(F.transform(found, trimmed), keep)


def web_iocs(found: Column, line: Column, services: Sequence[str] = lk.SERVICES, own_root: Column | None = None) -> Column:
    """Indicators of http(s) URLs as matched in a line: structs of type, value and confidence.

    A URL of a page's file, or without a word of sending loot in it or its line, gives
    its host as domain (50), others themselves as c2_url (85). Local hosts, services,
    the source's own root, the Telegram API (scanned apart) and pieces of styles give none.
    """
    def parts(raw: Column) -> Column:
        u = trimmed(raw)
        return F.struct(u.alias("url"), authority_host(u).alias("host"), (u != F.regexp_replace(raw, TRAILING, "")).alias("cut"))

    def keep(p: Column) -> Column:
        u, h = p["url"], p["host"]
        inner = h.isin("localhost", "127.0.0.1") | ~h.contains(".") | any_of([h.endswith(e) for e in lk.INNER_ENDS])
        bad = (p["cut"] & (~h.contains(".") | (F.length(u) < 12))) | F.lower(u).contains("api.telegram.org") | u.rlike(STYLE_PARTS) | ((h != "") & inner) | u.contains("==")
        return ~bad & ~in_service(u, services) & ~own(h, own_root)

    def indicator(p: Column) -> Column:
        u, h = p["url"], p["host"]
        where = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:]*://[^/?#]*([^?#]*)", 1)), r";[^/]*$", "")
        file = any_of([where.endswith(e) for e in lk.PAGE_FILES])
        loot = (contains_any(F.lower(u), lk.LOOT_WORDS) | contains_any(F.lower(line), lk.LOOT_WORDS)) & ~file
        return F.struct(
            F.when(loot, "c2_url").otherwise("domain").alias("type"), F.when(loot, u).otherwise(h).alias("value"), F.when(loot, 85).otherwise(50).alias("confidence")
        )

    return F.filter(F.transform(F.filter(F.transform(found, parts), keep), indicator), lambda x: x["value"] != "")


def domains(text: Column, services: Sequence[str] = lk.SERVICES) -> Column:
    """Domains of a line, lower-cased, each once, without names of scripts, styles, files and services, and without their broken ends."""
    roots = tuple(dict.fromkeys((*services, *lk.EMAIL_EXCLUSIONS)))
    ends = tuple(dict.fromkeys(r[i:] for r in roots for i in range(1, len(r) - 4) if "." in r[i:]))

    def keep(d: Column) -> Column:
        labels = F.split(d, r"\.")
        n, tld, first = F.size(labels), F.element_at(labels, -1), labels[0]
        encoded = F.substring(d, 1, 2).isin("2f", "3a", "3d", "26", "3f") | contains_any(d, ("3a2f", "2f2f"))
        key = (n >= 4) & F.arrays_overlap(labels, F.array(*map(F.lit, lk.MESSAGE_LABELS)))
        state = (n >= 3) & F.arrays_overlap(labels, F.array(*map(F.lit, lk.STATE_LABELS)))
        shape = (F.length(d) < 5) | F.exists(labels, lambda x: F.length(x) < 2) | d.contains("--") | ((tld == "is") & first.contains("-") & (n == 2))
        plain = ~first.contains("-")
        scripted = among(tld, lk.SCRIPT_TLDS) & (n == 2) & plain & ((F.length(first) <= 3) | (F.length(first) > 12) | (tld == "id"))
        named = among(d, lk.SCRIPT_NAMES) | among(first, lk.SCRIPT_OBJECTS)
        return among(tld, lk.TLDS) & ~(encoded | key | state | shape | scripted | named) & ~among(root_domain(d), roots) & ~among(d, ends)

    found = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOMAIN), F.lit(1)), F.lower)), keep)
    return F.when(text.rlike(r"\.[a-zA-Z]{2}"), found).otherwise(F.array().cast("array<string>"))


def domain_confidence(line: Column) -> Column:
    return F.when(contains_any(F.lower(line), lk.HOST_WORDS), 80).otherwise(60)


def shown_sign_ins(line: Column, own_root: Column | None) -> Column:
    """URLs of sign-in hosts that a line of another source names; none without a source."""
    if own_root is None:
        return F.array().cast("array<string>")
    at_home = own_root.isin(*_sign_in_roots())
    named = F.filter(F.array(*map(F.lit, lk.SIGN_IN_HOSTS)), lambda h: F.contains(F.lower(line), h))
    urls = F.transform(named, lambda h: F.concat(F.lit("https://"), h))
    return F.when(own_root.isNotNull() & ~at_home, urls).otherwise(F.array().cast("array<string>"))


def _sign_in_roots() -> tuple[str, ...]:
    """Registrable roots of the sign-in hosts, which all have one-label suffixes."""
    return tuple(dict.fromkeys(".".join(h.split(".")[-2:]) for h in lk.SIGN_IN_HOSTS))
