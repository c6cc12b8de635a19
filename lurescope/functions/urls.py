"""URL and host expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label public suffixes of the indicator extractor.
ROOT_SUFFIXES = (
    "co.uk", "co.jp", "co.kr", "co.in", "co.nz", "co.za", "co.id", "com.au", "com.br", "com.mx", "com.ar", "com.co", "com.tr", "com.sg", "com.my", "com.ph",
    "com.pk", "com.ng", "com.eg", "org.uk", "org.au", "net.au", "gov.uk", "ac.uk", "ne.jp", "or.jp", "go.jp",
)
# Two-label public suffixes of the grouping key; the lists differ.
ETLD_SUFFIXES = (
    "co.uk", "co.jp", "co.kr", "co.nz", "co.za", "co.in", "co.id", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tw", "com.ar", "com.co", "com.tr",
    "com.ua", "com.pk", "com.ng", "org.uk", "org.au", "net.au", "net.br", "ac.uk", "gov.uk", "edu.au", "ne.jp", "or.jp", "ac.jp",
)
# Fixed values of link scoring.
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "is.gd", "v.gd", "ow.ly", "buff.ly", "rb.gy", "short.io", "cutt.ly", "lnk.to", "rebrand.ly", "bl.ink", "clck.ru", "n9.cl", "s.id")
PHISH_WORDS = (
    "login", "signin", "sign-in", "log-in", "verify", "verification", "secure", "security", "account", "update", "confirm", "authenticate", "password",
    "credential", "validate", "suspend", "unlock", "restore", "webmail", "portal", "banking", "wallet",
)
PHISH_HOSTS = ("qr-codes.io", "qr-code-generator.com")
STATIC_ENDS = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".map", ".webp")
SOURCE_SCORES = {"form_action": 0.9, "c2_url": 0.9, "qr_code": 0.85, "redirect": 0.7, "eml_link": 0.6, "eml_attachment": 0.5, "html_link": 0.4}

# Fixed value: a path segment that is a token.
TOKEN_SEGMENT = r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{8,}|(?=[0-9a-f]{4,}$)(?=.*[0-9])(?=.*[a-f]).*|\d+|[a-z0-9_\-]{16,}={0,2})$"


# Client-side redirects.
META_REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"']?\s[^>]*content\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*([^\"'>\s]+)"
LOCATION_SET = r"(?i)(?:window\.)?location(?:\.href)?\s*=\s*[\"']([^\"']+)[\"']"
LOCATION_CALL = r"(?i)(?:window\.)?location\.(?:replace|assign)\s*\(\s*[\"']([^\"']+)[\"']\s*\)"


def host(url: Column) -> Column:
    """Lower-case host without port, null where there is none."""
    return F.lower(F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def _root(labels: Column, suffixes: tuple[str, ...]) -> Column:
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when((n >= 3) & two.isin(*suffixes), three).otherwise(two)


def root_domain(hostname: Column) -> Column:
    """Registrable root of a host."""
    return _root(F.split(F.rtrim(F.lower(hostname), F.lit(".")), r"\."), ROOT_SUFFIXES)


def etld1(url: Column) -> Column:
    """Registrable domain of a URL by the grouping list; null without a host."""
    return _root(F.split(F.rtrim(host(url), F.lit(".")), r"\."), ETLD_SUFFIXES)


def last_two_labels(url: Column) -> Column:
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def path_template(url: Column) -> Column:
    """host/path in lower case without query, tokens as {t}."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    shaped = F.array_join(F.transform(segments, lambda s: F.when(s.rlike(TOKEN_SEGMENT), "{t}").otherwise(F.lower(s))), "/")
    name = F.coalesce(host(url), F.lit(""))
    return F.when(shaped == "", name).otherwise(F.concat(name, F.lit("/"), shaped))


def normalized(url: Column) -> Column:
    """Lower-case scheme and authority, no fragment, no trailing slash, query kept."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.concat(F.lower(head), F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", ""), query)


def link_score(url: Column, source: Column, parent: Column | None = None, strict: bool = True) -> Column:
    """Relevance of a link, 0 to 1. ``strict`` tests shorteners and infrastructure by root domain too."""
    h, p = F.coalesce(host(url), F.lit("")), F.lower(path(url))
    static = F.lit(False)
    for end in STATIC_ENDS:
        static = static | p.endswith(end)
    base = F.lit(0.3)
    for name, score in SOURCE_SCORES.items():
        base = F.when(source == name, score).otherwise(base)
    known = lambda names: h.isin(*names) | (root_domain(h).isin(*names) if strict else F.lit(False))
    words = F.split(F.translate(p, "/-_", "   "), r"\s+")
    keyword = F.arrays_overlap(words, F.array(*(F.lit(w) for w in PHISH_WORDS)))
    score = base + F.when(known(PHISH_HOSTS), 0.3).otherwise(0.0) + F.when(known(SHORTENERS), 0.2).otherwise(0.0) + F.when(keyword, 0.2).otherwise(0.0)
    if parent is not None:
        score = score + F.when((h != "") & (h == parent), 0.15).otherwise(0.0)
    return F.when(static, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))


def resolved(target: Column, base: Column) -> Column:
    """A link's target as seen from a page: absolute, of the same scheme, host or folder, or a query or fragment only."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(whole == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(whole, r"^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(whole, target)).when(target.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), target)).otherwise(F.concat(folder, target))
    )


def client_redirect(body: Column, base: Column, dead_ends: Sequence[str] = ()) -> Column:
    """Where a page sends its visitor by meta refresh or script; null if nowhere.

    Targets on other hosts come before those of the page's own, which are left out
    where their path is one of ``dead_ends``; within a kind the first one wins.
    """
    found = lambda p: F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), lambda x: F.trim(x))
    scripted = F.filter(F.concat(found(LOCATION_SET), found(LOCATION_CALL)), lambda t: ~F.lower(t).contains("location") & ~t.startswith("javascript:") & ~t.startswith("#"))
    targets = F.array_distinct(F.transform(F.concat(found(META_REFRESH), scripted), lambda t: resolved(t, base)))
    own = F.coalesce(host(base), F.lit(""))
    away = F.filter(targets, lambda t: (F.coalesce(host(t), F.lit("")) != "") & (F.coalesce(host(t), F.lit("")) != own))
    here = F.filter(targets, lambda t: ((F.coalesce(host(t), F.lit("")) == "") | (host(t) == own)) & (~F.lower(path(t)).isin(*dead_ends) if dead_ends else F.lit(True)))
    return F.get(F.concat(away, here), F.lit(0))
