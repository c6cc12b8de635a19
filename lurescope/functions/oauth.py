"""OAuth authorize URLs as lures: what the URL itself gives away."""

from __future__ import annotations

import base64
import binascii

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.functions.text import EMAIL
from lurescope.functions.urls import host, path

# Authorize endpoints.
HOSTS = r"^(login(-us)?\.microsoftonline\.(com|us)|login\.live\.com|login\.microsoftonline-p\.com)$"
PATHS = r"^(/[^/]+/oauth2/(v2\.0/)?authorize/?|/oauth20_authorize\.srf/?)$"
FIELDS = ("client_id", "response_type", "response_mode", "redirect_uri", "prompt", "login_hint", "nonce", "state")


def is_authorize_url(url: Column) -> Column:
    return F.coalesce(host(url).rlike(HOSTS) & path(url).rlike(PATHS), F.lit(False))


def decoded_state(raw: str | None) -> str | None:
    """base64 of either alphabet as text, if nine tenths of it can be printed; else null."""
    if not raw or not raw.isascii() or not all(c.isalnum() or c in "+/=_-" for c in raw):
        return None
    try:
        text = base64.b64decode(raw.translate(str.maketrans("-_", "+/")) + "=" * (-len(raw) % 4)).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.9 * len(text) else None


def readable_state(state: Column) -> Column:
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(decoded_state, na_action=None)

    return decode(state)


def parameter(url: Column, name: str) -> Column:
    """A query parameter's first value, decoded; null if it is absent or empty."""
    raw = F.regexp_extract(F.try_parse_url(url, F.lit("QUERY")), rf"(?:^|&){name}=([^&]*)", 1)
    return F.nullif(F.try_url_decode(raw), F.lit(""))


def oauth_parts(url: Column) -> Column:
    """Struct of the parts of an authorize URL, null for other URLs; absent parts are null."""
    tenant = F.nullif(F.regexp_extract(path(url), r"^/([^/]+)/oauth2/(?:v2\.0/)?authorize/?$", 1), F.lit(""))
    scope = parameter(url, "scope")
    state = readable_state(parameter(url, "state"))
    victim = F.coalesce(F.nullif(F.regexp_extract(state, EMAIL, 0), F.lit("")), F.nullif(F.regexp_extract(parameter(url, "login_hint"), EMAIL, 0), F.lit("")))
    got = F.struct(
        F.lit("microsoft").alias("provider"), host(url).alias("host"), path(url).alias("path"), tenant.alias("tenant"), *(parameter(url, f).alias(f) for f in FIELDS),
        F.filter(F.split(scope, r"[\s+]+"), lambda s: s != "").alias("scopes"), state.alias("state_text"), F.lower(victim).alias("victim_email"),
        F.coalesce(F.lower(parameter(url, "prompt")) == "none", F.lit(False)).alias("silent_auth"),
    )
    return F.when(is_authorize_url(url), got)
