"""Where tiles come from: providers, endpoints, credentials and what is missing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host

# Providers by name, the host of session-bound tiles, and the kind of endpoint that is delegated.
GOOGLE, ION, URL = "google", "cesium-ion", "url"
SESSION_HOST, SESSION_PATH, DELEGATED = "tile.googleapis.com", "/3dtiles/", "3DTILES"
ENDPOINT = "url STRING, accessToken STRING, externalType STRING, options STRUCT<url: STRING>"


def needs_session(url: Column) -> Column:
    """Whether a URL is of the provider whose tiles are bound to a session; a null URL isn't."""
    path = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", 1)
    return F.coalesce((host(url) == SESSION_HOST) & path.contains(SESSION_PATH), F.lit(False))


def endpoint(body: Column) -> tuple[Column, Column, Column]:
    """(kind, url, authorization header) of an endpoint document.

    A url is read directly, with its token if it has one; a delegated url through a session where its provider needs one,
    else directly.  All else, text that isn't JSON included, is ``unsupported`` and has neither url nor header.
    """
    e = F.from_json(body, ENDPOINT)
    own, token, inner = (F.when(c != "", c) for c in (e["url"], e["accessToken"], e["options"]["url"]))
    delegated = (e["externalType"] == DELEGATED) & inner.isNotNull()
    kind = F.when(own.isNotNull(), "direct").when(delegated, F.when(needs_session(inner), "session").otherwise("direct")).otherwise("unsupported")
    return kind, F.coalesce(own, F.when(delegated, inner)), F.when(own.isNotNull() & token.isNotNull(), F.concat(F.lit("Bearer "), token))


def missing(provider: Column, credential: Column, asset_id: Column, url: Column) -> Column:
    """What a configuration lacks, in words; null if nothing.  Empty text is as good as null."""
    no_key, no_asset, no_url = (F.coalesce(c, F.lit("")) == "" for c in (credential, asset_id, url))
    return F.when((provider == GOOGLE) & no_key, "key required").when((provider == ION) & (no_key | no_asset), "token and asset required").when((provider == URL) & no_url, "url required")


def preferred(*choices: tuple[Column, Column, Column, Column]) -> Column:
    """The first configuration (provider, credential, asset, url) that names a provider and lacks nothing, as a struct; null if none."""
    def whole(c: tuple[Column, Column, Column, Column]) -> Column:
        return F.when(c[0].isNotNull() & missing(*c).isNull(), F.struct(*[x.alias(n) for x, n in zip(c, ("provider", "credential", "asset_id", "url"))]))

    return F.coalesce(*map(whole, choices))
