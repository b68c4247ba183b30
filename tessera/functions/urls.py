"""URLs of tiles: cache keys, hosts, credentials, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(url: Column, volatile: tuple[str, ...] = ("session", "key")) -> Column:
    """The URL without the query parameters that change from session to session; a fragment stays."""
    names = "|".join(volatile)
    out = F.regexp_replace(url, rf"([?&])(?:{names})=[^&#]*", "$1")
    out = F.regexp_replace(out, "&{2,}", "&")
    out = F.regexp_replace(out, r"\?&+", "?")
    return F.regexp_replace(out, r"[?&]+(#|$)", "$1")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def with_key(url: Column, key: str) -> Column:
    """The URL with a key parameter, unless it has one."""
    joint = F.when(url.contains("?"), "&").otherwise("?")
    return F.when(url.rlike(r"[?&]key="), url).otherwise(F.concat(F.regexp_replace(url, "#.*$", ""), joint, F.lit(f"key={key}"), F.regexp_extract(url, "#.*$", 0)))


def content_kind(uri: Column) -> Column:
    return F.when(uri.contains(".glb"), "glb").when(uri.contains(".json"), "json").when(uri.isNotNull(), "other").otherwise("none")


def resolve(base: Column, uri: Column) -> Column:
    """A URI as seen from a base URL: absolute ones as they are, rooted ones on the base's host, others in its folder.

    Dot segments are folded and none leads above the root; the URI's query stays.  Null if the URI is null.
    """
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.substr(base, F.length(origin) + 1), "[?#].*$", ""), "[^/]*$", "")
    tail = F.regexp_extract(uri, "([?#].*)$", 1)
    path = F.regexp_replace(uri, "[?#].*$", "")
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")

    def fold(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), fold)
    last = F.element_at(parts, -1)
    slash = F.when(last.isin("..", "."), "/").otherwise("")
    return F.when(uri.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), uri).otherwise(F.concat(origin, F.array_join(folded, "/"), slash, tail))


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter; null if there is none or it is empty."""
    found = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), rf"[?&]{name}=([^&]*)", 1)
    return F.when(found != "", found)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The URL with a parameter set, in the place of the one it had or at the end; unchanged where the value is null.

    Values are tokens of letters, digits, ``_`` and ``-``; nothing is escaped.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    mark = F.regexp_extract(url, "(#.*)$", 1)
    has = bare.rlike(rf"[?&]{name}=")
    replaced = F.regexp_replace(bare, F.lit(rf"([?&]){name}=[^&]*"), F.concat(F.lit(f"$1{name}="), value))
    joint = F.when(bare.contains("?"), "&").otherwise("?")
    return F.when(value.isNull(), url).otherwise(F.concat(F.when(has, replaced).otherwise(F.concat(bare, joint, F.lit(f"{name}="), value)), mark))
