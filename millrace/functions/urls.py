"""URL functions: absolute forms, parts, and the effective base of a page."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*:")
# Ports that a scheme implies.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def absolute(base: str | None, url: str | None) -> str | None:
    """``url`` resolved on ``base``; None for no text, a relative one without a base, or text that can't be read."""
    if url is None or not url.strip():
        return None
    url = url.strip()
    try:
        urlsplit(url)
        if _SCHEME.match(url):
            return url
        return urljoin(base, url) if base and urlsplit(base).scheme else None
    except ValueError:
        return None


def parts(url: str | None) -> dict[str, str] | None:
    """The eleven parts of an absolute URL; None for anything else."""
    if not url:
        return None
    try:
        x = urlsplit(url.strip())
        port = x.port
    except ValueError:
        return None
    if not x.scheme or not x.netloc and not x.path:
        return None
    host = x.netloc.rpartition("@")[2]
    return {
        "href": url.strip(), "protocol": f"{x.scheme}:", "username": x.username or "", "password": x.password or "", "host": host, "hostname": x.hostname or "", "port": str(port) if port is not None else "",
        "pathname": x.path, "search": f"?{x.query}" if x.query else "", "hash": f"#{x.fragment}" if x.fragment else "", "origin": f"{x.scheme}://{host}" if host else "null",
    }


PARTS_SCHEMA = ", ".join(f"{k} string" for k in ("href", "protocol", "username", "password", "host", "hostname", "port", "pathname", "search", "hash", "origin"))


def parse_url(url: Column) -> Column:
    """The eleven parts in the JVM, as a struct; null where the text is no absolute URL."""
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))
    scheme, user = part("PROTOCOL"), part("USERINFO")
    host = F.regexp_replace(part("AUTHORITY"), "^.*@", "")
    port = F.regexp_extract(host, r":(\d+)$", 1)
    query, fragment = part("QUERY"), part("REF")
    struct = F.struct(
        F.trim(url).alias("href"), F.concat(scheme, F.lit(":")).alias("protocol"), F.split_part(user, F.lit(":"), F.lit(1)).alias("username"), F.split_part(user, F.lit(":"), F.lit(2)).alias("password"),
        host.alias("host"), F.regexp_replace(host, r":\d+$", "").alias("hostname"), port.alias("port"), part("PATH").alias("pathname"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise("").alias("search"), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise("").alias("hash"), F.concat(scheme, F.lit("://"), host).alias("origin"),
    )
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), struct)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """``RESOLVE_URL``: each ``url`` on its ``base``; null if it can't be resolved."""
    return pd.Series([absolute(b, u) for b, u in zip(base, url)], dtype=object)


def base_url(url: str, base_href: str | None) -> str:
    """The page's URL, or what its first ``base[href]`` makes of it; unreadable, ``data:`` and ``javascript:`` bases don't count."""
    if base_href is None or not base_href.strip():
        return url
    found = absolute(url, base_href)
    return url if found is None or found.lower().startswith(("data:", "javascript:")) else found
