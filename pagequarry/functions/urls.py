"""URL functions on columns."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: fixed value: what a public host name looks like
PUBLIC_HOST = r"(?i)^(?!-)[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}\z"


def host(url: Column) -> Column:
    """The host in lower case, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def site(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Whether the hosts are equal but for www; false where one is missing."""
    return F.coalesce(site(a) == site(b), F.lit(False))


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def canonical(url: Column) -> Column:
    """Without fragment, empty query and the path's final slash; anything that is no URL stays."""
    x = F.regexp_replace(F.regexp_replace(url, "#.*", ""), r"\?\z", "")
    return F.when(host(url).isNull(), url).otherwise(F.regexp_replace(x, r"^([^?]*://[^/?]+/[^?]*?)/(\?.*)?\z", "$1$2"))


def canonical_website(url: Column) -> Column:
    """Scheme and host without www; the trimmed lower-case text if it is no URL."""
    return F.when(host(url).isNull(), F.lower(F.trim(url))).otherwise(F.concat(scheme(url), F.lit("://"), site(url)))


def rejection(text: Column) -> Column:
    """Why a typed address can't be scanned: empty, spaces, scheme, host; null if it can."""
    x = F.trim(text)
    full = F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("https://"), x))
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, "empty").when(x.rlike(r"\s"), "spaces").when(~scheme(full).isin("http", "https"), "scheme").when(~F.coalesce(host(full).rlike(PUBLIC_HOST), F.lit(False)), "host")


def resolve(href: Column, base: Column) -> Column:
    """The address of a link on a page: http(s) only, without fragment; null otherwise.

    Links that are rooted or absolute already, nearly all of them, need no Python.
    """
    clean = F.regexp_replace(F.trim(href), "#.*", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return (
        F.when(href.isNull(), None)
        .when(clean.rlike(r"^/(?!/)") & ~F.contains(clean, F.lit("/.")), F.concat(origin, clean))
        .when(clean.rlike(r"(?i)^https?://[^/?#]+/") & ~F.contains(clean, F.lit("/.")), clean)
        .when(clean.rlike(r"(?i)^(mailto|tel|javascript|data|ftp|file):"), None)
        .otherwise(F.pandas_udf(_resolve_all, T.StringType())(href, base))
    )


def _resolve_all(href: pd.Series, base: pd.Series) -> pd.Series:
    def one(h: str | None, b: str | None) -> str | None:
        if h is None or b is None:
            return None
        try:
            parts = urlsplit(urljoin(b, h.strip()))
            if parts.scheme not in ("http", "https") or not parts.hostname:
                return None
            return urlunsplit((parts.scheme, parts.netloc.lower(), parts.path or "/", parts.query, ""))
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)
