"""Canonical record URLs, by regular expressions: any sub-domain of a host counts, and its www form is canonical."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SHANGHAI_PM
from .values import let

_PARTS = r"^[\s]*(?i:https?|wss?|ftp)://([^/?#@]*@)?([^/?#:@]+)(:\d*)?([^?#]*)"


def _encoded(path: Column) -> Column:
    """Percent-encoded where a URL path must be."""
    escape = lambda c: F.when(c.rlike(r'[^\x21-\x7e]|["<>`{}]'), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    whole = F.array_join(F.transform(F.split(path, ""), escape), "")
    return F.when(path.rlike(r'[^\x21-\x7e]|["<>`{}]'), whole).otherwise(path)


def normalize_url(url: Column) -> Column:
    """https, lower-case host, no port, query or fragment, single slashes; NULL for what is no URL."""
    path = F.regexp_replace(F.regexp_extract(url, _PARTS, 4), "/{2,}", "/")
    host = F.lower(F.regexp_extract(url, _PARTS, 2))
    return F.when(host != "", F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path)))


def site_key(url: Column, prefixes: tuple[str, ...] = ("www", "m", "blog")) -> Column:
    """The host without a usual first label."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), "^(?:" + "|".join(prefixes) + r")\.", "")


def canonical_url(url: Column, host: str = SHANGHAI_PM.host) -> Column:
    """https, the www host, no port, query or fragment, single slashes; NULL for other hosts and what is no URL."""
    name = F.lower(F.regexp_extract(url, _PARTS, 2))
    path = F.regexp_replace(_encoded(F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"\s+$", "")), "/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    ours = name.rlike(rf"^(?:.+\.)?{re.escape(host)}$")
    return F.when(ours, F.concat(F.lit("https://"), F.regexp_extract(url, _PARTS, 1), F.lit(f"www.{host}"), path))


def strict_detail_url(url: Column, host: str = SHANGHAI_PM.host) -> Column:
    """As above, but only the apex, www and m hosts, and only detail pages."""
    name = F.lower(F.regexp_extract(url, _PARTS, 2))
    path = F.regexp_extract(url, _PARTS, 4)
    ok = name.isin(host, f"www.{host}", f"m.{host}") & path.rlike(r"(?i)^/job_detail/[^/]+\.html$")
    return F.when(ok, F.concat(F.lit(f"https://www.{host}"), path))


def url_kind(canonical: Column) -> Column:
    """job_detail, listing, other_boss or unsupported, of a canonical URL."""
    path = F.regexp_extract(canonical, r"^https://[^/]+(/.*)$", 1)
    return (
        F.when(canonical.isNull(), "unsupported")
        .when(path.rlike(r"(?i)^/job_detail/[^/]+?\.html/?$"), "job_detail")
        .when(path.rlike(r"(?i)^/zhaopin/"), "listing")
        .otherwise("other_boss")
    )


def url_job_id(canonical: Column) -> Column:
    """The id in a detail URL's path, NULL for others."""
    return F.nullif(F.regexp_extract(canonical, r"(?i)^https://[^/]+/job_detail/([^/]+?)\.html/?$", 1), F.lit(""))


def detail_url(url: Column, host: str = SHANGHAI_PM.host) -> Column:
    """The canonical URL if it is a detail page's. One that is canonical already is told by a single pattern."""
    already = url.rlike(rf"^https://www\.{re.escape(host)}/job_detail/[\x21-\x7e&&[^\"#/<>?`{{}}]]+\.html\z")
    return F.when(already, url).otherwise(let(canonical_url(url, host), lambda c: F.when(url_kind(c) == "job_detail", c)))
