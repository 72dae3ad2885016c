"""Urls: a stable form, parts, admissible product urls.

Ordinary urls (ASCII, nothing to quote) are put in order by columns.  Python has the
rest: relative ones, international hosts, escapes.
"""

from __future__ import annotations

import html
import re
from urllib.parse import quote, quote_plus, unquote_plus, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

# Query parameters that only track a visitor; so do those that start with utm_.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
# The usual port of a scheme; characters of a path that stay unescaped.
USUAL_PORT = {"http": "80", "https": "443"}
PATH_SAFE = "/%:@-._~!$&'()*+,;="

#: Scheme, authority, path and query of a url (RFC 3986, appendix B).
_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
#: User part, host or bracketed address, port of an authority.
_AUTHORITY = re.compile(r"(?:.*@)?(\[[0-9A-Fa-f:.]+\]|[^:\[\]]+)(?::(\d*))?")


def _site(authority: str, usual: str) -> str | None:
    """Host in ASCII with its port, unless that is the usual one; null where it is none."""
    found = _AUTHORITY.fullmatch(authority)
    if not found:
        return None
    name, port = found[1].lower(), (found[2] or "").lstrip("0")
    if port and int(port) > 65535:
        return None
    try:
        name = name if name.startswith("[") else name.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    return f"{name}:{port}" if port and port != usual else name


def _arguments(query: str) -> str:
    """The query's arguments that mean something, in order."""
    named = (x.partition("=") for x in query.split("&") if x)
    pairs = ((unquote_plus(k), unquote_plus(v)) for k, _, v in named)
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs) if not (k.lower().startswith("utm_") or k.lower() in TRACKING))


def canonical_url(value: str | None, base: str | None = None) -> str | None:
    """The stable form of an http(s) url; null where it is blank or not one."""
    if not isinstance(value, str) or not (plain := " ".join(html.unescape(value).split())):
        return None
    try:
        found = _PARTS.match(urljoin(base, plain) if base else plain)
    except ValueError:
        return None
    scheme = found[1].lower() if found else ""
    site = _site(found[2], USUAL_PORT[scheme]) if scheme in USUAL_PORT else None
    if not site:
        return None
    way = quote("".join(f"/{step}" for step in found[3].split("/") if step) or "/", safe=PATH_SAFE)
    asked = _arguments(found[4] or "")
    return f"{scheme}://{site}{way}?{asked}" if asked else f"{scheme}://{site}{way}"


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(canonical_url, na_action="ignore")


#: Urls that need no decoding or quoting: scheme, host, port, path, query of plain key=value pairs.
_PLAIN = r"^([Hh][Tt][Tt][Pp][Ss]?)://([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)(?::([1-9][0-9]{0,3}))?((?:/[A-Za-z0-9:@._~!$'()*,;=-]*)*)(?:\?((?:[A-Za-z0-9._~-]+=[A-Za-z0-9._~-]*)(?:&[A-Za-z0-9._~-]+=[A-Za-z0-9._~-]*)*))?(?:#[\x21-\x25\x27-\x7e]*)?$"


def normalize_url(url: Column | str) -> Column:
    """The stable form of an http(s) url, null where it is blank or not one."""
    url = F.col(url) if isinstance(url, str) else url
    # Taken apart in one match; a plain url has no white space but a line's end after it, and a part that is missing is empty.
    parts = F.when(F.rlike(url, F.lit(_PLAIN)), F.split(F.regexp_replace(url, _PLAIN + "(?s).*", "$1 $2 $3 $4 $5"), " "))
    plain = text.let(parts, _joined)
    return F.coalesce(plain, _canonical(F.when(plain.isNull(), url)))


def _joined(parts: Column) -> Column:
    """The stable form of a plain url's parts; null for a host in ASCII form, and where there are none."""
    part = lambda i: F.get(parts, i - 1)
    scheme, port, path_ = F.lower(part(1)), part(3), F.rtrim(F.regexp_replace(part(4), "/{2,}", "/"), F.lit("/"))
    usual = F.when(scheme == "https", USUAL_PORT["https"]).otherwise(USUAL_PORT["http"])
    name = lambda pair: F.lower(F.substring_index(pair, "=", 1))
    kept = F.filter(F.split(part(5), "&"), lambda x: (x != "") & ~F.startswith(name(x), F.lit("utm_")) & ~name(x).isin(*TRACKING))
    pairs = F.array_sort(F.transform(kept, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))))
    asked = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    plain = F.concat(
        scheme, F.lit("://"), F.lower(part(2)), F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(F.lit("")),
        F.when(path_ == "", F.lit("/")).otherwise(path_), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")),
    )
    return F.when(~F.contains(F.lower(part(2)), F.lit("xn--")), plain)


@F.pandas_udf(T.StringType())
def resolve_url(values: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([canonical_url(v, b) for v, b in zip(values, bases, strict=True)])


def require_url(url: Column) -> Column:
    """As normalize_url, but a url that is neither blank nor http(s) is an error."""
    out = normalize_url(url)
    return F.when(out.isNull() & (F.trim(url) != ""), F.raise_error(F.concat(F.lit("not an http(s) url: "), url)).cast("string")).otherwise(out)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path, / where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def target(url: Column) -> Column:
    """What robots rules are held against: the path, and ? and the query if there is one."""
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def admissible_product(url: Column, site: str, allowed: Column) -> Column:
    """A product page of ``site`` that is no internal route and that robots allow."""
    return (host(url) == site) & F.startswith(path(url), F.lit("/product/")) & ~F.rlike(path(url), F.lit(r"(?i)^/catalog/product/view/id(/|$)")) & allowed
