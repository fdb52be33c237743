"""URL functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions.secrets import mask_known

from evidra.functions.udf import batched

#: Publishers by category; a host counts if it is one of these or below it.
BANK = ("worldbank.org",)
GOVERNMENT = ("gov.vn", "gov")
INTERNATIONAL = ("un.org", "unodc.org", "who.int", "oecd.org")
#: Parameters that track visits, and those whose values are credentials.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid)$"
CREDENTIAL = r"(?i)key|token|secret|password|signature|credential"
#: Scheme, authority, path and query of an HTTP(S) address; brackets are only taken around a host.
_SHAPE = r"^(?i)(https?)://((?:[^/?#@\[\]]*@)?(?:\[[^/?#\[\]]*\]|[^/?#@\[\]:]+)(?::[^/?#@\[\]]*)?)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@batched("string")
def _entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


class _Address:
    """The parts of an address as columns; all are empty where it isn't HTTP(S)."""

    def __init__(self, url: Column) -> None:
        whole = F.regexp_replace(url, "[\\t\\r\\n]", "")
        self.scheme, self.authority, self.path, self.query = (F.regexp_extract(whole, _SHAPE, g) for g in (1, 2, 3, 4))
        self.user = F.regexp_extract(self.authority, "^(.*)@", 1)
        self.host = F.regexp_replace(F.regexp_replace(self.authority, "^.*@", ""), r":[^:\]]*$", "")

    def pairs(self) -> Column:
        """Decoded names and values of the query, in order; a stray percent sign stands for itself."""

        def decoded(x: Column) -> Column:
            return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))

        given = F.filter(F.split(self.query, "&"), lambda p: p != "")
        return F.transform(given, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))


def _joined(pairs: Column) -> Column:
    """A query string with a question mark; nothing for no pairs."""

    def coded(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    text = F.array_join(F.transform(pairs, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), text)).otherwise("")


def canonical_url(url: Column | str) -> Column:
    """Canonical form, null for a URL that isn't public HTTP(S).

    Entities are decoded, tracking parameters dropped, the others sorted and
    encoded anew, scheme and host lower-cased, the fragment dropped.
    """
    a = _Address(F.regexp_replace(_entities(url), r"(?U)^\s+|\s+$", ""))
    kept = F.array_sort(F.filter(a.pairs(), lambda p: ~p["k"].rlike(TRACKING)))
    path = F.when(a.path == "", "/").otherwise(a.path)
    return F.when((a.scheme != "") & a.user.isin("", ":"), F.concat(F.lower(a.scheme), F.lit("://"), F.lower(a.authority), path, _joined(kept)))


def safe_url(url: Column | str, known: tuple[str, ...] = ()) -> Column:
    """The URL with the values of credential parameters and all known secrets masked; empty for anything but HTTP(S).

    Secrets are masked wherever they stand, in the given URL and in the finished one, whose values are encoded anew.
    """
    column = F.col(url) if isinstance(url, str) else url
    a = _Address(mask_known(F.regexp_replace(column, r"^[\x00-\x20]+", ""), known))
    masked = F.transform(a.pairs(), lambda p: F.struct(p["k"].alias("k"), F.when(p["k"].rlike(CREDENTIAL), "[MASKED]").otherwise(p["v"]).alias("v")))
    shown = F.concat(F.lower(a.scheme), F.lit("://"), F.lower(a.host), a.path, _joined(masked))
    return F.when(column.isNotNull(), F.when(a.scheme == "", "").otherwise(mask_known(shown, known)))


def host(url: Column) -> Column:
    """Lower-cased host name, null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _under(h: Column, roots: tuple[str, ...], itself: bool = True) -> Column:
    found = F.lit(False)
    for r in roots:
        found = found | F.endswith(h, F.lit("." + r))
        if itself:
            found = found | (h == r)
    return found


def source_priority(url: Column) -> Column:
    """4 for World Bank and government hosts, 3 for international bodies, else 0."""
    h = F.coalesce(host(url), F.lit(""))
    return F.when(_under(h, BANK) | _under(h, GOVERNMENT, itself=False), 4).when(_under(h, INTERNATIONAL), 3).otherwise(0)


def public_url(url: Column) -> Column:
    """F9 without name resolution: HTTP(S), a host, no credentials, port 80, 443 or none."""
    authority = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host(url).isNotNull() & ~F.contains(authority, F.lit("@")) & port.isin("", "80", "443"), F.lit(False))


def allowed_api_url(url: Column, hosts: tuple[str, ...], prefix: str = "/v2/") -> Column:
    """F8: HTTPS on a listed host, port 443 or none, no credentials, path under ``prefix``."""
    return F.coalesce(public_url(url) & (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & ~F.try_parse_url(url, F.lit("AUTHORITY")).endswith(":80") & host(url).isin(*hosts) & F.startswith(F.try_parse_url(url, F.lit("PATH")), F.lit(prefix)), F.lit(False))


def indicator_id(url: Column) -> Column:
    """The indicator of a catalogue page on the data host, else null."""
    found = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/indicator/([A-Za-z0-9.]+)$", 1)
    return F.when((host(url) == "data.worldbank.org") & (found != ""), found)
