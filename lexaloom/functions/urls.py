"""URL normalization as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Query parameters that only track visitors.
TRACKING_KEYS = ("gclid", "fbclid", "yclid")
TRACKING_PREFIX = "utm_"

#: scheme, authority, path, query of a generic URI; the fragment is left out.
_URI = "(?s)^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
_DEFAULT_PORTS = (("http", ":80"), ("https", ":443"))


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(query: Column) -> Column:
    """Sorted, re-encoded parameters; tracking ones dropped, blank values kept."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        at = F.locate("=", p)
        key = F.when(at > 0, F.substring_index(p, "=", 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(_decoded(key).alias("k"), _decoded(value).alias("v"))

    pairs = F.filter(F.transform(pieces, pair), lambda x: ~F.lower(x["k"]).isin(*TRACKING_KEYS) & ~F.startswith(F.lower(x["k"]), F.lit(TRACKING_PREFIX)))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme (http where missing) and host, no default port, no
    fragment, `/` for an empty path, parameters sorted and without trackers. Null is empty."""
    raw = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "\\A[\\x00-\\x20]+|[\\t\\r\\n]", "")
    scheme = F.lower(F.regexp_extract(raw, _URI, 1))
    scheme = F.when(scheme == "", "http").otherwise(scheme)
    host = F.lower(F.regexp_extract(raw, _URI, 2))
    for name, port in _DEFAULT_PORTS:
        host = F.when((scheme == name) & F.endswith(host, F.lit(port)), F.left(host, F.length(host) - len(port))).otherwise(host)
    path = F.regexp_extract(raw, _URI, 3)
    path = F.when(path == "", "/").otherwise(path)
    query = _query(F.regexp_extract(raw, _URI, 4))
    authority = F.when((host != "") | F.startswith(path, F.lit("/")), F.concat(F.lit("//"), host)).otherwise(F.lit(""))
    return F.concat(scheme, F.lit(":"), authority, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
