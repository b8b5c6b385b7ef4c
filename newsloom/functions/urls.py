"""URL functions.

The grammar is deliberately simple: everything up to the first `://` is the scheme, up to the
next `/` is the host (with port and, lacking a slash, a query), up to the next `?` the path.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.strings import ascii_lower

_HOST = r"(?s)\A.*?://([^/]*)"
_PATH = r"(?s)\A.*?://[^/]*(/[^?]*)"
_QUERY = r"(?s)\A.*?://[^/]*/[^?]*\?(.*)"
_AFTER_SLASH = r"(?s)\A[^/]*/(.*)"
_AFTER_HOST = r"(?s)\A.*?://[^/]*/(.*)"

# Tracking parameters that never tell two articles apart.
TRACKING_PREFIXES = ["utm_", "fbclid="]


def _clean_query(query: Column) -> Column:
    parts = F.concat(F.lit("&"), F.regexp_replace(query, r"&\z", ""))
    kept = F.regexp_replace(parts, rf"&(?:{'|'.join(TRACKING_PREFIXES)})[^&]*", "")
    return F.regexp_replace(kept, r"\A&+", "")


def normalize_url(url: Column) -> Column:
    """Canonical form of a link: no fragment, no tracking parameters, lower-case scheme and host,
    one leading `www.` and one trailing `/` dropped. Text without `://` only loses its fragment."""
    bare = F.substring_index(url, "#", 1)
    scheme = ascii_lower(F.substring_index(bare, "://", 1))
    host = F.regexp_replace(ascii_lower(F.regexp_extract(bare, _HOST, 1)), r"\Awww\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, _PATH, 1), r"(?s)\A(.+)/\z", "$1")
    query = F.when(F.contains(bare, F.lit("?")), _clean_query(F.regexp_extract(bare, _QUERY, 1)))
    return F.when(
        F.contains(bare, F.lit("://")),
        F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")),
    ).otherwise(bare)


def url_host(url: Column, schemeless: bool = False) -> Column:
    """Lower-case host with its port. Without a scheme: empty, or with `schemeless` the text up to
    the first slash."""
    host = ascii_lower(F.regexp_extract(url, _HOST, 1))
    if not schemeless:
        return host
    return F.when(F.contains(url, F.lit("://")), F.lower(F.regexp_extract(url, _HOST, 1))).otherwise(
        F.lower(F.substring_index(url, "/", 1))
    )


def after_host(url: Column) -> Column:
    """Lower-case text after the first slash that follows the scheme."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, _AFTER_HOST, 1)).otherwise(
        F.regexp_extract(url, _AFTER_SLASH, 1)
    )
    return ascii_lower(rest)


def path_tokens(url: Column) -> Column:
    """Lower-case alphanumeric runs of three or more characters after the host."""
    return F.regexp_extract_all(after_host(url), F.lit(r"[a-z0-9]{3,}"), F.lit(0))
