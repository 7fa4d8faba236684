"""URL expressions (U1-U9).  A scheme is matched case-sensitively, as stored URLs have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """Up to the first slash, then the first colon, of an http(s) URL; null without a scheme or domain."""
    return F.nullif(F.when(F.rlike(url, F.lit("^https?://")), F.regexp_extract(url, "^https?://([^/:]*)", 1)), F.lit(""))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^(https://|http://)", "")


def host(url: Column) -> Column:
    """Lower-cased host; the scheme is optional."""
    return F.lower(F.regexp_extract(without_scheme(url), "^([^/:]*)", 1))


def path(url: Column) -> Column:
    """From the first slash after the scheme on, with the query; a slash if there is none."""
    found = F.regexp_extract(without_scheme(url), "(?s)^[^/]*(/.*)$", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    """What follows the path's first question mark, or null."""
    p = path(url)
    return F.when(F.contains(p, F.lit("?")), F.regexp_extract(p, r"(?s)^[^?]*\?(.*)$", 1))


def title_from_url(url: Column) -> Column:
    return F.split_part(F.regexp_replace(url, "^(https://)*(http://)*", ""), F.lit("?"), F.lit(1))


def encode_form(x: Column) -> Column:
    """Percent-encoding; a space becomes a plus sign."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_strict(x: Column) -> Column:
    return F.replace(encode_form(x), F.lit("+"), F.lit("%20"))


def decode(x: Column) -> Column:
    """Percent-decoding as UTF-8; null if malformed."""
    return F.try_url_decode(x)


def clean_result_url(url: Column) -> Column:
    """Target of a redirecting result link, else the link with a scheme."""
    target = F.regexp_extract(url, "uddg=([^&]*)", 1)
    schemed = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(F.contains(url, F.lit("uddg=")), F.coalesce(decode(target), target)).otherwise(schemed)
