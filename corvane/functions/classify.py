"""Classifiers and predicates (Q1-Q11)."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corvane.functions.text import bytes_of, contains_any, is_blank, lines, non_blank_lines, trim_space

#: Marks of HTML that leaked into text.
HTML_ARTIFACTS = ("<script", "<link", "<style", "<!doctype", "<html", "<head", "<body", "<!--blazor:", "blazor.server.js", "__next_data__", "__nuxt__")
MIN_BYTES, MIN_LINES = 200, 5
#: Reasons of the quality gate.
ARTIFACT, SHORT, FEW_LINES = "content contains raw HTML artifacts", "content too short", "too few non-empty lines"
#: Marks of script frameworks in order of precedence.
SPA_MARKS = (
    ("Blazor", ("_framework/blazor", "<!--Blazor:", 'id="components-reconnect-modal"')),
    ("NextJs", ("__NEXT_DATA__", "_next/static")),
    ("Nuxt", ("__NUXT__", "data-nuxt")),
    ("Angular", ("<app-root>", "ng-version", "<ng-app>")),
    ("Astro", ("data-astro-transition", "data-astro-cid")),
    ("SvelteKit", ("$app/", "data-sveltekit")),
)
#: Marks of blocking services in bodies (lower-cased), and paywall phrases with weights.
BODY_MARKS = {
    "Cloudflare": ("cloudflare", "challenge-platform", "cf-browser-verification"),
    "PerimeterX": ("_pxcaptcha", "perimeterx", "_pxm", "px-captcha"),
    "DataDome": ("datadome",),
    "Akamai": ("akamai", "reference #"),
    "recaptcha": ("recaptcha", "g-recaptcha"),
    "hcaptcha": ("hcaptcha", "h-captcha"),
}
PAYWALL = (
    ("subscribe to continue", 0.9),
    ("premium content", 0.8),
    ("paywall", 0.95),
    ("subscription required", 0.9),
    ("members only", 0.7),
    ("sign in to read", 0.7),
    ("this article is for subscribers", 0.85),
)
PAYWALL_LEAST = 0.8


def has_html_artifact(x: Column) -> Column:
    """The marks by any case of A-Z, looked for in one pass; the text isn't copied for each."""
    return F.rlike(x, F.lit("(?i)" + "|".join(map(re.escape, HTML_ARTIFACTS))))


def quality_reason(x: Column) -> Column:
    """Why a text isn't worth keeping; null if it is."""
    return F.when(has_html_artifact(x), ARTIFACT).when(bytes_of(x) < MIN_BYTES, SHORT).when(non_blank_lines(x) < MIN_LINES, FEW_LINES)


def quality(x: Column) -> Column:
    reason = quality_reason(x)
    return F.struct(reason.isNull().alias("is_valuable"), bytes_of(x).alias("char_count"), non_blank_lines(x).cast("long").alias("line_count"), reason.alias("reason"))


def spa_body(html: Column) -> Column:
    """Whether the body has only script, comment and div lines."""
    start = F.locate("<body", html)
    after = F.substr(html, start)
    opened = F.instr(after, ">")
    rest = F.substr(after, opened + 1)
    end = F.length(rest) - F.length(F.regexp_extract(rest, r"(?s)^.*(</body>.*)$", 1))
    inner = F.when(F.contains(rest, F.lit("</body>")), F.substr(rest, F.lit(1), end)).otherwise(rest)
    allowed = F.forall(lines(inner), lambda x: is_blank(x) | F.rlike(trim_space(x), F.lit(r"^(<script|</script|<!--|<div)")))
    return F.when((start > 0) & (opened > 0), allowed).otherwise(F.lit(False))


def spa_framework(html: Column) -> Column:
    out = None
    for name, marks in SPA_MARKS:
        test = contains_any(html, marks)
        out = F.when(test, name) if out is None else out.when(test, name)
    body = spa_body(html)
    return out.when(F.contains(html, F.lit('<div id="root">')) & body, "React").when(F.contains(html, F.lit('<div id="app">')) & body, "Vue").when(body & F.contains(html, F.lit("<div id=")), "GenericSpa")


def paywall_score(body_lower: Column) -> Column:
    return F.greatest(*[F.when(F.contains(body_lower, F.lit(p)), F.lit(w)).otherwise(F.lit(0.0)) for p, w in PAYWALL])


def block_type(status: Column, body: Column, headers: Column) -> Column:
    """The kind of block that a response shows, or null; captchas are captcha:<vendor>."""
    low = F.lower(body)
    names = F.transform(F.map_keys(headers), F.lower)
    entries = F.map_entries(headers)

    def marked(kind: str) -> Column:
        return contains_any(low, BODY_MARKS[kind])

    cloudflare = F.array_contains(names, "cf-ray") | F.exists(entries, lambda e: (F.lower(e["key"]) == "server") & F.contains(F.lower(e["value"]), F.lit("cloudflare"))) | marked("Cloudflare")
    datadome = marked("DataDome") | F.exists(entries, lambda e: F.contains(F.lower(e["key"]), F.lit("datadome")) | F.contains(F.lower(e["value"]), F.lit("datadome")))
    akamai = F.array_contains(names, "x-akamai-transformed") | marked("Akamai")
    return (
        F.when(status == 429, "RateLimit")
        .when(status == 401, "AuthWall")
        .when(status == 200, F.when(paywall_score(low) >= PAYWALL_LEAST, "Paywall"))
        .when(~status.isin(403, 503), F.lit(None).cast("string"))
        .when(cloudflare, "Cloudflare")
        .when(marked("PerimeterX"), "PerimeterX")
        .when(datadome, "DataDome")
        .when(akamai, "Akamai")
        .when(marked("recaptcha"), "captcha:recaptcha")
        .when(marked("hcaptcha"), "captcha:hcaptcha")
        .when(status == 403, "Unknown")
    )


def error_class(kind: Column, status: Column) -> Column:
    """Class of a fetch error; kind is timeout, tls, browser, network or http."""
    return F.when(kind.isin("timeout", "tls", "browser", "network"), "Transient").when(status == 429, "RateLimited").when(status.isin(403, 503), "Blocking").otherwise("NotFound")


def response_class(block: Column) -> Column:
    """Class of a blocked response; null without a block."""
    return F.when(block.isNull(), F.lit(None).cast("string")).when(block == "RateLimit", "RateLimited").when(block == "AuthWall", "NotFound").otherwise(F.concat(F.lit("Blocked:"), block))


def probe_result(status: Column, location: Column) -> Column:
    kind = F.when(status.isin(200, 206), "Accessible").when(status.isin(301, 302, 307, 308), "Redirect").when(status.isin(403, 503), "Blocked").otherwise("Accessible")
    return F.struct(kind.alias("kind"), F.when(kind == "Redirect", F.coalesce(location, F.lit(""))).alias("location"))


def confidence(n_bytes: Column, blocked: Column) -> Column:
    return F.when((n_bytes > 500) & ~blocked, "high").when((n_bytes > 500) & blocked, "medium").when(n_bytes > 100, "medium").otherwise("low")


def fetch_confidence(cache_hit: Column, js_rendered: Column) -> Column:
    """Confidence that diagnostics state."""
    return F.when(cache_hit, "high").when(js_rendered, "medium").otherwise("high")


def private_ipv4(host: Column) -> Column:
    """Whether an IPv4 literal is private, loopback, link-local, unspecified or broadcast; null if it is no such literal."""
    parts = F.transform(F.split(host, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (host == "255.255.255.255")
    literal = F.rlike(host, F.lit(r"^\d{1,3}(\.\d{1,3}){3}\z")) & F.forall(parts, lambda p: p <= 255)
    return F.when(literal, private)


@F.pandas_udf(BooleanType())
def private_address(host: pd.Series) -> pd.Series:
    """As private_ipv4, for IPv6 literals too (with or without brackets); null for names."""

    def one(x: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address((x or "").strip("[]"))
        except ValueError:
            return None
        if ip.version == 6 and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        if ip.version == 4:
            return any(ip in n for n in _V4)
        return any(ip in n for n in _V6)

    return host.map(one).astype("object")


#: Networks that may not be fetched from.
_V4 = [ipaddress.ip_network(x) for x in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "255.255.255.255/32")]
_V6 = [ipaddress.ip_network(x) for x in ("::1/128", "fe80::/10", "fc00::/7")]
