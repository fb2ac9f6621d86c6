"""HTML expressions over whole pages, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def title(html: Column) -> Column:
    return text.normalize_ws(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "(?s)<[^>]*>", ""))


def hrefs(html: Column) -> Column:
    """Targets of anchors in page order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def internal_links(html: Column, page_filter: str = r"(?i)\.html?$") -> Column:
    """Distinct links inside the site in order: no scheme, fragment and query off, those that match page_filter."""
    kept = F.filter(hrefs(html), lambda h: ~h.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|#|//)"))
    bare = F.transform(kept, lambda h: F.regexp_replace(h, r"[#?].*$", ""))
    return F.array_distinct(F.filter(bare, lambda h: h.rlike(page_filter)))


def external_links(html: Column) -> Column:
    """Sorted distinct http links."""
    return F.sort_array(F.array_distinct(F.filter(hrefs(html), lambda h: h.rlike("(?i)^https?://"))))


def declared_charset(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"""(?i)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)""", 1))
    return F.when(found != "", found)


def ensure_charset(html: Column) -> Column:
    """Keep a UTF-8 declaration, replace another, else insert one behind <head>, else leave the page."""
    declared = declared_charset(html)
    meta = '<meta charset="utf-8">'
    return (
        F.when(declared.isin("utf-8", "utf8"), html)
        .when(declared.isNotNull(), F.regexp_replace(html, r"(?is)^(.*?)<meta[^>]*charset=[^>]*>", "$1" + meta))
        .when(html.rlike("(?i)<head[^>]*>"), F.regexp_replace(html, r"(?is)^(.*?<head[^>]*>)", "$1" + meta))
        .otherwise(html)
    )


def resolve(base: Column, href: Column) -> Column:
    """href against the folder of base, '.' and '..' folded."""
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href))
    parts = F.split(F.regexp_replace(F.regexp_replace(joined, r"[#?].*$", ""), "^/+", ""), "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == "..", done).otherwise(F.concat(done, F.array(p))),
    )
    return F.array_join(folded, "/")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def block_segments(html: Column, blocks: str = "p|div|h[1-6]|li|ul|ol|nav|article|footer|table|tr|td|body|head|title|html|section") -> Column:
    """Non-empty pieces between block tags, comments and scripts off, inline markup as placeholders numbered per piece."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "(?is)<(script|style).*?</(script|style)>", "")
    pieces = F.split(bare, rf"(?is)</?(?:{blocks})(?:\s[^>]*)?>|<![^>]*>|<meta[^>]*>")
    return F.filter(F.transform(pieces, lambda p: text.normalize_ws(p)), lambda p: F.length(F.regexp_replace(p, "(?s)<[^>]*>", "")) > 0)
