"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host(url: Column | str) -> Column:
    """Lower-case host."""
    return F.lower(_part(col(url), "HOST"))


def path(url: Column | str) -> Column:
    """Path, empty if there is none."""
    return F.coalesce(_part(col(url), "PATH"), F.lit(""))


def _raw_path(url: Column | str) -> Column:
    """Path of a web URL as written, blanks and other characters that a URL may not have included; null of null."""
    return F.regexp_extract(col(url), r"^https?://[^/?#]*([^?#]*)", 1)


def is_web(url: Column | str) -> Column:
    """Scheme http or https, and a host."""
    return F.coalesce(F.lower(_part(col(url), "PROTOCOL")).isin("http", "https") & host(url).isNotNull(), F.lit(False))


# Endings of files that are no pages.
SKIPPED = ".png .jpg .jpeg .gif .svg .webp .ico .pdf .zip .msi .exe .xml .json .css .js .txt .rss .atom .mp4 .woff .woff2 .ttf".split()


def canonical(url: Column | str, hosts: list[str] | None = None) -> Column:
    """Host and path over https without index file, query, fragment and final slash (the root keeps its own); null if it is no page to read."""
    p = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), r"/index(\.html?)?$", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    good = is_web(url) & ~F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1)).isin(*SKIPPED) & ~F.contains(p, F.lit("/feeds/"))
    if hosts:
        good = good & host(url).isin(*hosts)
    return F.when(good, F.concat(F.lit("https://"), host(url), p))


def without_fragment(url: Column | str) -> Column:
    """No fragment, no slashes at the end."""
    return F.regexp_replace(F.regexp_replace(col(url), "#.*$", ""), "/+$", "")


def under_path(url: Column | str, prefix: str) -> Column:
    """The path is ``prefix`` or below it, at a segment's boundary."""
    p = path(url)
    return (p == prefix) | p.startswith(prefix.rstrip("/") + "/")


def starts_with(url: Column | str, prefix: str) -> Column:
    """Plain prefix test without a boundary."""
    return col(url).startswith(prefix.rstrip("/"))


def has_locale(url: Column | str) -> Column:
    """The first path segment names a language, like en or pt-br."""
    return F.coalesce(F.get(F.split(path(url), "/"), F.lit(1)).rlike("^[a-z]{2}([-_][a-z]{2})?$"), F.lit(False))


def same_site(a: Column | str, b: Column | str) -> Column:
    """Equal hosts, www. aside."""
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return bare(a) == bare(b)


def file_name(url: Column | str) -> Column:
    """A safe markdown file name from a URL's path."""
    x = F.regexp_replace(_raw_path(url), "^/+|/+$", "")
    x = F.regexp_replace(F.regexp_replace(F.when(x == "", "index").otherwise(x), r"\.html?$", ""), "[^a-zA-Z0-9/_-]", "_")
    return F.concat(F.when(x.endswith("/"), F.concat(x, F.lit("index"))).otherwise(x), F.lit(".md"))


def category_name(url: Column | str) -> Column:
    """Last path segment as words, the first letter large and the rest small."""
    last = F.replace(F.element_at(F.split(F.regexp_replace(_raw_path(url), "/+$", ""), "/"), -1), F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(last, 1, 1)), F.lower(F.substr(last, F.lit(2))))


def absolute(base: Column | str, href: Column | str) -> Column:
    """A link made absolute: full links, //host, /path, ?query, #fragment, and names beside the base."""
    b, h = col(base), F.trim(col(href))
    root = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(b, "[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(h == "", b)
        .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(b, "[?#].*$", ""), h))
        .otherwise(F.concat(folder, h))
    )
