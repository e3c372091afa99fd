"""URLs and page heads as column expressions: normal form, admission, links, metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import content_id, let, single_spaced

# A version path segment, and suffixes of files that are not pages.
VERSION_SEGMENT = r"^[0-9]+(?:\.[0-9]+)*(?:[-.][A-Za-z0-9]+)?$"
SKIPPED_SUFFIXES = (".pdf", ".zip", ".jar", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".css", ".js", ".map", ".txt", ".xml")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRules:
    """Which URLs belong to a source."""

    prefixes: tuple[str, ...]
    denied: tuple[str, ...] = ()


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def normal_url(url: Column) -> Column:
    """Scheme, host and path: repeated slashes joined, a directory gets index.html, query and fragment go."""
    path = F.regexp_replace(F.when(part(url, 3) == "", "/").otherwise(part(url, 3)), "/{2,}", "/")
    full = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    return F.concat(F.lower(part(url, 1)), F.lit("://"), part(url, 2), full)


def admitted(url: Column, rules: UrlRules) -> Column:
    """Whether a normal URL belongs to the source: prefix, no denied part, no version segment, a page."""
    path, low = part(url, 3), F.lower(url)
    denied = F.lit(False)
    for pattern in rules.denied:
        denied = denied | low.contains(pattern.lower())
    inside = F.lit(None).cast("string")
    for prefix in reversed(rules.prefixes):
        inside = F.when(url.startswith(prefix), F.substr(url, F.lit(len(prefix) + 1))).otherwise(inside)
    skipped = F.lit(False)
    for suffix in SKIPPED_SUFFIXES:
        skipped = skipped | F.lower(path).endswith(suffix)
    versioned = F.split_part(inside, F.lit("/"), F.lit(1)).rlike(VERSION_SEGMENT)
    page = F.lower(path).rlike(r"\.html?$")
    return inside.isNotNull() & ~denied & ~versioned & part(url, 1).isin("http", "https") & ~path.rlike("[{}]") & ~skipped & page


def links(html: Column, page_url: Column, rules: UrlRules | None = None) -> Column:
    """Sorted distinct normal URLs of a page's anchors; root-relative and absolute references are resolved."""
    found = F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    origin = F.concat(part(page_url, 1), F.lit("://"), part(page_url, 2))
    base = F.regexp_replace(part(page_url, 3), "[^/]*$", "")

    def resolve(href: Column) -> Column:
        return F.when(href.rlike(PARTS), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, base, href))

    usable = F.filter(found, lambda h: (h != "") & ~h.rlike("^(#|mailto:|javascript:)"))
    urls = F.transform(usable, lambda h: normal_url(resolve(h)))
    if rules is not None:
        urls = F.filter(urls, lambda u: admitted(u, rules))
    return F.sort_array(F.array_distinct(urls))


def tag_text(html: Column, tag: str) -> Column:
    raw = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return single_spaced(F.regexp_replace(raw, "<[^>]*>", " "))


def plain_text(html: Column) -> Column:
    """Text of a page by rules that SQL can state: scripts, styles, comments and tags go, white space is single."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return single_spaced(F.regexp_replace(bare, "<[^>]*>", " "))


def page_metadata(html: Column, url: Column, product: Column) -> Column:
    """Struct of canonical URL, title, language, content hash and document id."""
    canonical = F.regexp_extract(html, r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']""", 1)
    lang = F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']([^"']+)["']""", 1)
    target = normal_url(F.when(canonical == "", url).otherwise(canonical))

    def build(address: Column) -> Column:
        title = tag_text(html, "title")
        return F.struct(
            address.alias("canonical_url"), F.when(title == "", address).otherwise(title).alias("title"), F.when(lang == "", "en").otherwise(lang).alias("language"),
            F.sha1(html.cast("binary")).alias("content_hash"), content_id(F.concat(product, F.lit(":"), address), "doc").alias("document_id"),
        )

    return let(target, build)
