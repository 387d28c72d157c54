"""Picture choice for a feed entry, as native expressions over the raw HTML and media arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import WS, let

# Substrings of an image URL, of an image host or path, and of things that are not pictures.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg"]
HOSTS_AND_PATHS = [
    "wp-content/uploads", "wp-content", "i0.wp.com", "i1.wp.com", "i2.wp.com", "i3.wp.com", "/img/", "/image/",
    "/images/", "/media/", "cdn.", "cloudfront.net", "imgur.com", "imagekit.io", "dam.mediacorp.sg",
    "arstechnica.net", "anpoimages.com", "artificialintelligence-news.com", "9to5mac.com", "techcrunch.com",
    "/resize/", "/upload/", "contentstack.com", "dev.to/dynamic/image", "sanity.io",
]
NOT_PICTURES = ["logo", "icon", "sprite", "spacer", "blank", "pixel", "1x1", "tracking", ".css", ".js", ".xml", ".json"]
LAZY_ATTRIBUTES = ["data-original-mos", "data-pin-media", "data-src", "data-url", "data-lazy-src"]

ELLIPSIS = "…"
_TAG_BODY = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def any_of(parts: list[str]) -> str:
    """Regex that finds any of ``parts`` literally (valid for Java and RE2)."""
    return "|".join(p.replace(".", r"\.") for p in parts)


def is_image_url(url: Column) -> Column:
    low = F.lower(url)
    blank = F.regexp_replace(F.coalesce(url, F.lit("")), WS + "+", "") == ""
    return (F.when(blank, False).when(low.rlike(any_of(EXTENSIONS)), True).when(low.rlike(any_of(HOSTS_AND_PATHS)), True)
            .when(low.rlike(any_of(NOT_PICTURES)), False)
            .otherwise(low.rlike("^https?://") & (F.length(url) > 20)))


def tags(html: Column, name: str) -> Column:
    """All start tags ``name`` of a page, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]){_TAG_BODY}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag; NULL when the tag has none."""
    start = rf"(?is)[\s\"'/]{name}\s*=\s*"
    found = [F.regexp_extract(tag, start + body, 1) for body in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    value = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    for entity, shown in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(shown))
    return value


def _clean(url: Column) -> Column:
    return F.trim(F.replace(url, F.lit(ELLIPSIS), F.lit("")))


def _whole(text: Column) -> Column:
    """Integer text to a number, anything else to NULL."""
    return F.trim(text).try_cast("long")


def _from_srcset(srcset: Column) -> Column:
    """Widest valid entry of a srcset; the first of equal width."""
    def entry(text, i):
        parts = F.split(F.trim(text), r"\s+")
        size = F.get(parts, F.lit(1))
        width = F.when(size.endswith("w"), _whole(F.regexp_replace(size, "w$", "")))
        return F.struct(F.coalesce(width, F.lit(0)).alias("width"), (-i).alias("turn"), _clean(parts[0]).alias("url"))

    entries = F.filter(F.transform(F.split(srcset, ","), entry), lambda e: is_image_url(e["url"]))
    return F.array_max(entries)["url"]


def image_from_html(html: Column) -> Column:
    """Best picture of an HTML fragment: per img the src, else the widest srcset entry, else a
    lazy-loading attribute; among those the largest width x height, the first on ties."""
    def candidate(tag, i):
        valid = lambda c: F.when(is_image_url(c), c)
        url = F.coalesce(valid(_clean(attribute(tag, "src"))), _from_srcset(attribute(tag, "srcset")),
                         *[valid(_clean(attribute(tag, a))) for a in LAZY_ATTRIBUTES])
        area = F.try_multiply(_whole(F.coalesce(attribute(tag, "width"), F.lit("0"))),
                              _whole(F.coalesce(attribute(tag, "height"), F.lit("0"))))
        return F.struct(F.coalesce(area, F.lit(0)).alias("area"), (-i).alias("turn"), url.alias("url"))

    found = F.filter(F.transform(tags(html, "img"), candidate), lambda c: c["url"].isNotNull())
    return F.array_max(found)["url"]


def meta_image(html: Column) -> Column:
    """og:image of the page, overridden by a valid twitter:image."""
    def content_of(metas, prop):
        first = F.get(F.filter(metas, lambda m: attribute(m, "property") == prop), F.lit(0))
        value = attribute(first, "content")
        return F.when(is_image_url(value), value)

    return let(tags(html, "meta"), lambda m: F.coalesce(content_of(m, "twitter:image"), content_of(m, "og:image")))


def first_image_src(html: Column) -> Column:
    src = attribute(F.get(tags(html, "img"), F.lit(0)), "src")
    return F.when(is_image_url(src), src)


def _first_valid(urls: Column) -> Column:
    return F.get(F.filter(urls, lambda u: is_image_url(u)), F.lit(0))


#: Where a picture is looked for, in order.
PRECEDENCE = ("media_content", "media_thumbnail", "enclosures", "image", "content", "meta", "first_img")


def entry_image(media_content: Column, media_thumbnail: Column, enclosures: Column, image: Column, content: Column,
                html: Column, order: tuple[str, ...] = PRECEDENCE) -> Column:
    """Picture of a feed entry: the first place in ``order`` that has a valid one. ``html`` is the
    raw summary markup."""
    bodies = F.transform(content, lambda c: image_from_html(c["value"]))
    places = {
        "media_content": _first_valid(F.transform(media_content, lambda m: m["url"])),
        "media_thumbnail": _first_valid(F.transform(media_thumbnail, lambda m: m["url"])),
        "enclosures": _first_valid(F.transform(enclosures, lambda e: e["href"])),
        "image": F.when(is_image_url(image["href"]), image["href"]),
        "content": F.coalesce(image_from_html(html), F.get(F.filter(bodies, lambda b: b.isNotNull()), F.lit(0))),
        "meta": meta_image(html),
        "first_img": first_image_src(html),
    }
    return F.coalesce(*[places[p] for p in order])
