"""Page audit: structure and accessibility rules over raw HTML, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.images import _TAG_BODY, attribute, tags
from newsweave.functions.text import WS

# Structural elements, and link texts that say nothing.
SEMANTIC = ["main", "header", "footer", "nav", "section", "article", "aside"]
VAGUE = ["click here", "read more", "here", "more", "link"]
UNLABELLED_OK = ["hidden", "submit", "button"]


def elements(html: Column, name: str) -> Column:
    """All ``name`` elements from start tag to the next end tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]){_TAG_BODY}>.*?</{name}\s*>"), F.lit(0))


def shown_text(element: Column) -> Column:
    """Text nodes of an element, each stripped, without a separator."""
    nodes = F.split(F.regexp_replace(element, r"(?s)<[^>]+>", "\x01"), "\x01")
    return F.array_join(F.transform(nodes, lambda n: F.regexp_replace(n, rf"\A{WS}+|{WS}+\z", "")), "")


def _start(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"(?is)\A<{name}{_TAG_BODY}>", 0)


def _nameless(element: Column, name: str) -> Column:
    tag = _start(element, name)
    return (shown_text(element) == "") & attribute(tag, "aria-label").isNull() & attribute(tag, "title").isNull()


def page_audit(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, rule, issues): one row for every rule a page breaks. One narrow pass, no shuffle."""
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    page = pages.select(key, bare.alias("_h"))
    h = F.col("_h")
    page = page.select(
        key, "_h", F.transform(F.regexp_extract_all(h, F.lit(r"(?i)<h([1-6])(?=[\s/>])"), F.lit(1)), lambda x: x.cast("int")).alias("_levels"),
        elements(h, "a").alias("_links"), F.transform(tags(h, "label"), lambda t: attribute(t, "for")).alias("_labels"))
    levels, links = F.col("_levels"), F.col("_links")
    n = F.size(levels)
    steps = F.zip_with(F.slice(levels, 2, F.greatest(n - 1, F.lit(0))), F.slice(levels, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b > a + 1)
    real_links = F.filter(links, lambda e: _start(e, "a").rlike(r"(?is)[\s\"'/]href\s*="))

    def unlabelled(tag):
        kind = F.coalesce(F.lower(attribute(tag, "type")), F.lit("text"))
        named = (F.coalesce(F.array_contains("_labels", attribute(tag, "id")), F.lit(False))
                 | attribute(tag, "aria-label").isNotNull() | attribute(tag, "aria-labelledby").isNotNull())
        return ~kind.isin(UNLABELLED_OK) & ~named

    count = lambda items, test: F.size(F.filter(items, test))
    one = lambda condition: condition.cast("int")
    fields = F.concat(tags(h, "input"), tags(h, "textarea"), tags(h, "select"))
    root = F.get(tags(h, "html"), F.lit(0))
    rules = {
        "no_semantic_element": one(~h.rlike(rf"(?i)<(?:{'|'.join(SEMANTIC)})(?=[\s/>])")),
        "first_heading_not_h1": one((n > 0) & (F.get(levels, F.lit(0)) != 1)),
        "heading_level_skipped": count(steps, lambda s: s),
        "image_without_alt": count(tags(h, "img"), lambda t: attribute(t, "alt").isNull()),
        "input_without_label": count(fields, unlabelled),
        "button_without_text": count(elements(h, "button"), lambda e: _nameless(e, "button")),
        "link_without_text": count(real_links, lambda e: _nameless(e, "a")),
        "vague_link_text": count(real_links, lambda e: F.lower(shown_text(e)).isin(VAGUE)),
        "html_without_lang": one(root.isNotNull() & attribute(root, "lang").isNull()),
        "no_viewport": one(count(tags(h, "meta"), lambda t: attribute(t, "name") == "viewport") == 0),
        "table_without_header": count(elements(h, "table"), lambda e: ~e.rlike(r"(?i)<th(?=[\s/>])")),
    }
    found = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(c, F.lit(0)).cast("long").alias("issues")) for r, c in rules.items()])
    return (page.select(key, F.explode(F.filter(found, lambda x: x["issues"] > 0)).alias("_f")).select(key, "_f.rule", "_f.issues"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Issues and affected pages per rule."""
    return audit.groupBy("rule").agg(F.sum("issues").alias("issues"), F.count("*").alias("pages"))
