"""Page audit and feed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.registry import query
from newsweave.operators import audit as Q
from newsweave.plans.ingest import entry_defaults
from newsweave.sources import feeds
from newsweave.sources import sample as S

EXTRA = [
    '<h4>x</h4><img src="a.png"><img src="b.png" alt="b"><a href="/x">click <b>here</b></a><a href="/m"> More </a>',
    '<input type="text" id="a"><label for="b">l</label><input type="hidden"><input id="b"><button></button><button title="t"></button>',
    '<table><tr><td>1</td></tr></table><a href="/y"> <b></b> </a><a href="/z" aria-label="z"></a><a name="n"></a>',
    "<h2>y</h2><h4>z</h4><h6>w</h6><table><tr><th>1</th></tr></table><textarea></textarea>",
]


def audited(spark, d):
    """Pages with one of four fragments appended, so that every rule is broken somewhere."""
    extra = F.get(F.array(*[F.lit(e) for e in EXTRA]), (F.col("page_id") % 4).cast("int"))
    p = S.read_spread(spark, d, "pages")
    head = F.when(F.col("page_id") % 6 == 0, F.regexp_replace("html", ' lang="[a-z]+"', "")).otherwise(F.col("html"))
    head = F.when(F.col("page_id") % 7 == 0, F.regexp_replace(head, '<meta charset="utf-8">', '<meta name="viewport" content="w">')).otherwise(head)
    return p.select("page_id", F.concat(head, extra).alias("html"))


FULL = f"""case when page_id % 7 = 0 then replace(lang, '<meta charset="utf-8">', '<meta name="viewport" content="w">') else lang end || {EXTRA!r}[page_id % 4 + 1]"""
#: Stripped text nodes of an element, joined without a space.
NODES = r"array_to_string(list_transform(string_split(regexp_replace(e, '(?s)<[^>]+>', chr(1), 'g'), chr(1)), lambda n: regexp_replace(n, '^\s+|\s+$', '', 'g')), '')"
BLANK = rf"{NODES} = '' and not regexp_matches(regexp_extract(e, '(?s)^<[^>]*>'), '\s(aria-label|title)=')"
LINKS = r"regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=[^>]*>.*?</a\s*>')"
AUDIT = rf"""select page_id, rule, issues from (
 select page_id, unnest([
  {{'rule': 'no_semantic_element', 'issues': cast(not regexp_matches(h, '<(main|header|footer|nav|section|article|aside)[\s>]') as bigint)}},
  {{'rule': 'first_heading_not_h1', 'issues': cast(len(lv) > 0 and lv[1] <> '1' as bigint)}},
  {{'rule': 'heading_level_skipped', 'issues': len(list_filter(range(2, len(lv) + 1), lambda i: cast(lv[i] as int) > cast(lv[i - 1] as int) + 1)) + 0}},
  {{'rule': 'image_without_alt', 'issues': len(list_filter(regexp_extract_all(h, '(?i)<img[\s/][^>]*>'), lambda t: not regexp_matches(t, '(?i)\salt='))) + 0}},
  {{'rule': 'input_without_label', 'issues': len(list_filter(regexp_extract_all(h, '(?i)<(?:input|textarea|select)[^>]*>'), lambda t: regexp_extract(t, 'type="([^"]*)"', 1) not in ('hidden', 'submit', 'button')
    and not list_contains(regexp_extract_all(h, '(?i)<label[^>]*\sfor="([^"]*)"', 1), regexp_extract(t, '\sid="([^"]*)"', 1)) and not contains(t, 'aria-label'))) + 0}},
  {{'rule': 'button_without_text', 'issues': len(list_filter(regexp_extract_all(h, '(?is)<button[^>]*>.*?</button>'), lambda e: {BLANK})) + 0}},
  {{'rule': 'link_without_text', 'issues': len(list_filter({LINKS}, lambda e: {BLANK})) + 0}},
  {{'rule': 'vague_link_text', 'issues': len(list_filter({LINKS}, lambda e: lower({NODES}) in ('click here', 'read more', 'here', 'more', 'link'))) + 0}},
  {{'rule': 'html_without_lang', 'issues': cast(regexp_matches(h, '(?i)<html[^>]*>') and not regexp_matches(regexp_extract(h, '(?i)<html[^>]*>'), '\slang=') as bigint)}},
  {{'rule': 'no_viewport', 'issues': cast(not regexp_matches(h, '(?i)<meta[^>]*name="viewport"') as bigint)}},
  {{'rule': 'table_without_header', 'issues': len(list_filter(regexp_extract_all(h, '(?is)<table[^>]*>.*?</table>'), lambda e: not regexp_matches(e, '(?i)<th[\s>]'))) + 0}}], recursive := true)
 from (select *, regexp_extract_all(h, '<h([1-6])[\s>]', 1) as lv from (
  select page_id, regexp_replace({FULL}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') as h from (
   select page_id, case when page_id % 6 = 0 then regexp_replace(html, ' lang="[a-z]+"', '', 'g') else html end as lang from pages)))) where issues > 0"""


@query(AUDIT)
def page_audit(spark, d):
    return Q.page_audit(audited(spark, d))


@query(f"select rule, cast(sum(issues) as bigint) as issues, count(*) as pages from ({AUDIT}) group by rule")
def audit_summary(spark, d):
    return Q.audit_summary(Q.page_audit(audited(spark, d)))


def feed_documents(spark, d):
    """RSS for even sources, Atom for odd ones; at most ten entries a document."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[^\P{Cc}\n\t]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lit, k = F.lit, F.col("doc_id").cast("string")
    rss = F.concat(lit("<item><title>Title "), k, lit("</title><link>https://news.example.com/a/"), k,
                   lit("</link><description>"), safe(F.col("text")), lit("</description><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate>"),
                   lit('<media:content url="https://cdn.example.com/'), k, lit('.jpg"/></item>'))
    atom = F.concat(lit("<entry><title>Title "), k, lit('</title><link rel="self" href="x"/><link href="https://news.example.com/a/'), k,
                    lit('"/><summary>'), safe(F.col("text")), lit("</summary><updated>2024-01-15T10:00:00Z</updated></entry>"))
    number = S.source_number(F.col("source"))
    entry = F.when(number % 2 == 0, rss).otherwise(atom)
    docs = (S.read_spread(spark, d, "documents").select("source", "doc_id", entry.alias("entry"))
            .groupBy("source", F.floor(F.col("doc_id") / 200).alias("part"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "entry"))), lambda e: e["entry"]), "").alias("body")))
    n = S.source_number(F.col("source"))
    xml = F.when(n % 2 == 0, F.concat(lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>t</title>'), "body", lit("</channel></rss>"))).otherwise(
        F.concat(lit("<feed><title>t</title>"), "body", lit("</feed>")))
    return docs.select(n.alias("source_id"), "part", xml.alias("xml"))


@query("""select cast(substr(source, 4) as int) as source_id, row_number() over (partition by source, doc_id // 200 order by doc_id) - 1 as pos,
 'https://news.example.com/a/' || doc_id as link, 'Title ' || doc_id as title, length(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) as n_text,
 timestamp '2024-01-15 10:00:00' as published_at, case when cast(substr(source, 4) as int) % 2 = 0 then 'https://cdn.example.com/' || doc_id || '.jpg' end as media from documents""")
def parse_feed_xml(spark, d):
    return parsed_columns(entry_defaults(feeds.parse_feed_xml(feed_documents(spark, d)), S.AS_OF))


def parsed_columns(entries):
    return entries.select("source_id", F.col("pos").cast("long").alias("pos"), "link", "title",
                          F.length(F.regexp_replace("summary", r"[ \t\n\r]+", "")).cast("long").alias("n_text"), "published_at",
                          F.get("media_content", F.lit(0))["url"].alias("media"))
