"""URL queries: real page URLs, and forms derived from them row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.registry import query
from newsweave.functions import urls as U
from newsweave.sources import sample as S

PARTS = r"""regexp_extract(url, '^([a-z]+)://([^/?#:]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {n})"""


def pages(spark, d):
    return S.read(spark, d, "pages").select("page_id", "url")


def pick(forms, key="page_id"):
    """One of ``forms`` by row."""
    return F.get(F.array(*forms), (F.col(key) % len(forms)).cast("int"))


def case(forms: list[str], key="page_id") -> str:
    return f"case {key} % {len(forms)} " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


def around(prefix: str, suffix: str):
    return F.concat(F.lit(prefix), F.col("page_id").cast("string"), F.lit(suffix))


@query(f"""select page_id, {PARTS.format(n=1)} as scheme, {PARTS.format(n=2)} as domain, case when page_id % 2 = 0 then 8080 end as port,
 {PARTS.format(n=3)} as path, {PARTS.format(n=4)} as query, {PARTS.format(n=5)} as fragment from pages""")
def url_parts(spark, d):
    """Page URLs, every second one with a port."""
    with_port = F.regexp_replace("url", "^([a-z]+://[^/?#]+)", "$1:8080")
    u = F.when(F.col("page_id") % 2 == 0, with_port).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", U.url_parts(u).alias("p")).select("page_id", "p.*")


@query(f"select page_id, case when page_id % 5 <> 0 then {PARTS.format(n=2)} end as domain from pages")
def url_domain(spark, d):
    u = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", U.url_domain(u).alias("domain"))


NORMAL = [("HTTPS://H", ".EXAMPLE.com"), ("https://h", ".example.com:443/"), ("http://h", ".example.com:80"), ("https://h", ".example.com/Path/../Other"),
          ("https://h", ".example.com//double/slash/"), ("https://h", ".example.com/path?"), ("https://h", ".example.com/a/./b/../../c?x=1#y"), ("not a url ", "")]
NORMAL_OUT = ["'https://h' || page_id || '.example.com'", "'https://h' || page_id || '.example.com/'", "'http://h' || page_id || '.example.com'",
              "'https://h' || page_id || '.example.com/Other'", "'https://h' || page_id || '.example.com/double/slash/'", "'https://h' || page_id || '.example.com/path'",
              "'https://h' || page_id || '.example.com/c?x=1#y'", "null"]


@query(f"""select page_id, {case(NORMAL_OUT)} as made, regexp_replace(url, '\\?$|#$', '') as own from pages""")
def url_normalize(spark, d):
    made = pick([around(a, b) for a, b in NORMAL])
    return pages(spark, d).select("page_id", U.url_normalize(made).alias("made"), U.url_normalize(F.col("url")).alias("own"))


VALID = [("https://h", ".example.com"), ("https://h", ".example.com:8080/p?q=v#f"), ("ftp://h", ".example.com/file.txt"), ("https://[::1]/", ""),
         ("h", ".example.com/path"), ("http://", " .example.com"), ("javascript:alert(", ")"), ("http://..", ""), ("http://h", ".bar?q=Spaces should be encoded"), ("/path/", "")]


@query("""select page_id, true as own, page_id % 10 < 4 as valid, page_id % 10 in (0, 1, 3, 5, 7, 8) as http, page_id % 10 in (4, 9) as relative from pages""")
def url_valid(spark, d):
    u = pick([around(a, b) for a, b in VALID])
    return pages(spark, d).select("page_id", U.url_valid(F.col("url")).alias("own"), U.url_valid(u).alias("valid"), U.url_http(u).alias("http"), U.url_relative(u).alias("relative"))


@query("select page_id, regexp_matches(url, '^https?://') as http from pages")
def url_http(spark, d):
    return pages(spark, d).select("page_id", U.url_http(F.col("url")).alias("http"))


@query("select page_id, page_id % 2 = 0 as relative from pages")
def url_relative(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^[a-z]+://[^/]+", "")).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", U.url_relative(u).alias("relative"))


#: First parts of the addresses below, so that reserved ranges and their neighbours occur.
FIRST = [10, 127, 169, 172, 192, 0, 8, 11]


@query(f"""select page_id, host, not (a = 10 or a = 127 or a = 169 and b = 254 or a = 172 and b between 16 and 31 or a = 192 and b = 168 or a = 0 and b = 0 and c = 0 and d = 0) as safe,
 regexp_extract(url, '://([^/?#:]+)', 1) <> 'localhost' as own_safe
 from (select page_id, url, a, b, c, d, a || '.' || b || '.' || c || '.' || d as host from
  (select page_id, url, {FIRST}[x[1] % 8 + 1] as a, case when x[2] < 96 then [254, 168, 16, 31, 15, 32, 0, 0][x[2] % 8 + 1] else x[2] end as b, case when x[2] < 96 then x[3] % 2 else x[3] end as c, x[4] % 2 as d from
   (select page_id, url, list_transform([1, 3, 5, 7], lambda i: cast('0x' || substr(md5(html), i, 2) as int)) as x from pages)))""")
def url_safe_host(spark, d):
    """Addresses made from the digests of the pages, and the pages' own hosts."""
    x = [F.conv(F.substring(F.md5("html"), i, 2), 16, 10).cast("int") for i in (1, 3, 5, 7)]
    second = F.get(F.array(*[F.lit(v) for v in (254, 168, 16, 31, 15, 32, 0, 0)]), x[1] % 8)
    parts = [F.get(F.array(*[F.lit(v) for v in FIRST]), x[0] % 8), F.when(x[1] < 96, second).otherwise(x[1]), F.when(x[1] < 96, x[2] % 2).otherwise(x[2]), x[3] % 2]
    host = F.concat_ws(".", *[p.cast("string") for p in parts])
    return S.read(spark, d, "pages").select("page_id", host.alias("host"), U.url_safe_host(host).alias("safe"), U.url_safe_host(U.url_domain(F.col("url"))).alias("own_safe"))


FEEDS = [("https://h", ".example.com/feed.xml"), ("ftp://h", ".example.com/feed"), ("https://192.168.1.", "/feed"), ("http://localhost/", ""), ("not-a-url", "")]


@query("select page_id, page_id % 5 = 0 as made, true as own from pages")
def feed_url_valid(spark, d):
    return pages(spark, d).select("page_id", U.feed_url_valid(pick([around(a, b) for a, b in FEEDS])).alias("made"), U.feed_url_valid(F.col("url")).alias("own"))


@query("select doc_id, length('https://h.example.com/' || text) <= 2048 and doc_id % 9 <> 0 as ok from documents")
def url_length_ok(spark, d):
    u = F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("https://h.example.com/"), "text")).otherwise(F.lit(""))
    return S.read(spark, d, "documents").select("doc_id", U.url_length_ok(u).alias("ok"))


@query("select doc_id, case when doc_id % 4 = 0 then 'a%20b' || doc_id else url_encode(text) end as encoded from documents")
def url_encode(spark, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a%20b"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return S.read(spark, d, "documents").select("doc_id", U.url_encode(t).alias("encoded"))


@query("select doc_id, text as decoded from documents")
def url_decode(spark, d):
    """Encoding then decoding a whole text gives the text back."""
    return S.read(spark, d, "documents").select("doc_id", U.url_decode(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))).alias("decoded"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, ' ', '%20'), '"', '%22'), '''', '%27'), '<', '%3C'), '>', '%3E') as clean from documents""")
def url_sanitize(spark, d):
    return S.read(spark, d, "documents").select("doc_id", U.url_sanitize(F.col("text")).alias("clean"))


REFS = ["/path", "path", "../other", "./relative", "?q=1", "#top", "https://else.example.com/x", "//cdn.example.com/y"]
JOINED = ["'https://h' || page_id || '.example.com/path'", "'https://h' || page_id || '.example.com/a/b/path'", "'https://h' || page_id || '.example.com/a/other'",
          "'https://h' || page_id || '.example.com/a/b/relative'", "'https://h' || page_id || '.example.com/a/b/c?q=1'",
          "'https://h' || page_id || '.example.com/a/b/c#top'", "'https://else.example.com/x'", "'https://cdn.example.com/y'"]


@query(f"""select page_id, {case(JOINED)} as joined, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || '/feed' as feed from pages""")
def url_join(spark, d):
    return pages(spark, d).select("page_id", U.url_join(around("https://h", ".example.com/a/b/c"), pick([F.lit(r) for r in REFS])).alias("joined"),
                                  U.url_join(F.col("url"), F.lit("/feed")).alias("feed"))


HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query(f"""select page_id, url from pages where {HOST} like '%.example.org' or exists (select 1 from (select distinct {HOST} as host from pages where page_id % 10 = 0) b
 where b.host = {HOST} or {HOST} like '%.' || b.host)""")
def host_blocklist(spark, d):
    """Pages on a host of every tenth page, or anywhere under one domain."""
    p = pages(spark, d)
    listed = p.where("page_id % 10 = 0").select(U.url_domain(F.col("url")).alias("host")).unionByName(
        p.select(F.lit("example.org").alias("host")).distinct())
    return U.blocked_hosts(p, listed).select("page_id", "url")
