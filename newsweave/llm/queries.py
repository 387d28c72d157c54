"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import align, archives, attribution, classifier, decontaminate, lmscore, pagetext, pieces, quality, ranked, simhash, toxicity, urlrules
from newsweave.llm.common import crc32_mod, table
from newsweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an ARC archive, converted to WARC archives, which are read back."""
    def page(uri: str):
        return archives.key_of(F.col(uri)).try_cast("long")
    records = archives.arc_table(archives.to_arc(table(spark, sf_dir, "pages"), "url", "html", key="page_id"))
    path = scratch_path(spark, "warc")
    archives.write_warc(archives.with_revisits(records, page("target_uri")), path)
    return archives.warc_table(archives.read_archives(spark, path)).select(
        page("target_uri").alias("page_id"), "payload_bytes", "payload_digest",
        F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"), page("refers_to_uri").alias("refers_to"))


ORACLE["op1_archives"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
     f as (select body, max(page_id) as first_id from p group by body)
select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest,
       case when strlen(body) >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when strlen(body) >= 1000 and page_id <> first_id then first_id end as refers_to
from p join f using (body)"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The rules of the query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op3_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE["op3_urlrules"] = """
with r(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
     u as (select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
     m as (select page_id, host, path, rhost || rpath as rule, rverdict,
                  row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc nulls last, length(rhost) desc) as n
           from u left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from m where n = 1"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of rules and perplexity bands for every document; a fifth of the labels is left to measure with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, labels=table(spark, sf_dir, "labels"), held_out=True).drop("text", "lang")


@query
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, the whole text encoded once; a token over a line's end goes to the line with most of it."""
    return attribution.section_tokens(table(spark, sf_dir, "documents"), attribution.default_encoder())


@query
def op7_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pagetext.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), pagetext.train()).drop("html")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a document where a benchmark item stands, with its span and number of edits."""
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the backoff automaton, learnt from nine tenths of them, and the base score."""
    return lmscore.score(table(spark, sf_dir, "documents"))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    return pieces.digests(table(spark, sf_dir, "documents"), pieces.default_model())


@query
def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled ones outside the held-out third."""
    def held_out(key: str):
        return crc32_mod(F.col(key), 3) == 1
    found = classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out("_key"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item, by integer term weights."""
    return ranked.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE["op12_ranked"] = r"""
with words as (select n, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
               from (select row_number() over () as n, doc_id, text from documents)),
     counted as (select n, doc_id, term, count(*) as tf from words group by n, doc_id, term),
     sizes as (select n, sum(tf)::bigint as size from counted group by n),
     whole as (select count(*) as docs, sum(size)::bigint as total from sizes),
     weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
                 from (select term, count(*) as df from counted group by term), whole),
     asked as (select distinct i, item_id, term from (
                 select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
                 from (select row_number() over () as i, item_id, text from benchmark))),
     scores as (select i, item_id, n, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * docs) // total))))::bigint as score
                from asked join weights using (term) join counted using (term) join sizes using (n), whole group by i, item_id, n, doc_id)
select item_id, rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id)::int as rank from scores where score > 0)
where rank <= 50"""


@query
def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' encodings of every whole text, with the documents that hold a linked pair."""
    return align.aligned(table(spark, sf_dir, "documents"), align.default_tokenizers())
