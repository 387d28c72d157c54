"""Text, picture, HTML and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.registry import query
from newsweave.catalog.trends import WSP, clean_sql
from newsweave.catalog.views import sql
from newsweave.functions import classify as C
from newsweave.functions import html as H
from newsweave.functions import images as G
from newsweave.functions import text as X
from newsweave.functions.vocabulary import Vocabulary
from newsweave.operators import trends as T
from newsweave.sources import sample as S
from newsweave.sources.tables import TOPICS

VOCAB = Vocabulary.default()
def ID():
    return F.col("id")



def numbered(prefix: str, suffix: str = ""):
    return F.concat(F.lit(prefix), ID().cast("string"), F.lit(suffix))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- plain text ------------------------------------------------------------------------

STRIP = f"trim(regexp_replace(regexp_replace(regexp_replace({{c}}, '<[^>]+>', '', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '{WSP}+', ' ', 'g'))"


@query(f"select page_id, {STRIP.replace('{c}', 'html')} as text from pages")
def strip_markup(spark, d):
    return S.read_spread(spark, d, "pages").select("page_id", X.strip_markup("html").alias("text"))


@query(f"select page_id, {STRIP.replace('{c}', 'url || html')} as text from pages")
def strip_html(spark, d):
    return S.read_spread(spark, d, "pages").select("page_id", X.strip_markup(F.concat("url", "html")).alias("text"))


@query("select doc_id, replace(replace(text, '\"', ''), '''', '') as text from documents")
def strip_quotes(spark, d):
    return S.read_spread(spark, d, "documents").select("doc_id", X.strip_quotes("text").alias("text"))


EXCERPT = """case when length(s) <= 200 then s when length(regexp_extract(left(s, 200), '(?s)^(.*\\.)', 1)) > 101
 then regexp_extract(left(s, 200), '(?s)^(.*\\.)', 1) else left(s, 200) || '...' end"""


@query(f"select doc_id, {EXCERPT} as excerpt from (select doc_id, {STRIP.replace('{c}', 'text')} as s from documents)")
def excerpt(spark, d):
    return S.read_spread(spark, d, "documents").select("doc_id", X.excerpt(X.strip_markup("text")).alias("excerpt"))


@query(f"select page_id, case when length(s) > 200 then left(s, 200) || '...' else s end as summary from (select page_id, {STRIP.replace('{c}', 'html')} as s from pages)")
def summary_fixed(spark, d):
    return S.read_spread(spark, d, "pages").select("page_id", X.summary_fixed("html").alias("summary"))


@query("select doc_id, case when length(text) > 500 then left(text, 500) || '...' else text end as text from documents")
def truncate_text(spark, d):
    return S.read_spread(spark, d, "documents").select("doc_id", X.truncate_text("text", 500).alias("text"))


NOISY = """select id, topic, source_name, title, case id % 6
 when 0 then 'Article URL: https://a.example.com/' || id || ' Comments URL: https://c.example.com/' || id || chr(10) || 'Points: ' || (id % 500) || ' # Comments: ' || (id % 70) || chr(10) || summary
 when 1 then 'Source: wire, , See also: ' || summary || ' ,'
 when 2 then ', https://x.example.com/' || id || ',' || left(summary, 15)
 when 3 then '<p>' || summary || '</p> Table of contents one two' || chr(10) || chr(10) || 'Body ' || id
 when 4 then '' else '&amp; ' || summary || '...' end as summary from articles"""


def noisy(spark, d):
    """Articles whose summary carries feed boilerplate."""
    from newsweave.operators.articles import scan_articles

    k, s, i = ID() % 6, F.col("summary"), ID().cast("string")
    lit = F.lit
    text = (F.when(k == 0, F.concat(lit("Article URL: https://a.example.com/"), i, lit(" Comments URL: https://c.example.com/"), i, lit("\nPoints: "),
                                    (ID() % 500).cast("string"), lit(" # Comments: "), (ID() % 70).cast("string"), lit("\n"), s))
            .when(k == 1, F.concat(lit("Source: wire, , See also: "), s, lit(" ,")))
            .when(k == 2, F.concat(lit(", https://x.example.com/"), i, lit(","), F.left(s, lit(15))))
            .when(k == 3, F.concat(lit("<p>"), s, lit("</p> Table of contents one two\n\nBody "), i))
            .when(k == 4, lit("")).otherwise(F.concat(lit("&amp; "), s, lit("..."))))
    return scan_articles(S.tables(spark, d, spread=True)).withColumn("summary", text)


@query(sql("articles", f"select id, {clean_sql('summary')} as summary from noisy", noisy=NOISY))
def clean_article_text(spark, d):
    return noisy(spark, d).select("id", X.clean_article_text("summary").alias("summary"))


def flash_sql() -> str:
    s = "regexp_replace(summary, '<[^>]+>', '', 'g')"
    for entity, shown in X._SHOWN:
        s = f"replace({s}, {quoted(entity)}, {quoted(shown)})"
    nws = WSP.replace("[", "[^", 1)
    for p in (f"(?i)Article URL:{WSP}*https?://{nws}+", f"(?i)Comments URL:{WSP}*https?://{nws}+", f"(?i)Points:{WSP}*[0-9]+",
              f"(?i)#{WSP}*Comments:{WSP}*[0-9]+"):
        s = f"regexp_replace({s}, '{p}', '', 'g')"
    for p in ("Table of contents", "Contents"):
        s = rf"regexp_replace({s}, '(?is){p}.*?(\n\n|\n[A-Z]|\z)', '\1', 'g')"
    s = rf"regexp_replace({s}, '{WSP}*\.{WSP}*\z', '')"
    return f"trim(regexp_replace({s}, '{WSP}+', ' ', 'g'))"


@query(sql("articles", """select id, case when length(t) < 10 then 'Read this ' || coalesce(nullif(topic, ''), 'tech') || ' article from ' || source_name || '.' else t end as card
 from (select id, topic, source_name, case when length(s) > 300 then
  case when len(p) > 1 and length(p[1]) < 150 then p[1] || '. ' || p[2] else p[1] end || '...' else s end as t
  from (select *, string_split_regex(s, '[.!?]+') as p from flat))""", noisy=NOISY, flat=f"select id, topic, source_name, {flash_sql()} as s from noisy"))
def flashcard_text(spark, d):
    return noisy(spark, d).select("id", X.flashcard_text("summary", "topic", "source_name").alias("card"))


@query(sql("articles", r"""select id, case when length(f) >= case when b <> '' then 50 else 15 end then trim(f) end as input from
 (select id, b, case when b <> '' then trim(title) || '. ' || b else trim(title) end as f from
  (select id, title, regexp_replace(trim(coalesce(summary, '')), '\.\.\.\z', '') as b from noisy))""", noisy=NOISY))
def summarizer_input(spark, d):
    return noisy(spark, d).select("id", X.summarizer_input("title", "summary").alias("input"))


@query(rf"""select doc_id, position, '*' || p as point from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as position from
 (select doc_id, list_filter(list_transform(string_split_regex(text, '[.\n]'), lambda x: regexp_replace(x, '\A{WSP}+|{WSP}+\z', '', 'g')), lambda x: x <> '') as ps from documents))""")
def key_points(spark, d):
    points = S.read_spread(spark, d, "documents").select("doc_id", F.posexplode(X.key_points("text")).alias("position", "point"))
    return points.withColumn("position", (F.col("position") + 1).cast("long"))


MASK = (rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[EMAIL]', 'g'),"
        rf" '\b\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{4}}\b', '[PHONE]', 'g'), '\b\+\p{{Nd}}{{1,3}}[-.]?\p{{Nd}}{{3,4}}[-.]?\p{{Nd}}{{4,}}\b', '[PHONE]', 'g'),"
        rf" 'https?://{WSP.replace('[', '[^', 1)}+', '[URL]', 'g')")


@query(f"select doc_id, m as masked, left(m, 1000) as request_text from (select doc_id, {MASK} as m from documents)")
def sanitize_pii(spark, d):
    return S.read_spread(spark, d, "documents").select(
        "doc_id", X.sanitize_pii("text", None).alias("masked"), X.sanitize_pii("text").alias("request_text"))


@query("""select event_id, strftime(t, '%Y-%m-%dT%H:%M:%S') || case when microsecond(t) % 1000000 = 0 then '' else strftime(t, '.%f') end as iso
 from (select event_id, case when event_id % 3 = 0 then date_trunc('second', ts) else ts end as t from events)""")
def iso_timestamp(spark, d):
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    return S.read(spark, d, "events").select("event_id", at.alias("at")).select("event_id", X.iso_timestamp("at").alias("iso"))


@query("select event_id, strftime(ts, '%b %-d, %Y') as shown from events")
def display_date(spark, d):
    return S.read(spark, d, "events").select("event_id", X.display_date("ts").alias("shown"))


@query(r"""select distinct doc_id, word, coalesce(len(parts) = 2 and regexp_full_match(parts[1], '[A-Za-z0-9._%+-]+') and len(labels) >= 2
 and regexp_full_match(labels[-1], '[A-Za-z]{2,}') and len(list_filter(labels, lambda l: l = '' or starts_with(l, '-') or ends_with(l, '-') or not regexp_full_match(l, '[A-Za-z0-9-]+'))) = 0, false) as ok
 from (select *, string_split(word, '@') as parts, string_split(string_split(word, '@')[2], '.') as labels from
  (select doc_id, unnest(string_split_regex(text, '[ \t\n\x0b\f\r]+')) as word from documents) where contains(word, '@') or contains(word, '.'))""")
def email_valid(spark, d):
    """Every word of the texts that has an at sign or a full stop."""
    words = S.read_spread(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("word")).where(
        F.contains("word", F.lit("@")) | F.contains("word", F.lit("."))).distinct()
    return words.select("doc_id", "word", X.email_valid("word").alias("ok"))


@query(sql("content", """select id, case id % 4 when 0 then '<p>' || title || '</p>' when 1 then 'second ' || id when 2 then summary else title end as chosen from content"""))
def entry_text_choice(spark, d):
    c, k = S.content(spark, d), ID() % 4
    value = lambda v: F.struct(v.alias("value"))
    none = F.lit(None).cast("string")
    bodies = F.when(k == 0, F.array(value(F.concat(F.lit("<p>"), "title", F.lit("</p>"))), value(F.lit("other")))).when(
        k == 1, F.array(value(F.lit("")), value(none), value(numbered("second ")))).when(k == 2, F.array(value(none)))
    return c.select("id", X.entry_text(bodies, F.when(k == 2, F.col("summary")).otherwise(F.lit("")), F.col("title")).alias("chosen"))


@query(sql("content", """select id, case when id % 3 = 0 then '' else article_url end as link, case when id % 4 = 0 then 'No Title' else title end as title,
 coalesce(published_at, timestamp '2024-01-15 12:00:00') as published_at from content"""))
def entry_defaults(spark, d):
    from newsweave.plans.ingest import entry_defaults as defaults

    none = F.lit(None).cast("string")
    raw = S.content(spark, d).select("id", F.when(ID() % 3 == 0, none).otherwise(F.col("article_url")).alias("link"),
                                     F.when(ID() % 4 == 0, none).otherwise(F.col("title")).alias("title"), "published_at")
    return defaults(raw, S.AS_OF)


@query(sql("content", """select id, '{"id":' || id || ',"topic":' || coalesce('"' || topic || '"', 'null') || ',"published_at":' ||
 coalesce('"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || case when microsecond(published_at) % 1000000 = 0 then '' else strftime(published_at, '.%f') end || '"', 'null')
 || '}' as json from content"""))
def json_sink(spark, d):
    from newsweave.sources.sinks import as_json

    c = S.content(spark, d).select("id", "topic", "published_at")
    return c.select("id", as_json(c).alias("json"))


# -- classifier ------------------------------------------------------------------------

def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def score_sql(words, text="t") -> str:
    return f"len(list_filter({listed(words)}, lambda k: contains({text}, k)))"


def topic_sql(text: str) -> str:
    """Whole-word topic chain. Every word is put between two marks, and so is every word of a
    keyword: a whole-word match is then a plain substring."""
    import re

    word = r"[\p{L}\p{N}_]"
    is_word = lambda ch: ch.isalnum() or ch == "_"
    mark = lambda k: (("" if is_word(k[0]) else "\3") + re.sub(r"\w+", "\2\\g<0>\3", k) + ("" if is_word(k[-1]) else "\2"))
    chain = ""
    for topic, words in VOCAB.topics:
        marked = "[" + ", ".join(quoted(mark(k)).replace("\2", "'||chr(2)||'").replace("\3", "'||chr(3)||'") for k in words) + "]"
        chain += f" when len(list_filter({marked}, lambda k: contains(m, k))) > 0 then {quoted(topic)}"
    wrapped = f"regexp_replace({text}, '({word}+)', chr(2) || '\\1' || chr(3), 'g')"
    return f"(select case{chain} else {quoted(VOCAB.otherwise)} end from (select {wrapped} as m))"


def scored_sql(source: str = "content", key: str = "id") -> str:
    return f"""select id, title, summary, {score_sql(VOCAB.tech)} as tech_score, {score_sql(VOCAB.reject)} as reject_score from
 (select {key} as id, title, summary, lower(title || ' ' || summary) as t from {source})"""


SCORED = scored_sql()
WORDS = "lower(title || ' ' || title || ' ' || summary)"


@query(sql("content", f"select id, tech_score, reject_score from ({SCORED})"))
def keyword_scores(spark, d):
    return C.keyword_scores(S.content(spark, d, spread=True).select("id", "title", "summary"), VOCAB).select("id", "tech_score", "reject_score")


@query(sql("content", f"select id, {topic_sql('lower(title || chr(32) || summary)')} as topic from content"))
def topic_by_keywords(spark, d):
    text = F.lower(F.concat("title", F.lit(" "), "summary"))
    return S.content(spark, d, spread=True).select("id", X.let(text, lambda t: C.topic_by_keywords(t, VOCAB)).alias("topic"))


def classified_sql(model: str | None = None, source: str = "content", key: str = "id") -> str:
    ai = f"left join {model} m using (id)" if model else ""
    has = "m.method is not null" if model else "false"
    pick = (lambda c, otherwise: f"when rule = 'model' then m_{c} {otherwise}") if model else (lambda c, otherwise: otherwise)
    extra = ", m.topic as m_topic, m.method as m_method, m.confidence as m_confidence, m.reason as m_reason" if model else ""
    return f"""select id, tech_score, reject_score, {"case when rule = 'model' then m_method else rule end" if model else 'rule'} as method,
 {"rule not in ('keyword_reject', 'keyword_accept')" if model else 'false'} as ai_used,
 case when rule = 'keyword_reject' then 0.0 when rule = 'keyword_accept' then least(tech_score / 10.0, 0.95)
  when rule = 'keyword_fallback' then least(tech_score / 10.0, 0.7) {pick('confidence', '')} else 0.2 end as confidence,
 case when rule in ('keyword_accept', 'keyword_fallback') then {topic_sql(WORDS)} {pick('topic', '')} end as topic,
 case when rule = 'keyword_reject' then 'Non-tech signals: reject=' || reject_score when rule = 'keyword_accept' then 'Strong tech keywords: ' || tech_score
  when rule = 'keyword_fallback' then 'Tech dominates: ' || tech_score || ' vs ' || reject_score {pick('reason', '')} else 'Insufficient tech evidence' end as reason
 from (select s.*{extra}, case when reject_score >= 2 then 'keyword_reject' when tech_score >= 2 and reject_score = 0 then 'keyword_accept' when {has} then 'model'
  when tech_score >= 3 and tech_score > 2 * reject_score then 'keyword_fallback' else 'keyword_fallback_reject' end as rule from ({scored_sql(source, key)}) s {ai})"""


CLASSIFIED = ["id", "tech_score", "reject_score", "method", "ai_used", "confidence", "topic", "reason"]


def classified(spark, d):
    return C.classify(S.content(spark, d, spread=True).select("id", "title", "summary"), VOCAB)


@query(sql("content", f"select {', '.join(CLASSIFIED)} from ({classified_sql()})"))
def classify_article(spark, d):
    return classified(spark, d).select(*CLASSIFIED)


@query(sql("content", f"""select id, '{{"method":"' || method || '","ai_used":false,"confidence":' || cast(cast(confidence as double) as varchar) || ',"reason":"' || reason || '"}}' as metadata
 from ({classified_sql()})"""))
def classification_metadata(spark, d):
    return classified(spark, d).select("id", F.to_json(C.metadata()).alias("metadata"))


@query(sql("content", f"select method, count(*) as article_count from ({classified_sql()}) group by method"))
def classification_method_mix(spark, d):
    return T.classification_method_mix(classified(spark, d))


@query(sql("content", f"select id, cast(confidence as decimal(4,3)) as ai_confidence_score from ({classified_sql()}) where method like '%fallback%'"))
def borderline_articles(spark, d):
    scored = classified(spark, d).select("id", F.when(F.col("method").contains("fallback"), F.col("confidence")).cast("decimal(4,3)").alias("ai_confidence_score"))
    return T.borderline_articles(scored)


LABELS = [*TOPICS, C.NON_TECH]
MODEL_ROWS = f"""select doc_id as id, {listed(LABELS)}[cast(doc_id % 9 as int) + 1] as l1, (30 + doc_id % 65) / 100.0 as s1,
 {listed(LABELS)}[cast((doc_id + 1) % 9 as int) + 1] as l2, (doc_id % 20) / 100.0 as s2,
 {listed(LABELS)}[cast((doc_id + 2) % 9 as int) + 1] as l3, (doc_id % 7) / 100.0 as s3 from documents"""
DECIDED = f"""select id, method, cast(confidence as double) as confidence, topic, case method
 when 'ai_zero_shot' then 'AI classified with ' || printf('%.2f', confidence) || ' confidence'
 when 'ai_zero_shot_reject' then 'AI rejected as non-tech with ' || printf('%.2f', confidence) || ' confidence'
 when 'ai_zero_shot_redirect' then 'Redirected from non-tech to ' || topic || ' with ' || printf('%.2f', confidence) || ' confidence'
 else 'No tech alternative found' end as reason from
 (select id, case when l1 <> 'non-tech content' then 'ai_zero_shot' when s1 >= 0.60 then 'ai_zero_shot_reject' when greatest(s2, s3) > 0 then 'ai_zero_shot_redirect' else 'ai_uncertain_reject' end as method,
 case when l1 <> 'non-tech content' or s1 >= 0.60 or greatest(s2, s3) = 0 then s1 else greatest(s2, s3) end as confidence,
 case when l1 <> 'non-tech content' then l1 when s1 >= 0.60 or greatest(s2, s3) = 0 then null when s2 >= s3 then l2 else l3 end as topic from model_rows)"""


def model_parts(spark, d):
    k = F.col("doc_id")
    label = lambda shift: F.get(F.array(*[F.lit(x) for x in LABELS]), ((k + shift) % 9).cast("int"))
    return S.read_spread(spark, d, "documents").select(
        k.alias("id"), label(0).alias("l1"), ((k % 65 + 30) / 100.0).alias("s1"), label(1).alias("l2"), ((k % 20) / 100.0).alias("s2"),
        label(2).alias("l3"), ((k % 7) / 100.0).alias("s3"))


def model_scores(spark, d):
    one = lambda n: F.struct(F.col(f"l{n}").alias("label"), F.col(f"s{n}").alias("score"))
    return model_parts(spark, d).select("id", F.array(one(1), one(2), one(3)).alias("scores"))


@query(sql("", DECIDED, model_rows=MODEL_ROWS))
def decide_from_scores(spark, d):
    return model_scores(spark, d).select("id", C.decide_from_scores(F.col("scores")).alias("x")).select("id", "x.method", "x.confidence", "x.topic", "x.reason")


@query(sql("content", f"select {', '.join(CLASSIFIED)} from ({classified_sql('model')})", model_rows=MODEL_ROWS, decided=DECIDED, model="select * from decided where id % 3 <> 0"))
def classify_with_model(spark, d):
    """Two thirds of the articles have model scores; only undecided ones use them."""
    scores = model_scores(spark, d).where("id % 3 <> 0")
    rows = S.content(spark, d, spread=True).select("id", "title", "summary").join(scores, "id", "left")
    return C.classify(rows, VOCAB, scores="scores").select(*CLASSIFIED)


@query(sql("", """select id, case when id % 4 < 2 then n end as n, case when id % 4 < 2 then l1 end as first_label, case when id % 4 < 2 then cast(s1 as double) end as first_score
 from (select *, 3 as n from model_rows)""", model_rows=MODEL_ROWS))
def normalize_model_output(spark, d):
    p = model_parts(spark, d)
    pairs = F.to_json(F.array(*[F.struct(F.col(f"l{n}").alias("label"), F.col(f"s{n}").alias("score")) for n in (1, 2, 3)]))
    lists = F.to_json(F.struct(F.array("l1", "l2", "l3").alias("labels"), F.array("s1", "s2", "s3").alias("scores")))
    k = F.col("id") % 4
    raw = F.when(k == 0, pairs).when(k == 1, lists).when(k == 2, F.lit('{"error": "loading"}')).otherwise(F.lit("not json"))
    out = p.select("id", C.normalize_model_output(raw).alias("o"))
    return out.select("id", F.when(F.col("o").isNotNull(), F.size("o")).alias("n"), F.get("o", F.lit(0))["label"].alias("first_label"), F.get("o", F.lit(0))["score"].alias("first_score"))


def length_scorer(texts):
    """Deterministic stand-in for a model: the label depends on the text length."""
    return [[(LABELS[len(t) % 9], (len(t) % 50 + 50) / 100), ("non-tech content", 0.01)] for t in texts]


REQUEST = MASK.replace("(text,", "(title || '. ' || summary,")


@query(sql("content", f"""select id, {listed(LABELS)}[cast(n % 9 as int) + 1] as label, cast((n % 50 + 50) / 100.0 as double) as score from
 (select id, length(left(left({REQUEST}, 1000), 512)) as n from ({SCORED}) where not (reject_score >= 2 or (tech_score >= 2 and reject_score = 0)))"""))
def score_topics(spark, d):
    rows = C.undecided(C.keyword_scores(S.content(spark, d, spread=True).select("id", "title", "summary"), VOCAB))
    asked = rows.select("id", C.model_text(F.col("title"), F.col("summary")).alias("model_text"))
    best = F.get("scores", F.lit(0))
    return C.score_topics(asked, length_scorer).select("id", best["label"].alias("label"), best["score"].alias("score"))


# -- pictures --------------------------------------------------------------------------

PICTURE = """case when trim(coalesce(u, '')) = '' then false when regexp_matches(lower(u), '{e}') then true when regexp_matches(lower(u), '{h}') then true
 when regexp_matches(lower(u), '{n}') then false else regexp_matches(lower(u), '^https?://') and length(u) > 20 end""".format(
    e=G.any_of(G.EXTENSIONS), h=G.any_of(G.HOSTS_AND_PATHS), n=G.any_of(G.NOT_PICTURES))
ENDINGS = ["/logo.svg", "/wp-content/uploads/a", "/favicon", "/img/x", "/app.js", "/photo.JPG", "/plain", ""]


@query(f"""select page_id, u, {PICTURE} as ok from (select page_id, case when page_id % 16 = 15 then ' ' when page_id % 16 = 14 then null
 else url || {listed(ENDINGS)}[cast(page_id % 8 as int) + 1] end as u from pages)""")
def is_image_url(spark, d):
    k = F.col("page_id")
    end = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (k % 8).cast("int"))
    u = F.when(k % 16 == 15, F.lit(" ")).when(k % 16 != 14, F.concat("url", end))
    return S.read_spread(spark, d, "pages").select("page_id", u.alias("u")).select("page_id", "u", G.is_image_url(F.col("u")).alias("ok"))


def illustrated():
    """Raw article markup with pictures, made around the whole text of an article."""
    i, s = ID().cast("string"), F.col("summary")
    img = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pics = F.array(
        img('<img src="https://cdn.example.com/', i, '.jpg" width="100" height="50"><img width="400" height="300" src="https://cdn.example.com/', i, '-big.jpg">'),
        img('<img src="/x" srcset="https://cdn.example.com/', i, '-s.jpg 320w, https://cdn.example.com/', i, '-l.jpg 1280w">'),
        img("<IMG alt='a > b' data-src='https://cdn.example.com/", i, ".png?a=1&amp;b=2'>"),
        img('<img src="https://a.example.com/logo">'),
        img("no picture"),
        img('<img src="https://cdn.example.com/', i, '…-a.gif" width="90px" height="900"><img src="https://cdn.example.com/', i, '-b.gif">'))
    return F.concat(F.lit("<p>"), s, F.lit("</p>"), F.get(pics, (ID() % 6).cast("int")))


@query(sql("content", """select id, case id % 6 when 0 then 'https://cdn.example.com/' || id || '-big.jpg' when 1 then 'https://cdn.example.com/' || id || '-l.jpg'
 when 2 then 'https://cdn.example.com/' || id || '.png?a=1&b=2' when 5 then 'https://cdn.example.com/' || id || '-a.gif' end as image from content"""))
def image_from_html(spark, d):
    return S.content(spark, d, spread=True).select("id", G.image_from_html(illustrated()).alias("image"))


@query(sql("content", """select id, case when id % 4 = 3 then null when id % 4 = 2 then 'https://cdn.example.com/' || id || '-tw.jpg' else 'https://cdn.example.com/' || id || '-og.jpg' end as image from content"""))
def og_image(spark, d):
    k = ID() % 4
    og = numbered('<meta property="og:image" content="https://cdn.example.com/', '-og.jpg">')
    tw = F.when(k == 2, numbered("<meta content='https://cdn.example.com/", "-tw.jpg' property='twitter:image'>")).otherwise(
        F.lit('<meta property="twitter:image" content="https://a.example.com/logo">'))
    return S.content(spark, d, spread=True).select("id", G.meta_image(F.concat(F.when(k != 3, og).otherwise(F.lit("<meta charset='utf-8'>")), tw, "summary")).alias("image"))


@query(sql("content", """select id, case id % 7 when 0 then 'https://cdn.example.com/m.jpg' when 1 then 'https://cdn.example.com/t.jpg' when 2 then 'https://cdn.example.com/e.jpg'
 when 3 then 'https://cdn.example.com/i.jpg' when 4 then 'https://cdn.example.com/' || id || '-html.jpg' when 5 then 'https://cdn.example.com/' || id || '-og.jpg' end as image from content"""))
def image_precedence(spark, d):
    return S.content(spark, d, spread=True).select("id", G.entry_image(*_media()).alias("image"))


@query(sql("content", """select id, case when id % 7 <= 3 then 'https://cdn.example.com/i.jpg' end as image from content"""))
def entry_image(spark, d):
    """Another order of places: the entry's own image first, then media, then enclosures."""
    return S.content(spark, d, spread=True).select("id", G.entry_image(*_media(), order=("image", "media_content", "enclosures")).alias("image"))


def _media():
    k, bad = ID() % 7, F.lit("https://a.example.com/logo")
    one = lambda field, url, least: F.when(k <= least, F.array(
        F.struct(bad.alias(field)), F.struct(F.lit(url).alias(field)))).otherwise(F.array(F.struct(bad.alias(field))))
    none = F.lit(None).cast("array<struct<value:string>>")
    html = F.when(k == 4, numbered('<img src="https://cdn.example.com/', '-html.jpg">')).when(
        k == 5, numbered('<meta property="og:image" content="https://cdn.example.com/', '-og.jpg">')).otherwise(F.col("summary"))
    image = F.struct(F.when(k <= 3, F.lit("https://cdn.example.com/i.jpg")).alias("href"))
    return (one("url", "https://cdn.example.com/m.jpg", 0), one("url", "https://cdn.example.com/t.jpg", 1),
            one("href", "https://cdn.example.com/e.jpg", 2), image, none, html)


# -- HTML ------------------------------------------------------------------------------

TEXT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g'), '<[^>]+>', chr(1), 'g')"""


@query(f"""select page_id, array_to_string(list_filter(list_transform(string_split({TEXT_SQL}, chr(1)), lambda x: regexp_replace(html_unescape_few(x), '\\A{WSP}+|{WSP}+\\z', '', 'g')), lambda x: x <> ''), ' ') as text
 from pages""".replace("html_unescape_few(x)", "regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '&amp$', '&')"))
def html_to_text(spark, d):
    return S.read_spread(spark, d, "pages").select("page_id", H.html_to_text("html").alias("text"))


# What is left of a page: its text, escaped, and its allowed tags. The script body of the pages holds a
# quoted end tag, which is text there.
COMPLETE = r"""replace(replace(regexp_replace(html, '&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)', chr(2) || '\1', 'g'), '&', '&amp;'), chr(2), '&')"""
LEFT = r"""regexp_replace(regexp_replace(replace(COMPLETE, '"</p>"', '"&lt;/p&gt;"'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')""".replace("COMPLETE", COMPLETE)


def left_of(html):
    count = lambda pattern: F.size(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).cast("long")
    return [F.regexp_replace(html, "<[^>]+>", "").alias("text"), count("<a href=\"").alias("links"), count("<p>").alias("paragraphs"),
            count("(?i)<(?:script|style|nav|article|html)|onclick=").alias("refused")]


@query(f"""select page_id, {LEFT} as text, len(regexp_extract_all(html, '<a href="')) as links,
 len(regexp_extract_all(html, '<p>')) as paragraphs, 0 as refused from pages""")
def sanitize_html(spark, d):
    return (S.read_spread(spark, d, "pages").select("page_id", H.sanitize_html("html").alias("html"))
            .select("page_id", *left_of(F.col("html"))))


@query(f"""select page_id, {LEFT} as text, 0 as links, len(regexp_extract_all(html, '<p>')) as paragraphs, 0 as refused from pages""")
def sanitize_user_html(spark, d):
    return (S.read_spread(spark, d, "pages").select("page_id", H.sanitize_user_html("html").alias("html"))
            .select("page_id", *left_of(F.col("html"))))


KEPT = "(?i)</?(" + "|".join(H.ARTICLE_TAGS) + ")(\\s[^>]*)?/?>"
MARKED = f"""regexp_replace(regexp_replace(regexp_replace(replace({COMPLETE}, '"</p>"', '"&lt;/p&gt;"'), '(?s)<!--.*?-->', '', 'g'), '{KEPT}', chr(1), 'g'), '<[^>]+>', '', 'g')"""
SHOWN = "replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"


@query(f"""select page_id, case when length(s) > 200 then left(s, 200) || '...' else s end as summary from (select page_id, array_to_string(list_filter(
 list_transform(string_split({MARKED}, chr(1)), lambda x: regexp_replace({SHOWN}, '\\A{WSP}+|{WSP}+\\z', '', 'g')), lambda x: x <> ''), ' ') as s from pages)""")
def html_summary(spark, d):
    return S.read_spread(spark, d, "pages").select("page_id", H.html_summary("html").alias("summary"))
