import re

from pyspark.sql import functions as F

from newsweave.functions import classify as C
from newsweave.functions.vocabulary import Vocabulary
from newsweave.sources import sample as S

V = Vocabulary.default()

CASES = [
    # title, summary, method, topic
    ("Advanced machine learning", "Deep learning and neural networks", "keyword_accept", "AI & ML"),
    ("New ransomware found", "Security teams patch the encryption bug", "keyword_accept", "Cybersecurity & Privacy"),
    ("Docker and Kubernetes", "Deployment of container services", "keyword_accept", "Cloud Computing & DevOps"),
    ("Netflix lifetime subscription", "Limited time offer, buy now", "keyword_reject", None),
    ("Minister on housing policy", "Public housing and income ceiling", "keyword_reject", None),
    ("Companies ship a Python SDK for cloud apps", "Machine learning on the web", "keyword_fallback", "Cloud Computing & DevOps"),
    ("A walk in the hills", "Sunny and calm", "keyword_fallback_reject", None),
]


def classified(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "id int, title string, summary string")
    return C.classify(df, V, **kw).orderBy("id").collect()


def test_decision_table(spark):
    for case, row in zip(CASES, classified(spark, CASES)):
        assert (row.method, row.topic) == case[2:], (case, row)
        assert not row.ai_used


# Texts with their known scores and verdict.
GOLDEN = [
    ("New Python AI Features for Machine Learning and Cloud Computing",
     "Python 3.12 introduces groundbreaking features for artificial intelligence, machine learning, kubernetes deployment, and docker containerization.",
     10, 1, "keyword_fallback", 0.7, "Cloud Computing & DevOps"),
    ("Get Lifetime Netflix Subscription for $99",
     "Limited time offer! Lifetime subscription to Netflix and Hulu for only $99 (reg. $299). Don't miss out on this exclusive deal!",
     0, 6, "keyword_reject", 0.0, None),
    ("New Developer Hiring Policy Announced",
     "Companies are adopting new policies for hiring software developers remotely. The policy focuses on skills rather than location.",
     3, 2, "keyword_reject", 0.0, None),
    ("Python Code Review Best Practices",
     "Learn how to conduct effective code reviews in your team. This guide covers communication, feedback, and collaboration strategies.",
     3, 0, "keyword_accept", 0.3, "Software Development & Web Technologies"),
    ("Housing Policy Review by Minister",
     "The National Development Minister announced a review of public housing policies, including income ceilings and eligibility criteria.",
     1, 9, "keyword_reject", 0.0, None),
    ("Tech Worker Salaries in Real Estate Market",
     "How software engineer salaries are affecting the real estate and housing market. Property prices rise as tech companies expand.",
     3, 5, "keyword_reject", 0.0, None),
    ("Advanced Machine Learning Algorithms", "Deep learning and neural networks in artificial intelligence", 7, 0, "keyword_accept", 0.7, "AI & ML"),
    ("New Ransomware Attack Methods", "Security researchers discover new encryption vulnerabilities", 2, 0, "keyword_accept", 0.2, "Cybersecurity & Privacy"),
    ("Docker Container Orchestration", "Kubernetes deployment strategies for microservices architecture", 4, 0, "keyword_accept", 0.4, "Cloud Computing & DevOps"),
    ("Best Wedding Photography Tips", "Learn how to capture beautiful wedding moments", 1, 1, "keyword_fallback_reject", 0.2, None),
    ("Get lifetime access to documentaries for $200", "Limited time offer for premium streaming service", 1, 3, "keyword_reject", 0.0, None),
    ("BTO income ceilings eligibility age for singles under review", "Minister announces housing policy changes", 0, 5, "keyword_reject", 0.0, None),
]


def test_golden_results(spark):
    got = [(r.tech_score, r.reject_score, r.method, r.confidence, r.topic) for r in classified(spark, GOLDEN)]
    assert got == [g[2:] for g in GOLDEN]


def test_repeated_entries_count_twice(spark):
    row = classified(spark, [("senator", "")])[0]
    assert (row.reject_score, row.method) == (2, "keyword_reject")


def test_confidence_caps(spark):
    rows = classified(spark, [("python software api github linux cloud docker kubernetes aws azure gcp devops", ""),
                              ("implement python software api github linux cloud docker", "")])
    assert rows[0].confidence == 0.95 and rows[0].method == "keyword_accept"
    assert rows[1].confidence == 0.7 and rows[1].method == "keyword_fallback"


def test_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit("").alias("title"), F.col("text").alias("summary"))
    texts = {r.doc_id: " " + r.summary for r in docs.collect()}
    for row in C.keyword_scores(docs, V).select("doc_id", "tech_score", "reject_score").collect():
        text = texts[row.doc_id].lower()
        assert row.tech_score == len([k for k in V.tech if k in text])
        assert row.reject_score == len([k for k in V.reject if k in text])


def test_topic_boundaries(spark, one):
    text = ["use c++ now", "c++11 now", "the .net way", "asp.net way", "éai", "ai", "x_ai", "ci/cd", "open source code", "cloudy", "cloud native", "c#7", "plain"]
    expected = []
    for t in text:
        found = [topic for topic, words in V.topics if any(re.search(r"\b" + re.escape(k) + r"\b", t) for k in words)]
        expected.append(found[0] if found else V.otherwise)
    assert one(C.topic_by_keywords(F.col("t"), V), t=text) == expected


def test_longest_of_finds_every_keyword(one):
    words = ["a", "ab", "abc", "bcd", "c d", "+x"]
    got = one(C.hits(C.found_strings(F.col("t"), words), words), t=["abcd", "zabz", "c d+x", "", "bc"])
    assert got == [4, 2, 2, 0, 0]


def test_keywords_are_found_without_the_engine_of_columns(spark):
    """no search of the whole lists by a column function; null, empty and wide texts are scored as before."""
    df = spark.createDataFrame([(0, None, "a"), (1, "", ""), (2, "Éa 😀", "Pythonşpython senator"), (3, "x", None)], "id int, title string, summary string")
    scored = C.keyword_scores(df, V)
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in scored.orderBy("id").select("tech_score", "reject_score").collect()] == [(0, 0), (0, 0), (1, 2), (0, 0)]


def test_model_is_used_only_when_undecided(spark):
    rows = spark.createDataFrame(
        [(0, "Docker and Kubernetes", "cloud", [("Open Source", 0.9)]), (1, "A walk", "calm", [("Open Source", 0.9)]),
         (2, "A walk", "calm", [("non-tech content", 0.5), ("AI & ML", 0.3)]), (3, "A walk", "calm", None)],
        "id int, title string, summary string, scores array<struct<label:string,score:double>>")
    got = C.classify(rows, V, scores="scores").orderBy("id").select("method", "topic", "ai_used").collect()
    assert [tuple(r) for r in got] == [
        ("keyword_accept", "Cloud Computing & DevOps", False), ("ai_zero_shot", "Open Source", True),
        ("ai_zero_shot_redirect", "AI & ML", True), ("keyword_fallback_reject", None, True)]


def test_vocabulary_from_table(spark):
    table = spark.createDataFrame([("reject", 1, "bbb"), ("reject", 0, "aaa"), ("AI & ML", 0, "qq")], "list string, position int, keyword string")
    v = Vocabulary.from_table(table)
    assert v.reject == ("aaa", "bbb") and v.tech == V.tech
    assert dict(v.topics)["AI & ML"] == ("qq",)


def test_normalize_model_output(one):
    raw = ['[{"label": "a", "score": 0.5}]', '{"labels": ["a", "b"], "scores": [0.5, 0.1]}', '{"error": "x"}', "oops", None]
    got = one(F.to_json(C.normalize_model_output(F.col("raw"))), raw=raw)
    assert got == ['[{"label":"a","score":0.5}]', '[{"label":"a","score":0.5},{"label":"b","score":0.1}]', None, None, None]


def test_whole_lists():
    assert [len(V.tech), len(V.reject), len(set(V.reject))] == [109, 504, 499]


def test_method_mix_of_fixtures(spark):
    # The counts of FIXTURES.md on documents at sf0.01 (title = first sentence, summary = text).
    docs = S.content(spark, "/root/testdata/sf0.01").select("id", "title", "summary")
    got = {tuple(r) for r in C.classify(docs, V).groupBy("method", "topic").count().collect()}
    mix = {}
    for method, _, n in got:
        mix[method] = mix.get(method, 0) + n
    assert mix == {"keyword_accept": 323, "keyword_fallback": 119, "keyword_fallback_reject": 395, "keyword_reject": 163}
    assert {("keyword_accept", "AI & ML", 69), ("keyword_fallback", "Open Source", 7)} <= {(m, t and t.replace(" & Linux", ""), n) for m, t, n in got}
