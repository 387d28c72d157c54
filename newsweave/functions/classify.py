"""Topic classification: keyword rules first, a model only for undecided rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.text import WORD, computed_once, let, sanitize_pii
from newsweave.functions.vocabulary import Vocabulary
from newsweave.schemas import CLASSIFICATION, SCORES

NON_TECH = "non-tech content"
ACCEPT_AT = 0.60


def _quoted(keyword: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _-/" else "\\" + ch for ch in keyword)


def longest_of(keywords: Iterable[str]) -> str:
    """Regex that matches the longest keyword at a position. Shared beginnings are factored out,
    so a position costs a few comparisons however long the list is."""
    tree: dict = {}
    for k in keywords:
        node = tree
        for ch in k:
            node = node.setdefault(ch, {})
        node[""] = {}

    def regex(node):
        ways = [_quoted(ch) + regex(below) for ch, below in node.items() if ch]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return regex(tree)


def found_strings(text: Column, keywords: Iterable[str]) -> Column:
    """Distinct strings found by looking for the longest keyword at **every** position of ``text``.
    Any keyword that occurs in the text is the beginning of one of them. Python's ``re`` passes over the positions
    where no keyword starts several times faster than the engine of the column functions."""
    pattern = f"(?=({longest_of(keywords)}))"

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        find = re.compile(pattern).findall
        return pd.Series([None if t is None else list(dict.fromkeys(find(t))) for t in texts], dtype=object)

    return found(text)


def hits(found: Column, keywords: Iterable[str]) -> Column:
    """How many list entries occur, as plain substrings, in the text that ``found`` comes from. One
    higher-order call over a literal array: the plan does not grow with the list."""
    return let(found, lambda finds: F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.exists(finds, lambda f: f.startswith(k)))))


def _by_edges(keywords: Iterable[str]) -> dict[tuple[bool, bool], list[str]]:
    """Keywords by whether they start and end with a word character."""
    is_word = lambda ch: ch.isalnum() or ch == "_"
    shapes: dict[tuple[bool, bool], list[str]] = {}
    for k in keywords:
        shapes.setdefault((is_word(k[0]), is_word(k[-1])), []).append(k)
    return shapes


def whole_word_pattern(keywords: Iterable[str]) -> str:
    """One alternation that finds any keyword between word boundaries. A boundary beside a
    keyword that starts or ends in punctuation asks for a word character there."""
    parts = []
    for (start, end), group in _by_edges(keywords).items():
        before = f"(?<!{WORD})" if start else f"(?<={WORD})"
        after = f"(?!{WORD})" if end else f"(?={WORD})"
        parts.append(f"{before}{longest_of(group)}{after}")
    return "|".join(parts)


def _word_finds(text: Column, keywords: Iterable[str]) -> Column:
    """The keywords found as whole words, each with the neighbour word its boundary asks for, as a
    short text. It holds exactly the whole-word matches of ``text``."""
    parts = []
    for (start, end), group in _by_edges(keywords).items():
        before, after = ("" if start else f"{WORD}+"), (f"(?!{WORD})" if end else f"{WORD}+")
        parts.append(f"{before}{longest_of(group)}{after}")
    pattern = f"(?<!{WORD})(?=({'|'.join(parts)}))"
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), "\n")


def topic_by_keywords(text: Column, vocab: Vocabulary) -> Column:
    """First topic with a keyword in ``text`` (lower case), else the default topic. The text is read
    once for the keywords of all topics; the topics are tried on the few finds."""
    def first_topic(finds):
        chain = F.when(finds == "", F.lit(vocab.otherwise))
        for topic, keywords in vocab.topics:
            chain = chain.when(finds.rlike(whole_word_pattern(keywords)), F.lit(topic))
        return chain.otherwise(F.lit(vocab.otherwise))

    return let(_word_finds(text, [k for _, keywords in vocab.topics for k in keywords]), first_topic)


def keyword_scores(df: DataFrame, vocab: Vocabulary, title: str = "title", summary: str = "summary") -> DataFrame:
    text = F.lower(F.concat(F.col(title), F.lit(" "), F.col(summary)))
    both = let(found_strings(text, [*vocab.tech, *vocab.reject]), lambda found: F.struct(
        hits(found, vocab.tech).alias("t"), hits(found, vocab.reject).alias("r")))
    return (computed_once(df, _hits=both).withColumns({"tech_score": F.col("_hits.t"), "reject_score": F.col("_hits.r")})
            .drop("_hits"))


def decide_from_scores(scores: Column) -> Column:
    """Model scores (best first) to a decision struct (topic, method, confidence, reason)."""
    two = lambda c: F.format_number(c, 2)  # rounds the binary value half to even

    def decision(topic, method, confidence, *reason):
        return F.struct(topic.alias("topic"), F.lit(method).alias("method"), confidence.alias("confidence"),
                        F.concat(*reason).alias("reason"))

    def decide(s):
        top = s[0]
        rest = F.filter(s, lambda x: (x["label"] != NON_TECH) & (x["score"] > 0))
        best_score = F.array_max(F.transform(rest, lambda x: x["score"]))
        best = F.filter(rest, lambda x: x["score"] == best_score)[0]
        none = F.lit(None).cast("string")
        return (F.when(top["label"] != NON_TECH, decision(
                    top["label"], "ai_zero_shot", top["score"],
                    F.lit("AI classified with "), two(top["score"]), F.lit(" confidence")))
                .when(top["score"] >= ACCEPT_AT, decision(
                    none, "ai_zero_shot_reject", top["score"],
                    F.lit("AI rejected as non-tech with "), two(top["score"]), F.lit(" confidence")))
                .when(F.size(rest) > 0, decision(
                    best["label"], "ai_zero_shot_redirect", best["score"],
                    F.lit("Redirected from non-tech to "), best["label"], F.lit(" with "), two(best["score"]), F.lit(" confidence")))
                .otherwise(decision(none, "ai_uncertain_reject", top["score"], F.lit("No tech alternative found"))))

    return F.when(F.size(scores) > 0, let(scores, decide))


def normalize_model_output(raw: Column) -> Column:
    """JSON from the model as array<struct<label,score>>. Two shapes are known: a list of
    {label, score} and {labels: [..], scores: [..]}; anything else is NULL."""
    text = F.trim(raw)
    listed = F.from_json(text, SCORES)
    zipped = F.from_json(text, "labels array<string>, scores array<double>")
    pairs = F.transform(F.arrays_zip(zipped["labels"], zipped["scores"]),
                        lambda z: F.struct(z["labels"].alias("label"), z["scores"].alias("score")))
    return (F.when(text.startswith("[") & F.forall(listed, lambda x: x["label"].isNotNull() & x["score"].isNotNull()), listed)
            .when(text.startswith("{") & zipped["labels"].isNotNull() & zipped["scores"].isNotNull(), pairs))


def classify(df: DataFrame, vocab: Vocabulary | None = None, title: str = "title", summary: str = "summary",
             scores: str | None = None, topic: str = "topic") -> DataFrame:
    """Adds tech_score, reject_score, method, ai_used, confidence, reason and ``topic``.

    ``scores`` names a column of model scores (NULL where the model gave none). Rule order:
    clear reject, clear accept, model, keyword fallback, fallback reject.
    """
    vocab = vocab or Vocabulary.default()
    df = keyword_scores(df, vocab, title, summary)
    t, r = F.col("tech_score"), F.col("reject_score")
    model = decide_from_scores(F.col(scores)) if scores else F.lit(None).cast(
        "struct<topic:string,method:string,confidence:double,reason:string>")
    by_rule = F.when(r >= 2, "keyword_reject").when((t >= 2) & (r == 0), "keyword_accept")
    df = df.withColumn("_model", F.when(by_rule.isNull(), model))
    df = df.withColumn("_rule", F.coalesce(by_rule, F.when(F.col("_model").isNotNull(), "model").when(
        (t >= 3) & (t > r * 2), "keyword_fallback").otherwise("keyword_fallback_reject")))
    rule = F.col("_rule")
    # the topic step reads the title once more in front of the text
    words = F.lower(F.concat(F.col(title), F.lit(" "), F.col(title), F.lit(" "), F.col(summary)))
    by_words = F.when(rule.isin("keyword_accept", "keyword_fallback"), let(words, lambda w: topic_by_keywords(w, vocab)))
    df = computed_once(df.drop(topic), _words_topic=by_words)
    undecided = ~rule.isin("keyword_reject", "keyword_accept")
    score = lambda cap: F.least(t / F.lit(10.0), F.lit(cap))
    return df.withColumns({
        topic: F.when(rule == "model", F.col("_model.topic")).otherwise(F.col("_words_topic")),
        "method": F.when(rule == "model", F.col("_model.method")).otherwise(rule),
        "ai_used": undecided if scores else F.lit(False),
        "confidence": F.when(rule == "keyword_reject", F.lit(0.0)).when(rule == "keyword_accept", score(0.95))
                       .when(rule == "keyword_fallback", score(0.7)).when(rule == "model", F.col("_model.confidence"))
                       .otherwise(F.lit(0.2)),
        "reason": F.when(rule == "keyword_reject", F.concat(F.lit("Non-tech signals: reject="), r.cast("string")))
                   .when(rule == "keyword_accept", F.concat(F.lit("Strong tech keywords: "), t.cast("string")))
                   .when(rule == "keyword_fallback", F.concat(F.lit("Tech dominates: "), t.cast("string"), F.lit(" vs "), r.cast("string")))
                   .when(rule == "model", F.col("_model.reason")).otherwise(F.lit("Insufficient tech evidence")),
    }).drop("_rule", "_model", "_words_topic")


def undecided(df: DataFrame) -> DataFrame:
    """Rows of ``keyword_scores`` output that the keyword rules leave open; only these go to a model."""
    t, r = F.col("tech_score"), F.col("reject_score")
    return df.where(~((r >= 2) | ((t >= 2) & (r == 0))))


def model_text(title: Column, summary: Column, size: int = 512) -> Column:
    """Masked text in the length the model takes."""
    return F.left(sanitize_pii(F.concat(title, F.lit(". "), summary)), F.lit(size))


def score_topics(df: DataFrame, scorer: Callable[[pd.Series], list], key: str = "id", text: str = "model_text",
                 scores: str = "scores") -> DataFrame:
    """(key, scores) for every row, from a batch scorer ``Series[str] -> list of [(label, score)]``.
    Arrow batches per task; the scorer is loaded where the data is."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {scores} array<struct<label:string,score:double>>"

    def run(batches):
        for pdf in batches:
            found = scorer(pdf[text])
            yield pd.DataFrame({key: pdf[key], scores: [
                None if row is None else [{"label": a, "score": float(b)} for a, b in row] for row in found]})

    return df.select(key, text).mapInPandas(run, schema)


def metadata(method="method", ai_used="ai_used", confidence="confidence", reason="reason") -> Column:
    """How a row was classified, as a struct."""
    return F.struct(*[F.col(c).alias(n) for c, n in zip((method, ai_used, confidence, reason), CLASSIFICATION.names)])
