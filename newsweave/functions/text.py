"""Text operators as native column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's \s sees it, spelled out so every regex engine agrees.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: A Unicode word character, and a boundary between one and anything else.
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that each is evaluated once per row. A plain projection is copied into
    every filter and projection above that names it; the output of a generator is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), WS + "+", " "))


def strip_markup(c) -> Column:
    """Tags removed, entities to a space, white space collapsed."""
    no_tags = F.regexp_replace(_col(c), "<[^>]+>", "")
    return collapse(F.regexp_replace(no_tags, "&[a-zA-Z0-9#]+;", " "))


def strip_quotes(c) -> Column:
    return F.translate(_col(c), "\"'", "")


def truncate_text(c, max_length: int) -> Column:
    """First ``max_length`` characters and '...'; shorter text as it is."""
    c = _col(c)
    return F.when(F.length(c) > max_length, F.concat(F.left(c, F.lit(max_length)), F.lit("..."))).otherwise(c)


def card_snippet(c) -> Column:
    return truncate_text(c, 200)


def summary_fixed(c, max_length: int = 200) -> Column:
    """Cleaned text cut at a fixed length."""
    return let(strip_markup(c), lambda s: truncate_text(s, max_length))


def excerpt(c, size: int = 200, earliest_stop: int = 100) -> Column:
    """At most ``size`` characters of clean text, ending at the last full stop when that lies
    past ``earliest_stop``, else with '...'."""
    def cut(s):
        head = F.left(s, F.lit(size))
        stop = size - F.locate(".", F.reverse(head))  # 0-based index of the last stop; size when there is none
        at_stop = F.substr(head, F.lit(1), stop + 1)
        return F.when(F.length(s) <= size, s).when(
            (stop > earliest_stop) & (stop < size), at_stop).otherwise(F.concat(head, F.lit("...")))

    return let(_col(c), cut)


def clean_article_text(c) -> Column:
    """Summary without links and feed boilerplate, or a fixed sentence when nothing is left."""
    c = _col(c)
    s = F.regexp_replace(c, "https?://" + NOT_WS.replace("[^", "[^,", 1) + "+", "")
    for label in ("Comments URL:", "URL:", "Source:", "See also:"):
        s = F.regexp_replace(s, label + WS + "*", "")
    s = F.regexp_replace(s, f"{WS}*,{WS}*,{WS}*", ", ")
    s = F.regexp_replace(s, rf"\A,{WS}*", "")
    s = F.regexp_replace(s, rf"{WS}*,\n?\z", "")
    s = collapse(s)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("No summary available.")).otherwise(
        let(s, lambda t: F.when((F.length(t) < 20) | ~t.rlike(WORD), F.lit("Article summary not available.")).otherwise(t)))


def sanitize_pii(c, max_len: int | None = 1000) -> Column:
    """Email addresses, phone numbers and links masked; then at most ``max_len`` characters
    (``None`` keeps the whole text)."""
    s = _col(c)
    # what a match must hold is looked for before the edges of words, which are costly at every position
    s = F.when(s.contains("@"), F.regexp_replace(s, rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}", "[EMAIL]")).otherwise(s)
    s = F.regexp_replace(s, rf"(?=\p{{Nd}}{{3}}){EDGE}\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{4}}{EDGE}", "[PHONE]")
    s = F.regexp_replace(s, rf"(?=\+){EDGE}\+\p{{Nd}}{{1,3}}[-.]?\p{{Nd}}{{3,4}}[-.]?\p{{Nd}}{{4,}}{EDGE}", "[PHONE]")
    s = F.regexp_replace(s, f"https?://{NOT_WS}+", "[URL]")
    return s if max_len is None else F.left(s, F.lit(max_len))


#: Entities a text node shows most often.
_SHOWN = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def flashcard_text(summary, topic, source_name) -> Column:
    """Summary as a flash card shows it: no markup, no feed metadata, no table of contents, and
    one or two sentences of a long text."""
    s = F.regexp_replace(F.coalesce(_col(summary), F.lit("")), "<[^>]+>", "")
    for entity, shown in _SHOWN:
        s = F.replace(s, F.lit(entity), F.lit(shown))
    for pattern in (rf"(?i)Article URL:{WS}*https?://{NOT_WS}+", rf"(?i)Comments URL:{WS}*https?://{NOT_WS}+",
                    rf"(?i)Points:{WS}*[0-9]+", rf"(?i)#{WS}*Comments:{WS}*[0-9]+",
                    r"(?is)Table of contents.*?(?=\n\n|\n[A-Z]|\z)", r"(?is)Contents.*?(?=\n\n|\n[A-Z]|\z)",
                    rf"{WS}*\.{WS}*\z"):
        s = F.regexp_replace(s, pattern, "")
    s = collapse(s)

    def shorten(t):
        sentences = F.split(t, "[.!?]+")
        first = F.get(sentences, F.lit(0))
        two = F.when((F.size(sentences) > 1) & (F.length(first) < 150),
                     F.concat(first, F.lit(". "), F.get(sentences, F.lit(1)))).otherwise(first)
        return F.when(F.length(t) > 300, F.concat(two, F.lit("..."))).otherwise(t)

    name = lambda c, other: F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(other))
    instead = F.concat(F.lit("Read this "), name(topic, "tech"), F.lit(" article from "), name(source_name, "this source"), F.lit("."))
    return let(let(s, shorten), lambda t: F.when(F.length(t) < 10, instead).otherwise(t))


def summarizer_input(title, snippet) -> Column:
    """Text handed to a summariser, NULL when it is too short to summarise."""
    head = F.trim(_col(title))
    body = F.regexp_replace(F.trim(F.coalesce(_col(snippet), F.lit(""))), r"\.\.\.\z", "")
    full = F.when(body != "", F.concat(head, F.lit(". "), body)).otherwise(head)
    least = F.when(body != "", 50).otherwise(15)
    return F.when(F.length(full) >= least, F.trim(full))


def key_points(c) -> Column:
    """Summary as an array of '*point' lines."""
    points = F.transform(F.split(_col(c), r"[.\n]"), lambda p: F.regexp_replace(p, rf"\A{WS}+|{WS}+\z", ""))
    return F.transform(F.filter(points, lambda p: p != ""), lambda p: F.concat(F.lit("*"), p))


def iso_timestamp(c) -> Column:
    """ISO 8601 text; the fraction is left out when it is zero."""
    c = _col(c)
    whole = F.unix_micros(c) % 1_000_000 == 0
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def display_date(c) -> Column:
    return F.date_format(_col(c), "MMM d, yyyy")


def email_valid(c) -> Column:
    """local@domain.tld without white space."""
    ok = _col(c).rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}\z")
    return F.coalesce(ok, F.lit(False))


def entry_text(content: Column, summary: Column, title: Column) -> Column:
    """Raw text of a feed entry: first non-empty content value, else summary, else title."""
    full = F.get(F.filter(F.transform(content, lambda c: c["value"]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return F.coalesce(full, F.nullif(summary, F.lit("")), title)
