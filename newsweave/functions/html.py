"""HTML as text, by Spark's expressions; and reduced to an allow list, which takes a stack of open tags and so a tokenizer
(the standard library's, in Arrow batches)."""

from __future__ import annotations

import re
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import WS, let, truncate_text

# Tags and attributes kept in article markup, and tags kept in reader input.
ARTICLE_TAGS = ["p", "br", "strong", "b", "em", "i", "u", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
                "blockquote", "a", "img", "div", "span", "pre", "code"]
ARTICLE_ATTRIBUTES = {"a": ["href", "title"], "img": ["src", "alt", "title", "width", "height"], "div": ["class"],
                      "span": ["class"], "pre": ["class"], "code": ["class"]}
USER_TAGS = ["p", "br", "strong", "b", "em", "i"]

_EMPTY = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_LINKS = {"href", "src"}
_SAFE_SCHEME = re.compile(r"(?:https?|mailto):", re.I)
_ANY_SCHEME = re.compile(r"[a-z][a-z0-9+.\-]*:", re.I)


#: Elements whose text is not shown, with their bodies; comments, declarations and tags.
_UNSHOWN = r"(?is)<(script|style|template)\b[^>]*+>.*?(?:</\1\s*>|\z)"
_MARKUP = r"""(?s)<!--.*?(?:-->|\z)|<[!?][^>]*+>|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^>]*+>"""
_CUT = "\x01"


def _characters(c: Column) -> Column:
    """Character references decoded; the list of named ones is the standard library's. Only texts with an ampersand are sent to Python."""
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(unescape, na_action="ignore")

    return F.coalesce(run(F.when(F.contains(c, F.lit("&")), c)), c)


def _nodes(markup: Column) -> Column:
    """Text between the cuts, each part stripped, joined by one space."""
    strip = lambda n: F.regexp_replace(n, rf"\A{WS}+|{WS}+\z", "")
    return F.array_join(F.filter(F.transform(F.split(markup, _CUT), strip), lambda n: n != ""), " ")


#: An ampersand that starts no complete entity, and what stands for it while the markup is read.
_BARE = re.compile("&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
_HELD = "\ufdd0"


class _Allowed(HTMLParser):
    """Markup with only the allowed tags and attributes; text of other tags stays, escaped."""

    def __init__(self, tags, attributes):
        super().__init__(convert_charrefs=False)
        self.tags, self.attributes, self.out, self.open = tags, attributes, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.tags:
            return
        kept = []
        for name, value in attrs:
            value = (value or "").replace(_HELD, "&")
            target = re.sub(r"[\x00-\x20]", "", value)
            unsafe = name in _LINKS and _ANY_SCHEME.match(target) and not _SAFE_SCHEME.match(target)
            if name in self.attributes.get(tag, ()) and not unsafe:
                kept.append(f' {name}="{escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")
        if tag not in _EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open[-1] != tag:
                self.out.append(f"</{self.open.pop()}>")
            self.out.append(f"</{self.open.pop()}>")

    def handle_data(self, data):
        self.out.append(escape(data.replace(_HELD, "&"), quote=False))

    def handle_entityref(self, name):
        """A known entity stays as written; the ampersand of an unknown one is escaped."""
        self.out.append(f"&{name};" if f"{name};" in html5 else f"&amp;{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    @classmethod
    def of(cls, html, tags, attributes):
        if not html:
            return ""
        page = cls(tags, attributes)
        page.feed(_BARE.sub(_HELD, re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", html, flags=re.S)))
        page.close()
        page.out.extend(f"</{tag}>" for tag in reversed(page.open))
        return "".join(page.out)


def html_to_text(c) -> Column:
    """Text nodes joined by one space, without script and style bodies. Cut by Spark's own expressions; only character references are decoded in Python."""
    html = F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(html, _UNSHOWN, _CUT), _MARKUP, _CUT)
    return let(_characters(cut), _nodes)


def sanitize_html(c, tags=None, attributes=None) -> Column:
    """Article markup reduced to an allow list."""
    allowed, kept = frozenset(ARTICLE_TAGS if tags is None else tags), dict(ARTICLE_ATTRIBUTES if attributes is None else attributes)

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: _Allowed.of(h, allowed, kept))

    return run(c)


def sanitize_user_html(c) -> Column:
    """Reader input reduced to six tags without attributes."""
    return sanitize_html(c, USER_TAGS, {})


def html_summary(c, max_length: int = 200) -> Column:
    """Sanitised markup as text, cut at ``max_length``."""
    return let(html_to_text(sanitize_html(c)), lambda s: truncate_text(s, max_length))
