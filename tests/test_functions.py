from pyspark.sql import functions as F

from newsweave.functions import html as H
from newsweave.functions import images as G
from newsweave.functions import text as X
from newsweave.functions import urls as U

c = F.col


def test_excerpt(one):
    long_stop = "a" * 120 + ". " + "b" * 100
    early_stop = "a. " + "b" * 300
    assert one(X.excerpt("t"), t=["short", long_stop, early_stop, "x" * 200]) == [
        "short", "a" * 120 + ".", early_stop[:200] + "...", "x" * 200]


def test_clean_article_text(one):
    assert one(X.clean_article_text("t"), t=["", None, "Source: see https://a.b/c, , and this is long enough text,", "!!!", "https://a.b"]) == [
        "No summary available.", "No summary available.", "see, and this is long enough text", "Article summary not available.", "Article summary not available."]


def test_flashcard(one):
    long = "First sentence here. Second one follows! " + "x" * 300
    got = one(X.flashcard_text("t", F.lit(None).cast("string"), F.lit("src")), t=["<b>Hello</b> big wide world.", "tiny", long, "Article URL: https://x.y/z Points: 10 # Comments: 3 real text here"])
    assert got == ["Hello big wide world", "Read this tech article from src.", "First sentence here.  Second one follows...", "real text here"]


def test_unicode_space_is_collapsed(one):
    assert one(X.strip_markup("t"), t=["<p>a  b</p>&nbsp;c"]) == ["a b c"]


def test_sanitize_pii(one):
    assert one(X.sanitize_pii("t"), t=["mail bob.x@ex.co.uk or 555-123-4567, see http://a.b/c?d ok", "éa@b.com", "y" * 1200]) == [
        "mail [EMAIL] or [PHONE], see [URL] ok", "éa@b.com", "y" * 1000]


def test_masks_beside_letters_and_marks(one):
    texts = ["a@b.co", "555-123-4567+65 123 4567", "x555-123-4567", "é+65-1234-5678", "+65-1234-5678", "no mail +", "@", None, "٣٣٣-123-4567 b.x@ex.com"]
    assert one(X.sanitize_pii("t"), t=texts) == ["[EMAIL]", "[PHONE]+65 123 4567", "x555-123-4567", "é[PHONE]", "+65-1234-5678", "no mail +", "@", None,
                                                 "[PHONE] [EMAIL]"]


def test_summarizer_and_points(one):
    assert one(X.summarizer_input("a", "b"), a=["A title", "A title of some length", "T"], b=["x" * 60 + "...", "", "short"]) == [
        "A title. " + "x" * 60, "A title of some length", None]
    assert one(F.array_join(X.key_points("t"), "|"), t=[" One. Two \n\nThree. "]) == ["*One|*Two|*Three"]


def test_urls_normalize_and_join(one):
    cases = {"https://example.com": "https://example.com", "https://example.com/": "https://example.com/", "HTTPS://EXAMPLE.COM": "https://example.com",
             "https://example.com:443": "https://example.com", "http://example.com:80": "http://example.com",
             "https://example.com/path/../other": "https://example.com/other", "https://example.com//double/slash": "https://example.com/double/slash",
             "https://example.com/path?": "https://example.com/path", "https://example.com/path#": "https://example.com/path", "nope": None}
    assert one(U.url_normalize(c("u")), u=list(cases)) == list(cases.values())
    joins = [("https://example.com", "/path", "https://example.com/path"), ("https://example.com/", "path", "https://example.com/path"),
             ("https://example.com/base", "../other", "https://example.com/other"), ("https://example.com/base/", "./relative", "https://example.com/base/relative")]
    assert one(U.url_join(c("b"), c("r")), b=[j[0] for j in joins], r=[j[1] for j in joins]) == [j[2] for j in joins]


def test_urls_valid(one):
    good = ["https://www.example.com", "http://example.com", "https://example.com:8080", "https://example.com/path?query=value", "https://192.168.1.1",
            "https://[::1]", "ftp://example.com/file.txt", "https://example-site.com", "https://example.co.uk"]
    bad = ["", "not-a-url", "http://", "https://", "ftp://", 'javascript:alert("x")', "data:text/html,<b>", "file:///etc/passwd", "http://.", "http://..",
           "http://../", "http://?", "http://??/", "http://##/", "http:// shouldfail.com", "http://foo.bar?q=Spaces should be encoded", None]
    assert one(U.url_valid(c("u")), u=good + bad) == [True] * len(good) + [False] * len(bad)
    assert one(U.url_domain(c("u")), u=["https://[::1]:8080", "http://sub.example.com:8080", "not-a-url", None]) == ["[::1]", "sub.example.com", None, None]
    assert one(U.url_safe_host(c("h")), h=["example.com", "localhost", "127.0.0.1", "10.0.0.1", "192.168.1.1", "172.16.0.1", None]) == [True] + [False] * 6
    assert one(U.url_relative(c("u")), u=["/a", "a/b", "../a", "?q", "#f", "https://e.com", "mailto:a@b.c"]) == [True] * 5 + [False] * 2


def test_url_coding(one):
    texts = {"hello world": "hello%20world", "special!@#$%characters": "special%21%40%23%24%25characters", "unicode_测试": "unicode_%E6%B5%8B%E8%AF%95", "already%20encoded": "already%20encoded"}
    assert one(U.url_encode(c("t")), t=list(texts)) == list(texts.values())
    assert one(U.url_decode(c("t")), t=["hello%20world", "a+b", "100%"]) == ["hello world", "a+b", "100%"]


def test_url_parts(one):
    got = one(U.url_parts(c("u")), u=["https://sub.example.com:8080/path/to?query=value&o=p#section", "https://example.com"])
    assert tuple(got[0]) == ("https", "sub.example.com", 8080, "/path/to", "query=value&o=p", "section")
    assert tuple(got[1]) == ("https", "example.com", None, "", "", "")


def test_images(one):
    assert one(G.is_image_url(c("u")), u=[None, " ", "a.JPG", "https://cdn.x/y", "https://x.example.com/logo/abc", "https://x.example.com/abcdef", "ftp://x.example.com/abcdefgh"]) == [
        False, False, True, True, False, True, False]
    html = ['<img src="a.jpg" width="10" height="10"><img src="b.jpg" width="20" height="20">', '<img src="" srcset="s.jpg 1x, m.jpg 640w, l.jpg 1280w">',
            "<img data-lazy-src=lazy.png>", '<img src="x…y.gif">', "<p>none</p>", '<img src="1.png" width="5px" height="900"><img src="2.png">']
    assert one(G.image_from_html(c("h")), h=html) == ["b.jpg", "l.jpg", "lazy.png", "xy.gif", None, "1.png"]


def test_html(one):
    page = "<html><head><title>T &amp; U</title><script>var a='<p>';</script><style>p{}</style></head><body><!-- c --><p> a <b>b</b></p>x&copy;</body></html>"
    assert one(H.html_to_text(c("h")), h=[page, "", None]) == ["T & U a b x©", "", ""]
    dirty = '<p onclick="x">a<script>evil()</script><a href="javascript:x" title="t">l</a><b>bold<br>'
    assert one(H.sanitize_html(c("h")), h=[dirty, "<![CDATA[<i>k</i>]]>"]) == [
        '<p>aevil()<a title="t">l</a><b>bold<br></b></p>', "<i>k</i>"]
    assert one(H.sanitize_user_html(c("h")), h=['<p class="x">a<a href="h">b</a> &lt; c &copy; AT&T &amp</p>', "<b>x&nope;<script>a && b</script>"]) == [
        "<p>ab &lt; c &copy; AT&amp;T &amp;amp</p>", "<b>x&amp;nope;a &amp;&amp; b</b>"]


def test_company_word_match(one):
    from newsweave.operators.trends import company_mentions

    titles = ["Metal prices rise", "Meta and Facebook merge", "X marks AWS"]
    assert one(F.array_join(company_mentions(c("t")), ","), t=titles) == ["Meta", "Meta", "Twitter/X,AWS"]
    assert one(F.array_join(company_mentions(c("t"), match="word"), ","), t=titles) == ["", "Meta", "Twitter/X,AWS"]
