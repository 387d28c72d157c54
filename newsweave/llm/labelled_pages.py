"""Small labelled pages from which the page model is trained when a caller has none.

``data-main`` marks an element whose text is main text, ``data-off`` one inside it that is not. Neither attribute is seen by the
model. The pages show the usual parts of a page in different markup: named by tag, by class or id, or by neither.
"""

WORDS = ("The council met on Monday to discuss the harbour, and members heard that repairs will take longer than planned. "
         "Costs have risen since spring; the engineers, who had warned of this, want a second survey before winter.")
SHORT = "Repairs at the harbour will take until spring."
LINKS = "".join(f'<li><a href="/{n}">{n}</a></li>' for n in ("Home", "News", "Sport", "Weather", "Contact"))
STORIES = "".join(f'<li><a href="/{i}">Another headline about the town number {i}</a></li>' for i in range(4))
FORM = '<form action="/s"><label>Your mail address</label><input name="m"><select><option>Daily</option><option>Weekly</option></select><button>Sign up now</button></form>'
VOICES = "".join(f'<div class="comment"><p class="author">reader{i}</p><p>I do not agree with this at all, they should have asked us first.</p></div>' for i in range(3))


def paragraphs(n: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{WORDS if i % 3 != 1 else SHORT}</{tag}>" for i in range(n))


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Harbour</title><style>p{{}}</style><script>var a=1;</script></head><body>{body}</body></html>"


LABELLED = [
    # all parts have tags of their own
    page(f'<nav><ul>{LINKS}</ul></nav><div class="ad">Buy new boots today.</div><article data-main><h1>Harbour repairs</h1>{paragraphs(5)}</article><footer>&copy; 2024 The Town Paper</footer>'),
    page(f'<header><div class="logo">The Town Paper</div><nav><ul>{LINKS}</ul></nav></header><main data-main><h1>Harbour</h1>{paragraphs(4)}<blockquote><p>{SHORT}</p></blockquote>'
         f'<ul><li>{SHORT}</li><li>The pier stays open.</li></ul><h2>What comes next</h2>{paragraphs(2)}</main><aside><h3>Most read</h3><ul>{STORIES}</ul></aside><footer><p>Imprint</p></footer>'),
    page(f'<nav>{LINKS}</nav><article data-main><header><h1>Harbour repairs</h1></header>{paragraphs(2)}<aside data-off>{STORIES}</aside>{paragraphs(2)}'
         f'<table><tr><th>Year</th><th>Cost</th></tr><tr><td>2023</td><td>4 million</td></tr></table><pre>total = a + b</pre><figure><figcaption>The old pier</figcaption></figure></article>'
         f'<section id="comments"><h2>Comments</h2>{VOICES}{FORM}</section><footer>All rights reserved.</footer>'),
    # parts named by class or id
    page(f'<div id="header"><div class="menu"><ul>{LINKS}</ul></div></div><div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div>'
         f'<div id="content" data-main><h1>Harbour repairs</h1>{paragraphs(5)}</div><div class="sidebar"><div class="widget"><h4>Related</h4><ul>{STORIES}</ul></div></div>'
         f'<div id="footer"><p>&copy; The Town Paper, all rights reserved.</p></div>'),
    page(f'<div class="topbar">{LINKS}</div><div class="wrapper"><div class="post-body entry" data-main><h2>Harbour</h2>{paragraphs(3)}<div class="advert" data-off>Cheap boats for sale, call now.</div>{paragraphs(2)}'
         f'</div><div class="comments"><h3>3 comments</h3>{VOICES}</div><div class="newsletter">{FORM}</div></div><div class="bottom footer-links"><ul>{LINKS}</ul></div>'),
    page(f'<div role="banner">The Town Paper</div><div role="navigation"><ul>{LINKS}</ul></div><div role="main" data-main><h1>Harbour</h1>{paragraphs(3)}</div>'
         f'<div role="complementary"><p>Follow us for more stories.</p><ul>{STORIES}</ul></div><div role="contentinfo">Imprint and privacy</div>'),
    page(f'<div class="site-nav"><ul>{LINKS}</ul></div><section class="story article-text" data-main><h1>Harbour</h1>{paragraphs(4)}<p>{SHORT}</p></section>'
         f'<div class="sponsored promo">Sponsored: {SHORT}</div><div class="related-posts"><ul>{STORIES}</ul></div><div class="share social"><a href="#">Share</a> <a href="#">Like</a></div>'),
    page(f'<div class="notice alert">This site will be down on Sunday.</div><div class="popup modal" hidden><p>Subscribe to our newsletter today and save.</p>{FORM}</div>'
         f'<article class="entry-content" data-main><h1>Harbour</h1>{paragraphs(3)}<div class="text">{paragraphs(1)}</div></article><div class="breadcrumbs"><a href="/">Home</a> <a href="/n">News</a></div>'
         f'<div id="disqus_thread" class="reader-comments">{VOICES}</div>'),
    # parts named by nothing
    page(f'<div><ul>{LINKS}</ul></div><div><div data-main><h1>Harbour repairs</h1>{paragraphs(6)}</div><div><ul>{STORIES}</ul></div></div><div><a href="/i">Imprint</a> <a href="/p">Privacy</a></div>'),
    page(f'<div><a href="/">Home</a> <a href="/n">News</a></div><div data-main><p>{WORDS} {WORDS}</p><p>{SHORT}</p><p>{WORDS}</p></div><div>{FORM}</div><div><small>Printed in town</small></div>'),
    page(f'<table><tr><td><ul>{LINKS}</ul></td><td data-main><h1>Harbour</h1>{paragraphs(4)}</td><td><ul>{STORIES}</ul></td></tr></table><footer>Imprint</footer>'),
    # a short article, and one that begins and ends abruptly
    page(f'<nav><ul>{LINKS}</ul></nav><div class="ad">Boots and more boots for every foot.</div><article data-main><h1>{SHORT}</h1><p><b>{SHORT}</b></p></article><footer>&copy; town &middot; {SHORT}</footer>'),
    page(f'<header>The Town Paper</header><div class="banner-ad">{WORDS}</div><article data-main><h1>Harbour</h1><p>{SHORT}</p></article><section class="comments">{VOICES}{VOICES}</section>'
         f'<aside class="notice"><p>{WORDS}</p></aside><footer>{WORDS}</footer>'),
    # long texts that are no main text
    page(f'<header class="site-header"><h1>The Town Paper</h1><p>{SHORT}</p></header><div class="container"><div class="left-sidebar"><h3>About</h3><p>{WORDS}</p></div>'
         f'<article class="post" data-main><h1>Harbour</h1>{paragraphs(3)}<ul><li>{SHORT}</li></ul></article><section class="comments"><h2>Comments</h2><article class="comment"><p>{WORDS}</p></article></section></div>'
         f'<div class="cookie-banner"><p>{WORDS}</p></div><footer><p>{WORDS}</p></footer>'),
    page(f'<div id="nav"><ul>{LINKS}</ul></div><main data-main><h1>Harbour</h1>{paragraphs(2)}<div class="advertisement" data-off>{WORDS}</div>{paragraphs(2)}<form data-off><label>Mail</label><p>{SHORT}</p></form>'
         f'<aside data-off><p>{WORDS}</p></aside><div id="comments" data-off><p>{WORDS}</p>{VOICES}</div></main>'),
    page(f'<nav><p>{SHORT}</p><ul>{LINKS}</ul></nav><div class="ad">{WORDS}</div><article data-main><h1>{WORDS}</h1></article><footer>&copy; {WORDS} {WORDS}</footer>'),
    page(f'<header><p>{WORDS}</p></header><article data-main><p>{WORDS}</p><div><p>{WORDS}</p></div><section><h2>Costs</h2><p>{WORDS}</p></section></article><aside>{WORDS}</aside>'
         f'<div class="notice"><p>{WORDS}</p></div><div class="sidebar"><p>{WORDS}</p></div><form><p>{WORDS}</p></form><div class="ads sponsored"><p>{WORDS}</p></div>'),
    page(f'<div class="menu">{SHORT}</div><div class="page"><div class="article" data-main><h2>Harbour</h2>{paragraphs(3, "div")}</div><div class="comment-list"><div class="comment">{WORDS}</div></div>'
         f'<div class="footer">{WORDS}</div></div>'),
    # main text with much in it that is none
    page(f'<main data-main><h1>Harbour</h1>{paragraphs(2)}<div class="ads" data-off>{WORDS}</div>{paragraphs(1)}<form data-off>{SHORT}</form><aside data-off>{WORDS}</aside><nav data-off>{LINKS}</nav></main>'),
    page(f'<article data-main><header><h1>Harbour</h1></header>{paragraphs(1)}<aside data-off><p>{WORDS}</p></aside>{paragraphs(1)}<div class="share" data-off>{SHORT}</div><form data-off><p>{SHORT}</p></form>'
         f'<section class="comments" data-off>{VOICES}</section><footer data-off>{SHORT}</footer></article>'),
    page(f'<div class="content" data-main><p>{WORDS}</p><div class="notice" data-off>{SHORT}</div><p>{WORDS}</p><div class="advert" data-off>{SHORT}</div><div class="sidebar" data-off>{WORDS}</div>{FORM.replace("<form", "<form data-off")}</div>'),
    # main text directly in the body
    page(paragraphs(4).replace("<p>", "<p data-main>")),
    page(f'<h1 data-main>Harbour</h1>{paragraphs(3).replace("<p>", "<p data-main>")}'),
    page(f'<nav><ul>{LINKS}</ul></nav><h1 data-main>Harbour</h1>{paragraphs(5).replace("<p>", "<p data-main>")}<div class="comments">{VOICES}</div><footer>{SHORT}</footer>'),
    page(f'<div class="header">{SHORT}</div><h2 data-main>Harbour</h2>{paragraphs(2).replace("<p>", "<p data-main>")}<div class="ad">{WORDS}</div>{paragraphs(2).replace("<p>", "<p data-main>")}'),
]
