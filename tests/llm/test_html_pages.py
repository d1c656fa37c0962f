"""Main text of hand-made pages that the generator of the training pages never drew; ``[[ ]]`` marks what belongs to the text."""

from __future__ import annotations

import re

from millrace.llm import html_extract

A = "The harbour was quiet when the first boats came in, and the men on the quay counted the nets before they spoke. Nobody had expected such a catch so late in the year."
B = "By noon the market had sold out, which the older traders said had not happened since the bridge was built. Prices fell again in the evening."
C = "The council will meet on Thursday to decide whether the second pier should be repaired or given up."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2021 Harbour Times. All rights reserved.</p></footer>"
COMMENTS = '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I was there and saw it too.</p></div><div class="comment"><p>Nice article, thanks for it!</p></div></section>'
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm warning</a></li><li><a href="/2">New ferry</a></li></ul></aside>'

PAGES = [
    f"<body><p>[[{C}]]</p></body>",
    f"<body><p>[[{A}]]</p><p>[[{B}]]</p></body>",
    f"[[{A}]]",
    f"<html><body><h1>[[Late catch]]</h1>[[{A}]]<br>[[{B}]]</body></html>",
    f"<body><h1>[[T]]</h1><p>[[a&nbsp;b and more words to come in this one]]</p></body>",
    "<article><h1>[[T]]</h1><p>[[a&nbsp;b and more words to come here]]</p></article>",
    f"<body>{NAV}<article><h1>[[Late catch]]</h1><p>[[{A}]]</p><p>[[{B}]]</p></article>{FOOT}</body>",
    f"<body>{NAV}<main><h1>[[Late catch]]</h1><p>[[{A}]]</p><h2>[[The market]]</h2><p>[[{B}]]</p></main>{SIDE}{FOOT}</body>",
    f"<body><div id=header><a href=/>Harbour Times</a></div><div id=content><p>[[{A}]]</p><p>[[{C}]]</p></div><div id=footer>Contact | Imprint</div></body>",
    f"<body><table width=100%><tr><td><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></td><td><p>[[{A}]]</p><p>[[{B}]]</p></td></tr><tr><td colspan=2>Copyright 2001 Harbour Times</td></tr></table></body>",
    f"<body><div class=wrapper><div class=post><h2>[[Late catch]]</h2><p>[[{A}]]</p><blockquote><p>[[{C}]]</p></blockquote><p>[[{B}]]</p></div>{COMMENTS}</div></body>",
    f'<body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><article><p>[[{A}]]</p><p>[[{B}]]</p></article></body>',
    f'<body><article><p>[[{A}]]</p><div class="advert"><p>Buy two nets and get one free today!</p></div><p>[[{B}]]</p></article></body>',
    f'<body><article><p>[[{A}]]</p><form action="/s"><label>Your mail</label><input name=m><button>Subscribe</button></form><p>[[{B}]]</p></article></body>',
    f"<body><article><h1>[[Late catch]]</h1><p>[[{A}]]</p><p>[[See also these reports from the coast:]]</p><ul><li><a href=/x>[[The long winter of the northern fleet]]</a></li><li><a href=/y>[[How the bridge changed the market]]</a></li></ul><p>[[{B}]]</p></article></body>",
    f"<body><article><h1>[[Late catch]]</h1><p>[[{A}]]</p><ul><li>[[Cod, four hundred boxes]]</li><li>[[Herring, nine hundred boxes]]</li></ul></article>{FOOT}</body>",
    f"<body><article><p>[[{A}]]</p><table><tr><td>[[Cod]]</td><td>[[400]]</td></tr><tr><td>[[Herring]]</td><td>[[900]]</td></tr></table><p>[[{B}]]</p></article></body>",
    f"<body>{NAV}<article><header><h1>[[Late catch]]</h1></header><p>[[{A}]]</p></article>{COMMENTS}{FOOT}</body>",
    f"<body><article><p>[[{A}]]</p></article><div class=related><h3>Related stories</h3><ul><li><a href=/1>Storm warning for the coast</a></li><li><a href=/2>New ferry starts in May</a></li></ul></div></body>",
    f"<body><div><div><div><p>[[{A}]]</p></div></div></div><div><a href=/1>Imprint</a> <a href=/2>Privacy</a> <a href=/3>Terms</a></div></body>",
    f"<body><script>var a = '<p>no text</p>';</script><style>p {{ color: red }}</style><p>[[{A}]]</p><noscript>Please enable scripts.</noscript></body>",
    f"<body><p>[[{A}<p>{B}<p>{C}]]</body>".replace("<p>", "]]<p>[[", 2).replace("<p>[[]]", "<p>"),
    f'<body><div class="entry-content"><h3>[[Day one]]</h3><p>[[{A}]]</p><h3>[[Day two]]</h3><p>[[{B}]]</p></div><div class="share-links"><a href=/f>Share</a> <a href=/t>Tweet</a></div></body>',
    f"<body><section><h1>[[Late catch]]</h1><p>[[{A}]]</p></section><section><h2>[[The market]]</h2><p>[[{B}]]</p></section>{FOOT}</body>",
    f'<body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/n>News</a> &gt; Catch</div><div class="article-body"><p>[[{A}]]</p><p>[[AT&amp;T and Q&amp;A are kept &lt;so&gt;, the report adds at its end.]]</p></div></body>',
    f"<body><pre>[[{C}]]</pre></body>",
    f"<body><center><h1>[[Late catch]]</h1></center><p>[[{A}]]</p><hr><p>[[{B}]]</p></body>",
    f'<body><article><p>[[{A}]]</p><figure><img src=a.jpg><figcaption>[[Boats in the harbour at dawn]]</figcaption></figure><p>[[{B}]]</p></article>{SIDE}</body>',
    f'<body><div class="newsletter"><h3>Our letter</h3><p>Get the news by mail every morning.</p></div><main><p>[[{A}]]</p><p>[[{B}]]</p></main></body>',
    f'<body><div style="display:none"><p>Hidden words that nobody sees here.</p></div><article><p>[[{A}]]</p><p>[[{B}]]</p></article></body>',
    f"<body><dl><dt>[[Quay]]</dt><dd>[[{C}]]</dd><dt>[[Pier]]</dt><dd>[[{A}]]</dd></dl></body>",
    f"<body>{NAV}{FOOT}</body>",
]


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text)


def test_hand_made_pages():
    """Recall of the words of the text and of what isn't text, over all pages; nothing of a page with text is lost as a whole."""
    kept = wanted = leaked = other = 0
    for page in PAGES:
        markup = page.replace("[[", "").replace("]]", "")
        inside = html_extract.parse("\n".join(f"<p>{x}</p>" for x in re.findall(r"\[\[(.*?)\]\]", page, re.S)))
        right = words(" ".join(t for _, t in inside.runs))
        got = words(html_extract.main_texts([markup])[0])
        every = words(" ".join(t for _, t in html_extract.parse(markup).runs))
        pool = list(got)
        for w in right:
            wanted += 1
            if w in pool:
                pool.remove(w)
                kept += 1
        leaked += len(pool)
        other += len(every) - len(right)
        assert bool(got) == bool(right), page
    assert kept / wanted >= 0.97 and leaked / other <= 0.1, (kept / wanted, leaked / other)


def test_references_stay_within_their_stretch_of_text():
    assert html_extract.main_texts([f"<p>AT&<i>lt;</i> {A}</p>"])[0].startswith("AT&lt; The harbour")
    assert html_extract.main_texts([f"<p>a&am<b></b>p;b &frac12; {A}</p>"])[0].startswith("a&amp;b ½ The")
