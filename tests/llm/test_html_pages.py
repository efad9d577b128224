"""Main-text extraction on pages whose article was marked by hand."""

import pytest

from taktwerk.llm.html import extract

A = "The river rose by two metres overnight, the council said, and three roads were closed."
B = "Engineers opened the upper gates at dawn, but the lower valley, they warned, could still flood."
C = "Farmers moved their cattle to the hills, as they had done in 1987, when the dam failed."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
T = [A, B, C]
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>"
FOOT = "<footer><p>© 2024 The Paper. All rights reserved.</p></footer>"
LINKS = "<ul><li><a href=a>First story</a><li><a href=b>Second story</a><li><a href=c>Third story</a></ul>"

PAGES = {
    "names on inline elements": (
        f"<article><p>The <span class='notice'>notice</span> of <a class='banner' href=x>the banner</a> and <span class='menu'>menu</span>.</p>{P}</article>",
        ["The notice of the banner and menu.", *T],
    ),
    "names on bold and code": (f"<article>{P}<p>Use <code class=search>grep</code>, <b class=ad>now</b>, <em id=share>please</em>.</p></article>", [*T, "Use grep, now, please."]),
    "title in a post header": (f"<body>{NAV}<div class='post'><div class='post-header'><h1>Flood</h1><span>By X</span></div><div class=text>{P}</div></div>{FOOT}", ["Flood", *T]),
    "title in a header of a div": (f"<body><header><h1>The Paper</h1></header><div class=post><header><h1>Flood</h1></header><div class=text>{P}</div></div>", ["Flood", *T]),
    "section header in main": (f"<main><div class='section-header'><h2>Flood</h2></div>{P}</main>", ["Flood", *T]),
    "header in main": (f"<main><header><h1>Flood</h1><p>By X, 3 May</p></header>{P}</main>", ["Flood", *T]),
    "site header with a title": (f"<body><div class='site-header'><h1>The Paper</h1></div><article><h1>Flood</h1>{P}</article>", ["Flood", *T]),
    "article and section in main": (f"<main><article><h1>Flood</h1>{P}</article><section><h2>Update</h2><p>Roads are open.</p></section></main>", ["Flood", *T, "Update", "Roads are open."]),
    "article and section in body": (f"<body>{NAV}<article>{P}</article><section><h2>Update</h2><p>Roads are open.</p></section>{FOOT}", [*T, "Update", "Roads are open."]),
    "a short second part": (f"<body>{NAV}<article>{P}</article><article><p>Part two, soon.</p></article>{FOOT}", [*T, "Part two, soon."]),
    "a caption with a name": (f"<article>{P}<figure class=banner><img src=x><figcaption>The dam in 1987.</figcaption></figure></article>", [*T, "The dam in 1987."]),
    "sources beside a div": (f"<body><div class=page><div class=text>{P}</div><h2>References</h2><ol><li><a href=x>Dam report, 1987</a></ol></div>", [*T, "References", "Dam report, 1987"]),
    "sources in a section": (f"<main><article>{P}</article><section><h3>Further reading</h3><ul><li><a href=x>Dam report</a></ul></section></main>", [*T, "Further reading", "Dam report"]),
    "links beside a div": (f"<body><div class=page><div class=text>{P}</div>{LINKS}</div>", T),
    "links beside an article in main": (f"<main><article>{P}</article>{LINKS}<div>{LINKS}</div></main>", T),
    "teasers beside an article": (f"<body><article>{P}</article><article><h3><a href=a>First story of the day</a></h3></article></body>", T),
    "references over pieces": (f"<article><p>AT&<b>lt;</b> and &amp;lt; and x&sup2;</p>{P}</article>", ["AT&lt; and &lt; and x²", *T]),
    "references without end": (f"<article><p>A&ampB &copy 5 &#8364; &#x41; &bogus; &nbsp;x</p>{P}</article>", ["A&B © 5 € A &bogus; x", *T]),
    "aside in an article": (f"<article>{P}<aside><p>Read our guide, to floods, now.</p></aside></article>", T),
    "comments in main": (f"<main>{P}<section id=comments><h2>Comments</h2><p>Great, really, great.</p></section></main>", T),
    "comments beside an article": (f"<body><article>{P}</article><section class='comments'><article><p>Great, really, great.</p></article></section>", T),
    "an advert between paragraphs": (f"<article><p>{A}</p><div class=ad><p>Buy boats, now, cheap.</p></div><p>{B}</p></article>", [A, B]),
    "a notice above": (f"<body><div class='cookie-notice'><p>We use cookies, many, many.</p></div><div>{P}</div>{FOOT}", T),
    "a form below": (f"<body><div>{P}<form><p>Your mail, please.</p><input></form></div>", T),
    "scripts and styles": (f"<article><script>if (a<b) '<p>x</p>'</script>{P}<style>p{{}}</style><noscript><p>Enable it.</p></noscript></article>", T),
    "hidden parts": (f"<article>{P}<div hidden><p>Not shown.</p></div><p style='display: none'>Nor this.</p><p aria-hidden=true>Nor that.</p></article>", T),
    "a table and a list": (f"<article>{P}<table><tr><th>Road<th>State<tr><td>A1<td>closed</table><ul><li>one<li>two</ul></article>", [*T, "Road", "State", "A1", "closed", "one", "two"]),
    "a quote and code": (f"<article>{P}<blockquote>Not since 1987.</blockquote><pre>a\n  b</pre></article>", [*T, "Not since 1987.", "a b"]),
    "slug ids": (f"<article><h2 id=search-engines>Search</h2>{P}<section id=related-work><p>See the report.</p></section></article>", ["Search", *T, "See the report."]),
    "open paragraphs": (f"<body>{NAV}<div><h1>Flood</h1><p>{A}<p>{B}<p>{C}</div>{FOOT}", ["Flood", *T]),
    "line breaks": (f"<article><p>one<br>two<br/>three</p>{P}</article>", ["one two three", *T]),
    "breadcrumbs and shares": (f"<article><div class=breadcrumb><a href=/>Home</a> / News</div>{P}<div class='share-links'>Share: <a href=x>post</a></div></article>", T),
    "sections of one article": (f"<body><div id=story><section><p>{A}</p><p>{B}</p></section><section><h2>History</h2><p>{C}</p></section></div>{FOOT}", [A, B, "History", C]),
    "an article in another language": ("<article><p>水位一夜之间上涨了两米，市政府说，三条道路被关闭。</p><p>工程师在黎明时打开了上游闸门。</p></article>", ["水位一夜之间上涨了两米，市政府说，三条道路被关闭。", "工程师在黎明时打开了上游闸门。"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of_a_page(name):
    page, want = PAGES[name]
    assert extract(page) == "\n\n".join(want)


def test_many_broken_quotes_leave_the_text():
    page = "<div>" + "<p x=\">one</p>" * 31 + P + "</div>"
    assert A in extract(page)
