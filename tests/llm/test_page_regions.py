"""Pages whose article has several parts, or no article element at all, and pages of odd markup."""

import random

import numpy as np

from veritick.llm import html_text

LONG = "This is a sentence of the article that goes on for quite a while, with commas, and with more words in it. " * 3


def page(body):
    links = "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(8))
    return f"<html><body><nav><ul>{links}</ul></nav>{body}<footer><p>Imprint</p></footer></body></html>"


def test_pages_keep_all_of_the_article():
    a, b, c = (LONG + x for x in "abc")
    wrapped = page(f"<div><h1>Title</h1><p>Lead.</p><div><p>{a}</p><p>{b}</p></div><p>The end.</p></div>")
    assert html_text.extract(wrapped).split("\n") == ["Title", "Lead.", a, b, "The end."]
    two = page(f"<article><p>{a}</p><p>{b}</p></article><article><p>{c}</p></article>")
    assert html_text.extract(two).split("\n") == [a, b, c]
    beside = page(f"<main><p>{a}</p><article><p>{b}</p><p>{c}</p></article><p>Closing.</p></main>")
    assert html_text.extract(beside).split("\n") == [a, b, c, "Closing."]


def plain_page():
    """No article, no main, and no names that tell boilerplate."""
    links = "".join(f"<li><a href='#'>link {i}</a></li>" for i in range(12))
    a, b = LONG + "a", LONG + "b"
    return f"<html><body><div><ul>{links}</ul></div><div><div><h1>Title</h1><p>{a}</p><p>Short.</p><p>{b}</p><ul><li>one</li></ul><p>Bye.</p></div><div><ul>{links}</ul></div></div></body></html>", a, b


def test_clusters_decide_without_article_elements(monkeypatch):
    html, a, b = plain_page()
    want = ["Title", a, "Short.", b]
    got = html_text.extract(html).split("\n")
    assert got[:4] == want and not any("link" in x for x in got)
    monkeypatch.setattr(html_text, "content_lines", lambda ratio: (np.ones(len(ratio), dtype=bool),) * 2)
    assert sum("link" in x for x in html_text.extract(html).split("\n")) == 24


def test_clusters_choose_among_articles(monkeypatch):
    teasers = "".join(f"<article><a href='#'><b>More</b></a> <a href='#'><i>here {i}</i></a></article>" for i in range(8))
    html = page(f"<div>{teasers}</div><article><h1>Title</h1><p>{LONG}a</p><p>{LONG}b</p></article><div>{teasers}</div>")
    assert html_text.extract(html).split("\n") == ["Title", LONG + "a", LONG + "b"]
    monkeypatch.setattr(html_text, "content_lines", lambda ratio: (np.ones(len(ratio), dtype=bool),) * 2)
    assert "here 3" in html_text.extract(html)


def test_forms_headers_names_and_odd_markup():
    a, b = LONG + "a", LONG + "b"
    form = page(f"<form><article><p>{a}</p><input value='x'><button>Go</button><select><option>one</option></select><label>Name</label><p>{b}</p></article></form>")
    assert html_text.extract(form).split("\n") == [a, b]
    bare = f"<html><body><form action='x'><div><p>{a}</p><p>{b}</p><button>Go</button></div></form></body></html>"
    assert html_text.extract(bare).split("\n") == [a, b]
    inner = page(f"<article><p>{a}</p><form>Sign up <input></form><p>{b}</p></article>")
    assert html_text.extract(inner).split("\n") == [a, b]
    deep = page(f"<article>{'<div>' * 9}<header><h1>Title</h1></header><p>{a}</p>{'</div>' * 9}</article>")
    assert html_text.extract(deep).split("\n") == ["Title", a]
    named = page(f"<article><h2 id='related-work'>Related</h2><p class='ad-hoc'>{a}</p><p class='notice'>{b}</p><h3 id='notice'>N</h3><section id='related-work'><p>{a}</p></section><div class='related-posts'><p>{b}</p></div></article>")
    assert html_text.extract(named).split("\n") == ["Related", a, b, "N", a]
    assert html_text.extract("<p>x</p><![foo[bar]]><p>y</p>") == "x\ny"
    assert html_text.extract("<p>x</p><![foo") == "x"
    rnd = random.Random(5)
    parts = ["<p>", "</p>", "<div class='ad'>", "</div>", "<![x[", "]]>", "<!", "<?", "<!--", "-->", "&#x110000;", "&lt", "<article>", "</article>", "<form>", "</form>", "<b", " text ", "<table><tr><td>", "</table>", "<script>", "</script>", "\x00", "<a href=\"", "<li>", "<svg/>"]
    for _ in range(3000):
        html_text.extract("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))))
    assert html_text.extract("<b>" * 20_000 + "</i>" * 20_000 + "<p>z") == "z"


def test_comment_lists_and_boilerplate_paragraphs_go():
    body = "".join(f"<p>Paragraph {i} of the article has a good many words to tell its readers about.</p>" for i in range(4))
    for extra in (
        '<ol class="commentlist"><li>First! I liked this one a lot, thank you so much for it.</li></ol>', '<div id="usercomments"><p>A reader says that this is not so at all.</p></div>',
        '<ul class="comment-list"><li>Another reader with an opinion of some length.</li></ul>', '<p class="comment">A reader remarks that the second paragraph is wrong.</p>', '<p class="advert">Buy one, get the second for half the price today only.</p>',
    ):
        for page in (f"<body><article>{body}{extra}</article></body>", f"<body><article>{body}</article>{extra}</body>", f'<body><div class="x1">{body}{extra}</div></body>'):
            got = html_text.extract(page)
            assert got.split("\n") == [f"Paragraph {i} of the article has a good many words to tell its readers about." for i in range(4)], (extra, page)
    kept = html_text.extract(f'<article>{body}<p class="comment-policy-note">Kept, as other words are in its name.</p><pre><span class="comment"># code stays</span></pre></article>')
    assert "Kept, as other" in kept and "# code stays" in kept
