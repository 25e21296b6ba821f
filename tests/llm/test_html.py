import itertools
import random
import re
import time
from html import unescape

from gridlake.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar nav-open">
<header class="site-header"><a href="/">Home</a><p>A long slogan of the site that has many words in it, indeed very many words</p></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this site work for you and for all of our partners, always.</p></div>
<div class="wrap"><article><header><h1>The  title &amp; more</h1></header><p>First &lt;paragraph&gt;&nbsp;with <b>bold</b>, <a href="x">a link</a><br>and a break.<p>Short.</p>
<div class="ad">Buy this now because it is a great thing that you want to have at your home</div><ul><li>item one</li><li>item two</li></ul><!-- <p>no</p> -->
<section id="comments"><p>I think that this article is wonderful and I have so many things to say about it.</p></section></article></div>
<aside><p>Related stories that you may like to read after this one, chosen by our editors for you</p></aside>
<form><p>Sign up for our newsletter with your address and get it every week in your mail box</p></form>
<footer>&copy; 2024 Someone &middot; All rights reserved</footer></body></html>"""


def test_template():
    assert html.main_text(PAGE).split("\n\n") == ["The title & more", "First <paragraph> with bold, a link and a break.", "Short.", "item one", "item two"]


def test_page_without_semantic_elements():
    body = "This is a paragraph of the main text that has quite a lot of words so that it looks like prose, doesn't it?"
    page = f"<body><div><a href=a>Home</a> | <a href=b>About</a></div><div><h2>Head</h2><p>{body}</p><p>Yes.</p><p>{body}</p></div><div>© 2020 Us</div>"
    assert html.main_text(page).split("\n\n") == ["Head", body, "Yes.", body]


def test_cut_is_minimal():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 8)
        u = [r.randrange(-30, 31) for _ in range(n)]
        e = [(i, j, r.randrange(1, 20)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda keep: sum(max(0, v) for v, k in zip(u, keep) if not k) + sum(max(0, -v) for v, k in zip(u, keep) if k) + sum(w for i, j, w in e if keep[i] != keep[j])  # noqa: E731, B023
        assert cost(html.minimum_cut(u, e)) == min(cost(k) for k in itertools.product((False, True), repeat=n))


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        body = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>" + "word " * 30), (3, "u", "<" * 5000 + "<a '" * 2000), (4, "u", "plain text only, without any element at all, but long enough"), (4, "u", "<div>" * 3000 + "deep text that is long enough to be the main text"),
            (5, "u", "<script>never closed " * 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    by = {(r.page_id, r.url): r for r in html.extract(df).collect()}
    assert by[1, None].text == "" and by[2, "u"].n_chars == 0 and by[None, "u"].text == ("word " * 30).strip() and by[5, "u"].text == ""
    assert html.extract(df.where("false")).count() == 0


BODY = "This is a paragraph of the main text that has quite a lot of words so that it looks like prose, doesn't it?"


def flips(page):
    """Texts of blocks whose side the cut changes: kept, and dropped, against the sign of their balance."""
    found, made = html.blocks(page)
    html.weigh(found, made)
    found = [b for b in found if not (b.at and b.at.hidden)]
    balance = [html.balance(b) for b in found]
    keep = html.minimum_cut(balance, html.edges(found))
    return [b.text for b, v, k in zip(found, balance, keep) if k and v < 0], [b.text for b, v, k in zip(found, balance, keep) if not k and v > 0]


def test_the_cut_changes_labels_for_the_better():
    page = f"<body><div><p>{BODY}</p><p>Yes.</p><p><a href=x>Read the whole report here</a></p><p>{BODY}</p><p>© is a sign.</p><p>{BODY}</p></div></body>"
    assert flips(page)[0] == ["Yes.", "Read the whole report here", "© is a sign."]
    assert html.main_text(page).split("\n\n") == [BODY, "Yes.", "Read the whole report here", BODY, "© is a sign.", BODY]
    item = "<li><a href=x>One of the sections</a></li>"
    page = f"<body><ul>{item * 3}<li>Those of our pages that have no link of their own yet</li>{item * 3}</ul><div><p>{BODY}</p><p>{BODY}</p></div></body>"
    assert flips(page)[1] == ["Those of our pages that have no link of their own yet"]
    assert html.main_text(page).split("\n\n") == [BODY, BODY]


def test_the_cut_matters_on_the_table():
    """One- and two-word paragraphs of articles: test_table shows that the results are right."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert sum(len(flips(h or "")[0]) for h in pages) > 50


def test_names_of_wrappers_and_a_form_around_the_page():
    side = "<div class=sidebar><p>A few words about the people who write on this site and why they do it</p></div>"
    for wrap in ("div class='content has-sidebar'", "div class='layout-with-sidebar'", "div class='two-col sidebar-right'", "form action=x"):
        for more in ("", side):
            page = f"<body><nav><a href=a>Home</a></nav><{wrap}><h2>Head</h2><p>{BODY}</p><p>{BODY}</p>{more}</{wrap.split()[0]}><footer>© 2020 Us</footer></body>"
            assert html.main_text(page).split("\n\n") == ["Head", BODY, BODY]
    page = f"<article><h1>T</h1><p>{BODY}</p><section class='related-work'><h2>Related work</h2><p>{BODY}</p><p>Short one.</p><p>{BODY}</p></section><section class='related-posts'><p>{BODY}</p></section></article>"
    assert html.main_text(page).split("\n\n") == ["T", BODY, "Related work", BODY, "Short one.", BODY]


def test_comments_longer_than_the_article():
    comment = f"<li class='comment-body'><p>{BODY} {BODY}</p></li>"
    for where in ("<section id='comments'>", "<div class='comment-list'>", "<div class='post-comments'>"):
        page = f"<body><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div>{where}<ul>{comment * 20}</ul></body>"
        assert html.main_text(page).split("\n\n") == ["Head", BODY, BODY]
    assert html.main_text(f"<body><p>{BODY}</p><div class='sidebar-right'><p>{BODY}</p></div><aside><p>{BODY}</p><p>{BODY}</p></aside></body>") == BODY


def test_deep_pages_take_linear_time():
    t = time.perf_counter()
    assert html.main_text("<div>" * 20_000 + "text " * 50) == ("text " * 50).strip()
    html.main_text("<div>some text here" * 20_000)
    html.main_text("<div><p>some text here</x></b></p>" * 20_000)
    assert time.perf_counter() - t < 6


def test_class_words_are_a_finite_cost():
    body = "This is a paragraph of the main text that has quite a lot of words so that it looks like prose, doesn't it?"
    side = "<div class='widget'><p>A few words about the people who write on this site and why they do it</p></div>"
    for wrap in ('<div id="content-sidebar-wrap">', '<div class="layout has-sidebar">'):
        page = f"<body>{wrap}<div class='col'><h2>Head</h2>{f'<p>{body}</p>' * 6}</div>{side}</div></body>"
        assert html.main_text(page).split("\n\n") == ["Head", *[body] * 6]
    teaser = "<article><h3>Other story</h3><p>What the other story is about, told in some more words than one line has</p></article>"
    page = f"<body><main><article>{f'<p>{body}</p>' * 6}</article></main><section class='related'>{teaser * 3}</section></body>"
    assert html.main_text(page).split("\n\n") == [body] * 6


def test_prose_outweighs_loose_class_words():
    for name in ("elementor-widget elementor-widget-text-editor", "posts", "stories", "rail"):
        page = f"<body><nav><a href=a>Home</a></nav><p>{BODY} Lead.</p><div class='{name}'><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div><footer>© 2020 Us</footer></body>"
        assert html.main_text(page).split("\n\n") == [BODY + " Lead.", BODY, BODY, BODY]
    page = f"<body><div class='posts'><h2>Head</h2><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div><p>{BODY}</p><div class='posts'><ul>{'<li><a href=x>Another story</a></li>' * 5}</ul></div></body>"
    assert html.main_text(page).split("\n\n") == ["Head", BODY, BODY, BODY, BODY]


def test_comments_without_a_telling_name():
    entry = f"<div class='c'><b>Ann</b> <time>2024-05-01 10:30</time><p>{BODY}</p></div>"
    for head, entries in (("<h3>12 responses</h3>", entry * 3), ("<h3>Comments</h3>", entry * 3), ("<p>3 comments on this story</p>", f"<ol>{entry.replace('div', 'li') * 3}</ol>"), ("<h4>2 Kommentare</h4>", entry * 2)):
        page = f"<body><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div><div>{head}{entries}</div></body>"
        assert html.main_text(page).split("\n\n") == ["Head", BODY, BODY]
    page = f"<article><h1>Python</h1><p>{BODY}</p><h2>Comments</h2><p>{BODY}</p><p>{BODY}</p></article>"
    assert html.main_text(page).split("\n\n") == ["Python", BODY, "Comments", BODY, BODY]


def test_raw_text_takes_linear_time():
    t = time.perf_counter()
    assert html.main_text("<script>" + "</script " * 110_000) == "" and html.main_text(f"<p>{BODY}</p><style>" + "</style" * 100_000 + ">") == BODY
    assert time.perf_counter() - t < 1


def test_whole_pages_against_all_cuts():
    """From html to text, with every labelling of a page's blocks tried: the cheapest, and of equal ones the one that keeps most."""
    r = random.Random(7)
    bits = ["<p>{b}</p>", "<p>Short.</p>", "<li><a href=x>Link text</a></li>", "<div class='sidebar'><p>{b}</p></div>", "<h2>Head</h2>", "<div class='widget'><p>{b}</p></div>", "<ul><li>one<li>two words</ul>",
            "<p>© 2020 Us</p>", "<nav><a href=a>Home</a></nav>", "<article><p>{b}</p></article>", "<p hidden>{b}</p>", "<form><p>Your name</p></form>"]
    for _ in range(150):
        body = "".join(r.choice(bits).format(b=" ".join(BODY.split()[: r.randrange(3, 23)])) for _ in range(r.randrange(1, 8)))
        page = f"<body><div>{body}</div></body>"
        found, made = html.blocks(page)
        html.weigh(found, made)
        found = [b for b in found if not (b.at and b.at.hidden)][:11]
        if not found or len(found) > 10:
            continue
        u, e = [html.balance(b) for b in found], html.edges(found)
        cost = lambda keep: sum(max(0, v) for v, k in zip(u, keep) if not k) + sum(max(0, -v) for v, k in zip(u, keep) if k) + sum(w for i, j, w in e if keep[i] != keep[j])  # noqa: E731, B023
        best = min(itertools.product((False, True), repeat=len(u)), key=lambda k: (cost(k), -sum(k)))
        assert html.main_text(page) == "\n\n".join(b.text for b, k in zip(found, best) if k)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{BODY}</p>")] * 3, "page_id long, url string, html string")
    assert [r.text for r in html.extract(df).collect()] == [BODY] * 3
