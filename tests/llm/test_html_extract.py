import random

import pytest

from plumbline.llm import html_extract
from plumbline.llm.html_extract import extract

PAGES = [
    ("<article><h1>T</h1><p><b>One &amp; two.<br><p>Three,\n  four.</p></article><footer>f</footer>", "T One & two. Three, four."),
    ("<nav>menu</nav><div class='ad'>Buy now.</div><article><p>x.</article>", "x."),
    ("<script>var t='</p><p>no';</script><p>Yes, this.</p>", "Yes, this."),
    ("plain text & more\n here", "plain text & more here"),
    ("<div id=main><p>Long text, with commas, and more, so it scores.</p><div class='comments'><p>Nice, post, thanks, a lot.</p></div></div><aside>side</aside>", "Long text, with commas, and more, so it scores."),
    ("<article>a<b>b</b>c<p>d<li>e<li>f</article>", "abc d e f"),
    ("<article><header><h1>Title</h1></header><p>Body.</p><form><input>sign up</form></article>", "Title Body."),
    ("<body><header>site</header><main><p>One.</p><p>Two.</p></main><div role=dialog>cookies</div></body>", "One. Two."),
    ("<nav>only a menu</nav>", ""),
    ("<!-- c --><article><p>a<!-- <p>no --> b</p></article>", "a b"),
    ("<article><p title='a>b'>q</p></article>", "q"),
    ("<article><p>x &lt;b&gt; &#8364; &nosuch;</p></article>", "x <b> € &nosuch;"),
    ("", ""),
    (" \n", ""),
    ("<p", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert extract(page) == want


WHOLE = [
    ("<html><head><title>t</title><body><article><p>Text.</p></article></body></html>", "Text."),
    ("<head><meta charset=x><title>t</title><script>a<b</script><p>Text, more.<p>Again.", "Text, more. Again."),
    ("<head><title>t</title>\nPlain text.", "Plain text."),
    ("<html><head><title>t</title></head><body><head><link></head><p>One.</p></body></html>", "One."),
    ("<body><div id='content' class='with-sidebar'><article><p>Text.</p></article></div></body>", "Text."),
    ("<div id='content' class='with-sidebar'><p>The text, and more.</p><div class='sidebar'><p>Side.</p></div></div>", "The text, and more."),
    ("<div class='page nav-open'><div class='nav'><a>x</a></div><p>The text, and more.</p></div><footer>© 2020.</footer>", "The text, and more."),
    ("<div class='single comments-open'><article><p>Short.</p></article><div class='comments'><p>Long, long, long comment.</p></div></div>", "Short."),
    ("<div class='no-header'><p>The text, and more.</p></div>", "The text, and more."),
]


@pytest.mark.parametrize(("page", "want"), WHOLE)
def test_pages_kept_whole(page, want):
    assert extract(page) == want


STILL_CUT = [
    ("<div><p>Short, text.</p></div><div class='comments'><article class='comment-body'><p>" + "Long, comment. " * 9 + "</p></article></div>", "comment"),
    ("<article><p>Short.</p></article><div class='related'><article><p>" + "Other, text. " * 9 + "</p></article></div>", "Other"),
    ("<article><p>Short.</p></article><div class='sidebar'><p>" + "Other, text. " * 9 + "</p></div>", "Other"),
    ("<div class='cookie-notice'><p>We use cookies.</p></div>", "cookies"),
    ("<div class='ad'>Buy now.</div>", "Buy"),
]


@pytest.mark.parametrize(("page", "word"), STILL_CUT)
def test_boilerplate_stays_cut(page, word):
    assert word not in extract(page)


#: Pages whose main text a rule for boilerplate might take, or whose boilerplate might pass for text.
CONTRACT = [
    ("<article><p>Body text, here.</p></article><article class='comment'><p>Nice post.</p></article>", "Body text, here."),
    ("<article hidden><p>Hidden, hidden, hidden, and long enough to win.</p></article><div><p>Seen, text.</p></div>", "Seen, text."),
    ("<main aria-hidden='true'><p>Hidden, hidden, hidden.</p></main><article><p>Seen, text.</p></article>", "Seen, text."),
    ("<article><p>Text, here.</p><div class='cookie-content'><p>We use cookies.</p></div><div class='newsletter-text'>Sign up.</div><div class='social-post'>Follow us.</div></article>", "Text, here."),
    ("<article><p>A sentence with <a class='social' href='x'>linked words</a> in it.</p></article>", "A sentence with linked words in it."),
    ("<article><p>Text.</p><a class='share' href='x'>Share this</a><p><span class='ad'>Buy now</span></p></article>", "Text."),
    ("<article><p>One.</p></article><article><p>Two, which is longer, and scores more.</p></article>", "One. Two, which is longer, and scores more."),
    ("<div><p>A long paragraph, with commas, and more, so that it scores best.</p></div><div><ul><li>An item.</li></ul></div><div>Tail.</div>", "A long paragraph, with commas, and more, so that it scores best. An item. Tail."),
    ("<div><p>A long paragraph, with commas, and more, so that it scores best.</p></div>Free text.<div><a href='x'>Home</a> <a href='y'>About</a></div>", "A long paragraph, with commas, and more, so that it scores best. Free text."),
    ("<article class='post comments-open with-sidebar'><p>Text.</p></article>", "Text."),
    ("<article id='comment-7'><p>A comment, a long one, with many, many words.</p></article><article><p>Text.</p></article>", "Text."),
    ("<main class='content sidebar-left'><p>The text, and more.</p></main><div class='sideBar'>x</div>", "The text, and more."),
    ("<article><p>Text.</p><section class='userComments'><article><p>First, first, first.</p></article></section></article>", "Text."),
]


@pytest.mark.parametrize(("page", "want"), CONTRACT)
def test_contract(page, want):
    assert extract(page) == want


def generated(rng):
    """A page made of an article and boilerplate, and the article's text."""
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(99))
    words = lambda n: " ".join(word() for _ in range(n))
    want = []

    def block():
        kind = rng.randrange(7)
        text = words(rng.randrange(4, 40)) + rng.choice([".", ", and so on.", "!"])
        if kind == 0:
            a, b = word(), word()
            want.append(f"{text} {a} {b} end.")
            cls = rng.choice(["", " class='social'", " class='ext related'", " rel='x'"])
            return f"<p>{text} <a href='/x'{cls}>{a}</a>\n\t<b>{b}</b> end." + rng.choice(["</p>", ""])
        if kind == 1:
            items = [words(rng.randrange(2, 6)) for _ in range(3)]
            want.extend(items)
            return "<ul>" + "".join(f"<li>{x}" + rng.choice(["</li>", ""]) for x in items) + "</ul>"
        if kind == 2:
            want.append(text)
            return f"<h2>{text}</h2>"
        if kind == 3:
            want.append(text + " & <x> \u20ac")
            return f"<blockquote>{text} &amp; &lt;x&gt; &#8364;</blockquote>"
        if kind == 4:
            cells = [words(2) for _ in range(4)]
            want.extend(cells)
            return f"<table><tr><td>{cells[0]}<td>{cells[1]}</tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
        want.append(text)
        return f"<p>{text}" + rng.choice(["</p>", "", "<!-- <p>not this</p> --></p>"])

    head, body = block(), "".join(block() for _ in range(rng.randrange(2, 9)))
    junk = [
        "<nav><ul>" + "".join(f"<li><a href='/{k}'>{word()}</a></li>" for k in range(5)) + "</ul></nav>",
        f"<div class='ad'>{words(9)}.</div>",
        f"<aside><p>{words(30)}.</p></aside>",
        f"<div class='{rng.choice(['sidebar', 'related-posts', 'cookie-notice', 'newsletter', 'social-share'])}'><p>{words(25)}, {words(9)}.</p></div>",
        f"<script>var x = '<p>{words(3)}</p>';</script>",
        f"<form><label>{words(3)}</label><input><button>{word()}</button></form>",
        f"<section id='comments'><p>{words(20)}.</p><article class='comment'><p>{words(20)}, {words(10)}.</p></article></section>",
        f"<div role='dialog'>{words(12)}</div>",
        f"<p hidden>{words(8)}</p>",
        f"<div style='display: none'>{words(8)}</div>",
    ]
    rng.shuffle(junk)
    cut = rng.randrange(len(junk))
    tag, attrs = rng.choice([("article", ""), ("article", " class='post comments-open'"), ("main", ""), ("div", " class='post-content'"), ("div", " id='content' class='with-sidebar'"), ("div", "")])
    first = rng.choice(["", "<header><h1>Site</h1></header>", f"<div class='page-header'>{word()}</div>"])
    inner = head + body + (rng.choice(junk) if tag == "article" else "")
    wrap = rng.choice(["{}", "<div class='page nav-open'>{}</div>", "<div><div>{}</div></div>"])
    page = wrap.format(first + "".join(junk[:cut]) + f"<{tag}{attrs}>{inner}</{tag}>" + "".join(junk[cut:]))
    start = rng.choice(["<!DOCTYPE html><html><head><title>t</title></head><body>", "<html><head><title>t</title><body>", ""])
    return start + page + f"<footer>{words(6)}.</footer>" + rng.choice(["</body></html>", ""]), " ".join(want)


def test_generated_pages():
    rng = random.Random(12)
    for k in range(600):
        page, want = generated(rng)
        assert extract(page) == want, (k, page)


def test_odd_pages():
    assert extract(None) == ""
    assert extract("<div>" * 20_000 + "deep, text" + "</div>" * 20_000) == "deep, text"
    assert extract("<article><p>" + "word, " * 100_000 + "</article>") == ("word, " * 100_000).strip()
    assert extract("<a" * 50_000) == ""
    assert extract("<p x='" + "y" * 100_000) in ("", "y" * 100_000)


def test_query_form(spark):
    df = spark.createDataFrame([(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (2, None, None, "y"), (None, "v", "<p>é</p>", None)], "page_id bigint, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extracted(df).collect()), key=str)
    assert got == sorted([(1, "u", PAGES[0][1], len(PAGES[0][1]))] * 2 + [(2, None, "", 0), (None, "v", "é", 1)], key=str)
    assert html_extract.extracted(df.limit(0)).count() == 0
