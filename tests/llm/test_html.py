import html
import random
import time

import pytest

from tabshift.llm.html_text import extract, main_text

P = "The quick brown fox, jumping over the lazy dog, was seen in the garden yesterday, said the owner."
CASES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/>x</a></nav><div class=ad>Buy {P}</div><article><h1>Title</h1><p><b>Bold {P}<br><p>{P}</article><footer>f</footer>", f"Title\nBold {P}\n{P}"),
    "div soup": (f"<body><div id=top><a href=1>Home</a></div><div class='sidebar'><p>{P}</p></div><div class='cookie-notice'><p>{P}</p></div><div class='content with-sidebar'><h1>A &amp; B</h1><p>{P}</p><p>Short.</p><form><p>{P}</p></form><p>Last&nbsp;&#8217;\n x</p></div><section id=comments><p>{P} {P}</p></section></body>", f"A & B\n{P}\nShort.\nLast ’ x"),
    "main with header": (f"<header><h1>Site</h1></header><main><header><h1>Story</h1><p>By Jo</p></header><p>{P}</p><aside>{P}</aside><blockquote>{P}</blockquote></main><div class=related><article><p>{P}</p></article></div>", f"Story\n{P}\n{P}"),
    "short linked titles of an article": (f"<article><p>{P}</p><ul><li><a href=1>One link</a></li><li><a href=2>Foxes</a></li></ul><nav><ul><li><a href=3>Menu</a></li></ul></nav><ul><li>a point</li></ul></article>", f"{P}\nOne link\nFoxes\na point"),
    "menu list outside": (f"<div class=content><p>{P}</p><ul><li><a href=1>One link</a></li><li><a href=2>Two link</a></li></ul><ul><li>a point</li></ul></div>", f"{P}\na point"),
    "names within an article": (f"<article><p class='top'>{P}</p><div class='legal'><p>{P}</p></div><section class='related-work'><p>{P}</p></section><p class='social-history'>{P}</p><div class='related-posts'><p>{P}</p></div><div class='share-buttons'>Share</div><div class='ad-slot'>{P}</div></article>", "\n".join([P] * 4)),
    "names outside an article": (f"<div class='top-bar'><p>{P}</p></div><div class='legal'><p>{P}</p></div><div class='story'><p class='top'>{P}</p><p>{P}</p></div><div class='related-work'><p>{P}</p><p>{P}</p></div>", "\n".join([P] * 4)),
    "two articles": (f"<body><article><h1>A</h1><p>{P}</p><p>{P}</p></article><article><h2>B</h2><p>{P}</p></article><article><a href=1>{P}</a></article></body>", f"A\n{P}\n{P}\nB\n{P}"),
    "siblings": (f"<body><div><p>{P}</p><p>{P}</p></div><div><p>{P}</p></div></body>", f"{P}\n{P}\n{P}"),
    "only boilerplate": ("<nav><a>x</a></nav><footer>f</footer>", ""),
    "bare text": ("just text", "just text"),
    "cut tag": (f"<article><p>{P}<p>half <a href=\"x", f"{P}\nhalf"),
    "comments and cdata": (f"<article><!-- <p>no</p> --><p>{P}</p><![CDATA[no]]></article><!-- open <p>x", P),
    "hidden": (f"<article><p>{P}</p><p hidden>no</p><div style='display: none'>no</div><div aria-hidden=true>no</div></article>", P),
    "references": ("<p>&lt;b&gt; &copy; &#x41;&#66; &amp;amp; &bogus; 1 < 2</p>", "<b> © AB &amp; &bogus; 1 < 2"),
    "upper case and single quotes": (f"<ARTICLE CLASS='x'><P TITLE='a > b'>{P}</P></ARTICLE>", P),
    "linked titles": (f"<article><p>{P}</p><ul><li><a href=1>A long study of foxes in the garden</a></li><li><a href=2>Why lazy dogs were never seen again</a></li></ul></article>", f"{P}\nA long study of foxes in the garden\nWhy lazy dogs were never seen again"),
    "article about comments": (f"<nav><a href=1>x</a></nav><article class='comments-policy'><p>{P}</p><p>{P}</p></article>", f"{P}\n{P}"),
    "comments longer than the article": (f"<div class='story'><p>{P}</p></div><section class='comments'>" + f"<p>{P} {P}</p>" * 9 + "</section>", P),
    "uneven sections": (f"<body><div class=top-bar><a href=1>a</a></div><section><p>{P}</p>" + f"<p>{P}</p>" * 20 + f"</section><p>Short one.</p><section><p>{P}</p></section></body>", "\n".join([P] * 21 + ["Short one.", P])),
    "score decides without names": (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><table><tr><td><a href=3>Three</a></td></tr></table><div><div><p>{P}</p><p>{P}</p></div></div><div><a href=4>Four</a></div></body>", f"{P}\n{P}"),
    "reader comments in the article": (f"<article><p>{P}</p><div class='comment-list'><p>{P}</p></div></article>", P),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_depth_and_length():
    assert main_text("<div>" * 30_000 + f"<p>{P}</p>") == P
    assert main_text("<article>" + f"<p>{P}</p>" * 5000 + "</article>").count("\n") == 4999
    assert main_text("<" * 50_000) is not None and main_text('<a b="' * 20_000) is not None
    assert main_text(None) == main_text("") == ""


@pytest.mark.parametrize("unit", ["<div><p>{}</p>", "<b><i>{}", "<li><div>{}", "</i><b>{}", "<title>{}", " <span> </span>{}"])
def test_time_grows_with_length_not_depth(unit):
    def seconds(n):
        html = "<div><i>" + unit.format("a, b") * n + f"<p>{P}</p>"
        began = time.perf_counter()
        main_text(html)
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(16_000) < 24 * max(seconds(2000), 0.02)


def test_ten_thousand_levels_and_paragraphs():
    assert main_text("<div>" * 10_000 + f"<p>{P}</p>" * 10_000 + "</div>" * 10_000).count("\n") == 9999
    nested = main_text("".join(f"<div><p>{P} {i}</p>" for i in range(10_000)))
    assert nested.count("fox") >= 9_000


def test_query_form(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{P} é</p>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract(pages).filter("page_id = 1").collect())
    assert got == [(1, "u", f"{P} é", len(P) + 2)]
    assert extract(pages).count() == 3 and extract(pages.limit(0)).collect() == []


class Maker:
    """Random pages of which the main text is known, as it is what the article was made of."""

    BOILERPLATE = (
        "<nav><ul><li><a href='/{n}'>{w}</a></li><li><a href='/x'>{w} {w}</a></li></ul></nav>", "<div class='ad'>{t}</div>", "<div id='ad-slot-{n}'><p>{t}</p></div>", "<aside><h3>{w}</h3><p>{t}</p></aside>",
        "<form action='/s'><p>{t}</p><input name=q><button>{w}</button></form>", "<footer><p>{t}</p><a href='/{n}'>{w}</a></footer>", "<script>var a = '<p>{t}</p>';</script>", "<style>p {{ color: red }}</style>", "<!-- <p>{t}</p> -->",
        "<section class='comments'><h3>{w}</h3><p>{t}</p><p>{t}</p></section>", "<div class='cookie-notice'><p>{t}</p></div>", "<div hidden><p>{t}</p></div>", "<div style='display:none'>{t}</div>", "<div role='navigation'><a href=1>{w}</a></div>",
        "<div class=\"newsletter-signup\"><p>{t}</p></div>", "<noscript><p>{t}</p></noscript>", "<ul class='share-buttons'><li>{w}</li></ul>",
    )

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choice("aeioubdklmnrst") for _ in range(self.rng.randrange(2, 9))) + self.rng.choice(["", "", "", "", ",", "é", "&", "<x", "'s"])

    def text(self, low, high):
        return " ".join(self.word() for _ in range(self.rng.randrange(low, high))) + "."

    def written(self, text):
        """The text as markup, with other white space, references and inline elements."""
        out = []
        for word in text.split(" "):
            shown = "".join(f"&#{ord(c)};" if self.rng.random() < 0.03 else html.escape(c) for c in word)
            kind = self.rng.randrange(14)
            out.append(f"<b>{shown}</b>" if kind == 0 else f"<a href='#{shown[:1] if shown[:1].isalnum() else 'x'}'>{shown}</a>" if kind == 1 and self.rng.random() < 0.3 else f"<span class='top'>{shown}</span>" if kind == 2 else shown)
        return self.rng.choice(["", "\n  "]) + "".join(w + self.rng.choice([" ", " ", "\n", "<br>", "&nbsp;", "  "]) for w in out[:-1]) + out[-1] + self.rng.choice(["", " \n"])

    def boilerplate(self):
        return self.rng.choice(self.BOILERPLATE).format(n=self.rng.randrange(99), w=html.escape(self.word()), t=html.escape(self.text(5, 40)))

    def blocks(self, inside):
        """(markup, texts) of an article's body; ``inside`` puts boilerplate between its blocks."""
        markup, texts = [], []
        for _ in range(self.rng.randrange(3, 12)):
            kind = self.rng.choice(["p"] * 5 + ["h2", "blockquote", "pre", "ul", "open"])
            own = [self.text(12, 60) for _ in range(self.rng.randrange(2, 5) if kind == "ul" else 1)]
            if kind == "h2":
                own = [self.text(2, 6)]
            texts += own
            shown = [self.written(t) for t in own]
            markup.append("<ul>" + "".join(f"<li>{t}</li>" for t in shown) + "</ul>" if kind == "ul" else f"<p class=lead>{shown[0]}" if kind == "open" else f"<{kind}>{shown[0]}</{kind}>")
            if inside and self.rng.random() < 0.2:
                markup.append(self.boilerplate())
        return "".join(markup), texts

    def page(self):
        title = self.text(2, 6)
        frame = self.rng.choice(["<article>{}</article>", "<main>{}</main>", "<div><main><article class='post'>{}</article></main></div>", "<div class='content'>{}</div>"])
        body, texts = self.blocks(inside="article" in frame)
        around = [self.boilerplate() for _ in range(self.rng.randrange(1, 6))]
        at = self.rng.randrange(len(around) + 1)
        inner = frame.format(f"<h1>{self.written(title)}</h1>{body}")
        return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><header><a href='/'>Site</a></header>{''.join(around[:at])}{inner}{''.join(around[at:])}</body></html>", "\n".join(" ".join(t.split()) for t in [title, *texts])


@pytest.mark.parametrize("seed", range(8))
def test_random_pages_give_back_what_they_were_made_of(seed):
    maker = Maker(seed)
    for i in range(60):
        page, want = maker.page()
        assert main_text(page) == want, (seed, i, page)
