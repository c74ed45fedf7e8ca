"""Main text of pages by tag-path ratios: what the ratio decides, and pages made to be hard."""

import random
import re
import time

import pytest

from cadenza.llm import html_text
from cadenza.llm.html_text import main_text

LONG = "A sentence of the text, which goes on for a while, and then ends. " * 4


def test_one_bad_block_does_not_empty_its_path():
    for bad in ("<p hidden>x</p>", '<p id="share"></p>', '<p aria-hidden="true">x</p>', '<p role="alert">x</p>', '<p class="ad">Buy now.</p>'):
        page = f"<article><h1>Title</h1><p>First, good.</p>{bad}<p>Second, good text here.</p></article>"
        assert main_text(page) == "Title\nFirst, good.\nSecond, good text here."


def test_inline_adverts_and_hidden_text_are_cut_out():
    page = f'<article><p>{LONG}<span class="ad">Buy <span>cheap</span> pills</span>end.</p><p>One <b hidden>secret</b>two <span class="comment">three</span>.</p></article>'
    assert main_text(page) == f"{LONG}end.\nOne two three."


def test_names_lower_a_ratio_but_do_not_decide():
    page = f"""<body><article><header><h1>Title</h1></header><p>{LONG}</p><section class="legal-analysis"><h2>Law</h2><p>{LONG}</p></section>
    <div class="related-work"><p>Others did it too, in 2019.</p></div></article><div class="related-posts"><ul><li><a href=/>One more post</a></li><li><a href=/>Another post</a></li></ul></div></body>"""
    assert main_text(page).split("\n") == ["Title", LONG.strip(), "Law", LONG.strip(), "Others did it too, in 2019."]
    # A name on the whole page lowers all alike.
    assert main_text(f'<body><div class="menu-open cookie"><h1>T</h1><p>{LONG}</p></div></body>').endswith(LONG.strip())


@pytest.mark.parametrize("short_first", [True, False])
def test_two_articles(short_first):
    parts = ["<article><p>Second words, a few.</p></article>", f"<article><p>{LONG}</p><p>{LONG}</p></article>"]
    got = main_text("<body>" + "".join(parts if short_first else parts[::-1]) + "</body>")
    assert "Second words, a few." in got and got.count("A sentence") == 8


PLAIN = f"""<body><div id=top><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul></div>
<div id=x1><h1>The title</h1><p>{LONG}</p><p>{LONG}</p><p>Of.</p><table><tr><td>5</td><td>6</td></tr></table><p>{LONG}</p></div>
<div id=x2><span>Links</span><br><a href=/d>Old</a> <a href=/e>Older</a></div><div>Powered by words</div></body>"""


def test_pages_without_elements_or_names_are_decided_by_the_ratio():
    want = ["The title", LONG.strip(), LONG.strip(), "Of.", "5", "6", LONG.strip()]
    assert main_text(PLAIN).split("\n") == want


def test_ratio_decides(monkeypatch):
    page = html_text.Page(PLAIN)
    assert len(html_text.content(page, [1.0] * len(page.blocks))) == len(page.blocks) > len(main_text(PLAIN).split("\n"))
    monkeypatch.setattr(html_text, "CORE", 0.0)
    monkeypatch.setattr(html_text, "LEAST", 0.0)
    assert "Powered by words" in main_text(PLAIN)


def test_unlabelled_comments():
    page = f"<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><h3>3 Comments</h3><div><p>{LONG}</p></div><div><p>I disagree, strongly.</p></div></div></body>"
    assert main_text(page) == f"Title\n{LONG.strip()}\n{LONG.strip()}"
    # A section of the text with such a title at its beginning is none.
    page = f"<article><h2>Comments</h2><p>{LONG}</p><p>{LONG}</p></article>"
    assert main_text(page).startswith("Comments\n")


def test_references_white_space_and_odd_markup():
    assert main_text("<p>A &amp; B&nbsp;&lt;c&gt;,\n\t d<br>e.") == "A & B <c>, d e."
    assert main_text("1 < 2, and 3 > 2.") == "1 < 2, and 3 > 2."
    assert main_text("<p title='a > b'>Text, here.</p><!-- <p>no</p> --><p>More text.<!doctype x><? y ?></p>") == "Text, here.\nMore text."
    assert main_text("<ul><li>One, two<li>Three, four<ul><li>Five, six</ul><li>Seven.</ul>") == "One, two\nThree, four\nFive, six\nSeven."
    assert main_text("<p>Text.<!-- never closed <p>x") == "Text." and main_text("<p>Text.<p a=\"x><p>y") == "Text."
    assert main_text("") == main_text("<nav>Home</nav>") == main_text("   ") == ""


@pytest.mark.parametrize("unit", ['<a "', "<div>x y, z.", "<", "<!--", "<p a=\"'", "<div></x>", "<li>a.", "&", "<script>", "</p>", "<span class=ad>"])
def test_long_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15  # a second or two when nothing else runs


TITLE = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
WANT = f"T\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm"><div>{TITLE}</div></form>',
    f"<form><p>Sign in, please.</p><label>Name, please <input></label></form><div>{TITLE}</div>",
    f"<section><header><p>Site header, welcome.</p></header></section><article>{TITLE}</article>",
    f"<header><h1>Site</h1><p>Welcome, reader.</p></header><div>{TITLE}</div>",
    f"<div id=page><div id=header><a href=/>Site name</a><p>Since 1999, in print.</p></div><div>{TITLE}</div></div>",
    f"<div><p>We use cookies to improve your experience, see our policy.</p><button>OK</button></div><div>{TITLE}</div>",
    f"<div>{TITLE}</div><div><p>Buy our magazine, today.</p></div>",
    f"<div>{TITLE}</div><div><b>Bob</b><p>Great article, thanks a lot!</p></div><div><b>Ann</b><p>I agree.</p></div>",
    f"<article>{TITLE}</article><div><b>Bob</b><p>Great article, thanks a lot!</p></div>",
    f"<article>{TITLE}<h2>Comments</h2><div><p>Bob: nice, that.</p></div></article>",
    f"<article>{TITLE}<h3>3 comments</h3><p>Bob: nice, that.</p></article>",
    f"<article>{TITLE}<label>Name, please <input></label></article>",
    f"<div class=search><p>Find it, here, in our large archive.</p></div><div>{TITLE}</div>",
])
def test_what_stands_around_a_text_goes(page):
    assert main_text(f"<body>{page}</body>") == WANT


@pytest.mark.parametrize("page,want", [
    (f'<article><div class="entry-header"><h1>Headline</h1></div><p>{LONG}</p></article>', ["Headline", LONG]),
    (f'<div class="article"><header><h1>Headline</h1></header><div><p>{LONG}</p></div></div>', ["Headline", LONG]),
    (f'<div><div class="entry-header"><h1>Headline</h1></div><p>{LONG}</p></div>', ["Headline", LONG]),
    (f"<article><h1>T</h1><p>{LONG}</p><h2>Comments</h2><p>The commission published its comments, in full, on Monday.</p></article>", ["T", LONG, "Comments", "The commission published its comments, in full, on Monday."]),
    (f"<div><h1>T</h1><div><p>The lead, short.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div>", ["T", "The lead, short.", LONG, LONG]),
    (f"<div><h1>T</h1><div class=s><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=s><h2>End</h2><p>Short.</p></div></div>", ["T", LONG, LONG, LONG, "End", "Short."]),
    (f"<div><h1>T</h1><p>{LONG}</p><div><pre>x = 1</pre><button>Copy</button></div><p>{LONG}</p></div>", ["T", LONG, "x = 1", LONG]),
])
def test_what_belongs_to_a_text_stays(page, want):
    assert main_text(f"<body>{page}</body>").split("\n") == [w.strip() for w in want]


def made_page(draw, n, named):
    """A page of a made-up site and its text, which is known; with or without the names and elements that say what is what."""
    sentence = lambda k: " ".join(f"word{draw.randrange(500)}" for _ in range(k)) + ", and so on."
    body = [f"Title {n}", *[" ".join(sentence(draw.randint(8, 20)) for _ in range(draw.randint(2, 4))) for _ in range(draw.randint(2, 9))]]
    text = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
    tag = lambda name, plain, attributes="": (f"<{name}{attributes}>", f"</{name}>") if named else (f"<{plain}>", f"</{plain}>")
    links = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(draw.randint(3, 8)))
    wrap = lambda pair, inner: pair[0] + inner + pair[1]
    parts = [
        wrap(tag("nav", "div"), f"<ul>{links}</ul>"), wrap(tag("div", "div", ' class="notice"'), f"<p>{sentence(6)}</p><button>OK</button>"), wrap(tag("article", "div"), text),
        wrap(tag("div", "div", ' class="comments"'), f"<h3>2 Comments</h3><div><b>Bob</b><p>{sentence(5)}</p></div><div><b>Ann</b><p>{sentence(4)}</p></div>"),
        wrap(tag("aside", "div"), f"<p>{sentence(5)}</p>"), wrap(tag("footer", "div"), "Imprint of the site"),
    ]
    return "<html><body>" + "".join(parts) + "</body></html>", "\n".join(body)


@pytest.mark.parametrize("named", [True, False])
def test_all_pages_of_a_made_up_site(named):
    draw = random.Random(8)
    pages = [made_page(draw, n, named) for n in range(200)]
    assert [main_text(p) for p, _ in pages] == [w for _, w in pages]
    if not named:  # without names the ratio decides: a constant one is wrong on every page
        parsed = [html_text.Page(p) for p, _ in pages]
        assert not any("\n".join(p.blocks[k][1] for k in html_text.content(p, [1.0] * len(p.blocks))) == w for p, (_, w) in zip(parsed, pages))


def test_given_pages_without_classes(sf_dir, spark):
    """Stripped of classes and ids the given pages have the same text, which a constant ratio does not find."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect() if r["html"]]
    bare = [re.sub(r'\s(class|id)="[^"]*"', "", p) for p in pages]
    same = sum(main_text(a) == main_text(b) for a, b in zip(pages, bare))
    parsed = [html_text.Page(p) for p in bare]
    constant = sum("\n".join(p.blocks[k][1] for k in html_text.content(p, [1.0] * len(p.blocks))) == main_text(a) for p, a in zip(parsed, pages))
    assert same >= 0.98 * len(pages) and constant <= 0.02 * len(pages)
