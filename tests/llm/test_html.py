"""Main text: the tokenizer, what a name may drop, siblings, and a vote that decides."""

import re
from html import unescape

import pytest
from assayframe.llm import html_main

PROSE = "a sentence of some words that makes up prose. " * 4
P = re.sub(r"\s+", " ", PROSE).strip()
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<body><p data-x=don't>one {PROSE}</p><p>two</p>", f"one {P} two"),
        (f'<p title="a > b" class=x>one</p><p a=\'"\'>{PROSE}', f"one {P}"),
        (f"<p a = 'x' b=\"y>z\" c>{PROSE}</p>", P),
        ("a < b <ok &lt;x&gt; &am <> </ x>", "a < b"),
        (f"<!-- <p>no</p> --!><!--><p>{PROSE}<!-- open <p>no", P),
        (f"<script>var a='</p>'; if (a<b) x</script><style>p</style><p>{PROSE}<noscript>no</noscript>", P),
        (f"<header>site</header><article><header><h1>Title</h1></header><p>{PROSE}</p><footer>f</footer></article><footer>x</footer>", f"Title {P}"),
        (f"<nav>n</nav><div class=post><div class=intro>{PROSE}</div><div class=body>{PROSE * 4}</div><div>{PROSE}</div></div>", " ".join([P] * 6)),
        (f"<article><h1>T</h1><p>lead</p><section><p>{PROSE}</p></section><section><p>{PROSE}</p></section></article>", f"T lead {P} {P}"),
        (f'<div class="two side"><p>{PROSE}</p></div><div class="side">other</div>', P),
        (f'<article><p>{PROSE}</p><section id="related-work"><p>{PROSE}</p></section><div class="related"><a href=x>see also</a></div></article>', f"{P} {P}"),
        (f"<article><p>{PROSE} <math><mi>x</mi></math> end</p></article>", f"{P} x end"),
        (f'<article><p>short</p></article><section id="comments"><p>{PROSE * 9}</p></section>', "short"),
        (f'<div class=content><p>short</p><article class="comment"><p>{PROSE}</p></article></div>', "short"),
        (f"<form id=f><div class=c><p>{PROSE}</p></div><input></form>", P),
        (f"<div><p>{PROSE}</p></div><form><label>Name</label><p>Give your mail</p></form>", P),
        (f"<div><p>{PROSE}a<span class='ad'>BUY</span>b <a href=x>c</a>d</p></div>", f"{P} ab cd"),
        (f"<h1>Head</h1><p>{PROSE}<div class=cookie-notice>We use cookies</div><div role=navigation>x</div><div hidden>y</div>", f"Head {P}"),
        (f"<div id=main><p>{PROSE}</p><table><tr><td>a<td>b<tr><td>{PROSE}</table></div>", f"{P} a b {P}"),
        (f"<ul><li>one {PROSE}<li>two</ul>", f"one {P} two"),
        ("<nav>x</nav>", ""),
        ("<div class='a <p>x", ""),
        ("", ""),
        (None, ""),
        ("one &nbsp; two<br>three", "one two three"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_page(source, text):
    assert html_main.main_text(source, None) == text


WORDS = "discussion editor-comments-on-law modal-verbs head sharing navigation header notice banner social comments alert related footer-notes toc side".split()


@pytest.mark.parametrize("around", ["article", "main", "div"])
@pytest.mark.parametrize("word", WORDS)
def test_sections_with_names_of_furniture_stay(around, word):
    """Sections, headings and heads of an article whose class or id is an ordinary word."""
    section = f'<section id="{word}"><h2>Part</h2><p>{PROSE * 4}</p></section>'
    source = f'<body><nav>n</nav><{around}><h1>Title</h1><p>{PROSE}</p>{section}</{around}></body>'
    # Without an article, a whole name of furniture stands for what it says, unless it holds most of the page.
    if around == "article" or word != "comments":
        assert html_main.main_text(source, None) == f"Title {P} Part " + " ".join([P] * 4)
    heading = f'<body><{around}><h1 class="{word}">Title</h1><p>{PROSE}</p><h2 id="{word}">Part</h2><p>{PROSE}</p></{around}></body>'
    assert html_main.main_text(heading, None) == f"Title {P} Part {P}"


def test_heads_and_leads_of_an_article():
    for word in ("header", "head", "masthead", "banner"):
        source = f'<article><div class="{word}"><h1>Title</h1><p>lead</p></div><p>{PROSE}</p></article>'
        assert html_main.main_text(source, None) == f"Title lead {P}"
    assert html_main.main_text(f'<article><p>{PROSE}</p><section class="head"><p>{PROSE}</p></section></article>', None) == f"{P} {P}"


def test_furniture_in_an_article_goes():
    small = '<div class="ad">Buy now</div><div class="share-buttons"><a href=x>Share</a></div><div class="newsletter-box">Sign up</div><div class="related"><a href=a>one</a> <a href=b>two</a></div>'
    assert html_main.main_text(f"<article><h1>T</h1><p>{PROSE * 2}</p>{small}<p>{PROSE}</p></article>", None) == f"T {P} {P} {P}"
    posts = "".join(f'<div class="post{i}"><p>{PROSE * 3}</p></div>' for i in range(3))
    for section in (f'<section id="comments">{posts}</section>', f'<div class="comment-list">{posts}</div>', f'<section id="comments"><p>{PROSE * 3}</p><form><input></form></section>'):
        assert html_main.main_text(f"<article><h1>T</h1><p>{PROSE}</p>{section}</article>", None) == f"T {P}"
        assert html_main.main_text(f"<article><h1>T</h1><p>{PROSE}</p></article>{section}", None) == f"T {P}"


def test_generated_articles(spark):
    """Against the text that was put in, on pages of made-up classes, with and without an article element."""
    import random

    rng, rows, want = random.Random(4), [], {}
    for i in range(120):
        parts, text = [f"<h1 id={rng.choice(WORDS)}>Title {i}</h1>"], [f"Title {i}"]
        for k in range(rng.randint(2, 6)):
            own = f"{k} {PROSE * rng.randint(1, 5)}"
            parts.append(f'<section class="{rng.choice(WORDS)}-{rng.choice(("rules", "verbs", "law"))}"><h2 class="{rng.choice(WORDS)}">Part {k}</h2><p>{own}</p></section>')
            text += [f"Part {k}", re.sub(r"\s+", " ", own).strip()]
        around = rng.choice(("article", "main", "div"))
        rows.append((i, f"http://g{i % 7}.example/{i}", f'<body><nav><a href=x>menu</a></nav><div class="sidebar"><a href=y>more</a></div><{around}>{"".join(parts)}</{around}><footer>f</footer></body>'))
        want[i] = " ".join(text)
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_long_attributes_are_read_once():
    assert html_main.main_text("<p" + " a" * 200_000, None) == ""
    assert html_main.main_text("<p>x" + "<p a='" * 20_000, None) == "x"


def page(body, junk=""):
    return f'<body><div class="top7"><div class="text3">{body}</div><div class="extra">{junk}</div></div></body>'


@pytest.fixture(scope="module")
def voted(spark):
    """Most pages of a host have a long text; on one the furniture, which no name gives away, outweighs it."""
    rows = [(i, f"http://Host.example/{i}", page(f"<p>{PROSE * 6} {i}</p>"), "x", 1) for i in range(8)]
    rows.append((8, "http://host.example/8", page("<p>A short article.</p>", "<p>Terms of the house apply.</p>"), "x", 1))
    rows.append((9, "http://other.example/9", page("<p>A short article.</p>", "<p>Terms of the house apply.</p>"), "x", 1))
    # The host's path holds a caption on this page, and the article stands elsewhere.
    rows.append((10, "http://host.example/10", f'<body><div class="top"><div class="text">caption</div></div><main><p>{PROSE * 6}</p></main></body>', "x", 1))
    rows += [(11, None, page("<p>Alone one.</p>"), "x", 1), (12, "http://[", page("<p>Alone two.</p>"), "x", 1), (None, "http://host.example/0", None, "x", 1)]
    rows += [rows[0]] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths int").repartition(3)


def test_the_vote_decides(voted):
    got = {r.page_id: r.text for r in html_main.extract(voted).collect()}
    assert html_main.extract(voted).count() == voted.count()
    assert got[8] == "A short article."  # by the host's path
    assert got[9] == "A short article. Terms of the house apply."  # by its own
    assert got[10] == " ".join([P] * 6)
    assert got[0] == " ".join([P] * 6) + " 0" and got[11] == "Alone one." and got[12] == "Alone two." and got[None] == ""


def test_paths_joined_by_a_shuffle(voted, monkeypatch):
    want = sorted(map(str, html_main.extract(voted).collect()))
    monkeypatch.setattr(html_main, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html_main.extract(voted).collect())) == want


def test_ties_and_classes(spark):
    rows = [(i, "http://t.example/", f'<body><div class="{c} a b c d"><p>{PROSE}</p></div></body>') for i, c in enumerate("xyxy")]
    paths = html_main.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["paths"]
    assert paths == [">body>div.a.b.c.d.x", ">body>div.a.b.c.d.y"]


def test_articles_of_the_table(spark):
    """Against a plain cut between the article's tags, on pages that have one article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        marked = re.sub(r"(?i)</?(?:p|h\d|div|br|li|ul|ol)\b[^>]*>", " ", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", inner))
        assert r.text == re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", marked))).strip() and r.n_chars == len(r.text)
