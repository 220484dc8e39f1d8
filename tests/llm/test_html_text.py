import html
import random
import re

import pytest

from topicdrift.llm.html_text import extracted, main_text

PROSE = "This paragraph is long enough to be the text of a page and it says so at some length."

CASES = [
    (None, ""), ("", ""), ("plain words", "plain words"), (f"<p>{PROSE}</p>", PROSE),
    ("<nav>x</nav><article><h1>T</h1><p>a &amp; b\n <b>c</b><br>d</p><p>&eacute;&#233;&nbsp;z</p></article><footer>f</footer>", "T\na & b c d\néé z"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><form>no</form><ul><li>i</li><li>j</li></ul><footer>no</footer></article>", "T\nx\ni\nj"),
    ("<main><p>x</p><script>var a='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>y</p></main>", "x\ny"),
    ('<article><p>x</p><div class="comments"><div>no</div><p>no</p></div><div id="cookie-notice">no</div><p style="display:none">no</p><p>y</p></article>', "x\ny"),
    ("<article><p>unclosed <i>one<p>two</article>", "unclosed one\ntwo"), ("<article><p>cut off in a ta<", "cut off in a ta"),
    ("<article><p>cut off &am", "cut off &am"), ('<article><p>cut off <a href="x', "cut off"), ("<article><p>5 < 6 and 7 > 2</p></article>", "5 < 6 and 7 > 2"),
    ("<div class=ad>no<article><p>kept though the advert is open</p></article>", "kept though the advert is open"),
    ('<article class="teaser"><p>' + "no " * 50 + "</p></article><article><p>yes</p></article>", "yes"),
    (f"<div>a</div><div>b</div><h2>Head</h2><p>{PROSE}</p><p>{PROSE} Again.</p><hr><div>{'':300}</div>", None),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article>one<article>two</article>three</article>", "one\ntwo\nthree"),
]


@pytest.mark.parametrize(("page", "expected"), CASES)
def test_pages(page, expected):
    found = main_text(page)
    assert found == expected if expected is not None else found.count(PROSE) == 2


def test_very_long_page():
    page = "<article>" + "".join(f"<p>line {i} &lt;</p>" for i in range(50_000)) + "</article>"
    assert main_text(page).count("\n") == 49_999


def test_table(spark):
    rows = [(i, "u", page, 5) for i, (page, _) in enumerate(CASES)] + [(None, None, CASES[4][0], 1), (1, "u", CASES[3][0], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    found = extracted(pages).collect()
    assert sorted((repr(r.page_id), r.text, r.n_chars) for r in found) == sorted((repr(i), main_text(h), len(main_text(h))) for i, _, h, _ in rows)
    assert extracted(pages.limit(0)).count() == 0


LONG = PROSE + " " + PROSE


@pytest.mark.parametrize(("page", "expected"), [
    (f"<main><h1>T</h1><p>lead</p><article>{LONG}</article></main>", f"T\nlead\n{LONG}"),
    (f"<article>{PROSE}</article><article>{LONG}</article>", f"{PROSE}\n{LONG}"),
    (f"<article>one<article>{LONG}</article>three</article>", f"one\n{LONG}\nthree"),
    (f"<p>one</p><article>{LONG}</article><p>{PROSE}</p>", f"one\n{LONG}\n{PROSE}"),
])
def test_articles_are_one_span(page, expected):
    assert main_text(page) == expected


def paragraphs(*sizes):
    return "".join(f"<p>{'word ' * (n // 5)}{'x' * (n % 5)}</p>" for n in sizes)


@pytest.mark.parametrize("sizes", [(30, 200, 200, 6), (200, 5, 4, 6, 200, 200), (200, 3, 3, 3, 3, 3, 3, 200)])
def test_no_block_between_or_after_is_lost(sizes):
    assert main_text(paragraphs(*sizes)).count("\n") == len(sizes) - 1


@pytest.mark.parametrize(("page", "expected"), [
    ("<article><p class=ad>x<p>Body<p>Body</article>", "Body\nBody"),
    ("<article><ul><li class=ad>x<ul><li>no</ul><li>i</ul><p>y</article>", "i\ny"),
    ("<article><ul><li>i<li class=ad>x</ul><p>y</article>", "i\ny"),
    ("<article><table><tr><td class=ad>x<td>a<tr><td>b</table></article>", "a\nb"),
    ("<article><div><p class=ad>x</div>y</article>", "y"),
    (f"<div class='content has-sidebar'><p>{PROSE}</p></div>", PROSE),
    (f"<h1 class='page-header'>T</h1><p>{PROSE}</p>", f"T\n{PROSE}"),
    (f"<div class='sidebar wrapper'><p>{PROSE}</p><div class=ad>no</div><p>z</p></div>", f"{PROSE}\nz"),
    (f"<div class=ad>no<script>{LONG}</script></div><p>{PROSE}</p>", PROSE),
    (f"<p>one</p><article>{LONG}</article>three", f"one\n{LONG}\nthree"),
])
def test_nothing_else_is_dropped(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(("page", "expected"), [
    ("<p>Hello world, a short note.</p>", "Hello world, a short note."),
    ("<h2>Note</h2><p>A paragraph of about fifty characters, not more.</p>", "Note\nA paragraph of about fifty characters, not more."),
    ("<div><a>Home</a></div><p>Hello world, a short note.</p>", "Hello world, a short note."),
    (f"<div><a>Home</a> <a>News</a></div><div><a>More</a></div><p>{LONG}</p>", LONG),
    ("<nav>menu</nav><p>x</p>", "x"), ("<nav>menu</nav>", ""),
])
def test_short_pages_and_menus_before_the_text(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(("page", "expected"), [
    (f"<ul><li><a>Home</a><li><a>{PROSE}</a><li><a>{PROSE}</a></ul><p>{LONG}</p><p>See <a>this</a></p>", f"{LONG}\nSee this"),
    (f"<div><a>Home</a> | <a>News</a> | <a>About us</a></div><div><p>{LONG}</p></div><div><a>Next page of this site</a></div>", LONG),
    (f"<article><p>x</p><ul><li><a>{PROSE}</a></li></ul></article>", f"x\n{PROSE}"),
    ("<p><a>Only a link</a></p>", "Only a link"),
    (f"<div class='social-science'>{LONG}</div><p>{PROSE}</p>", f"{LONG}\n{PROSE}"),
    (f"<article><p>x</p><section class='login guide'><h2>T</h2><p>{LONG}</p></section></article>", f"x\nT\n{LONG}"),
    (f"<article><p>x</p><div class='login guide'>Go</div><div class='login'>{LONG}</div><div class='social-links box'>{LONG}</div></article>", "x"),
    (f"<article><p>x</p><div class='share this'><a>{LONG}</a></div></article>", "x"),
])
def test_links_and_classes_that_name_a_subject(page, expected):
    assert main_text(page) == expected


def generated(seed):
    """A page and its main text: an article or a plain holder of blocks, among all kinds of other parts."""
    rng = random.Random(seed)

    def sentence(least):
        return " ".join(rng.choice(["alpha", "be&amp;ta", "&eacute;t&#233;", "<b>gamma</b>", "<a href=x>delta</a>", "\n eps ", "one", "5 &lt; 6"]) for _ in range(rng.randrange(least, least + 30)))

    def plain(markup):
        return " ".join(html.unescape(re.sub("<[^>]*>", "", markup)).split())

    def other():
        name, attributes = rng.choice([
            ("nav", ""), ("footer", ""), ("aside", ""), ("form", ""), ("script", ""), ("style", ""), ("div", " class='cookie-notice'"), ("div", " id=comments"),
            ("section", " class='ad large'"), ("ul", " role='navigation'"), ("p", " style='display: none'"), ("div", " class=\"sidebar left\""),
        ])
        body = " ".join(["unwanted"] * rng.randrange(1, 60))
        return f"<{name}{attributes}>{body if name in ('script', 'style', 'p') else f'<p>{body}</p>' if name != 'ul' else f'<li><a>{body}</a></li>'}</{name}>"

    marked, out, wanted = rng.random() < 0.5, [], []
    for i in range(rng.randrange(1, 8)):
        kind = "p" if not i else rng.choice(["p", "p", "h2", "li", "blockquote", "pre"])
        text = sentence(40 if not i else 1 if marked else 3)
        out.append(f"<ul><li>{text}</li></ul>" if kind == "li" else f"<{kind}>{text}</{kind}>")
        wanted.append(plain(text))
        if rng.random() < 0.3:
            out.append(rng.choice([other(), "<!-- <p>no</p> -->", "<hr>"]))
    holder = rng.choice(["article", "main"]) if marked else "div"
    around = [other() for _ in range(rng.randrange(4))], [other() for _ in range(rng.randrange(4))]
    return f"<html><head><title>no</title></head><body>{''.join(around[0])}<{holder}>{''.join(out)}</{holder}>{''.join(around[1])}</body></html>", "\n".join(wanted)


@pytest.mark.parametrize("first", range(0, 400, 50))
def test_generated_pages_with_known_text(first):
    for seed in range(first, first + 50):
        page, expected = generated(seed)
        assert main_text(page) == expected, seed
