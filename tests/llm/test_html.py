import html as H
import random
import re
import time
from html.parser import HTMLParser

import pytest

from docloom.llm import html
from docloom.llm.queries import op4_html_extraction

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>word\n and  text.<p>Second<br>line &lt;x&gt; &#233;&nbsp;z</p><ul><li>one<li>two</ul></article>"
TEXT = "Title & more First boldword and text. Second line <x> é z one two"
NOISE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><p>Site header text that is rather long and should not stay in the result</p></header>
<nav><ul><li><a href="/">menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and more words to be long enough</p></div>
<div class="ad">Buy now! This advert is long as well, with many words in it.</div>{main}
<aside><p>Sidebar words</p></aside><div id="sidebar"><p>More sidebar</p></div><form><p>Name</p><input value="x"></form>
<section class="comments"><h2>Comments</h2><div class="comment"><p>A reader comment that is much longer than the article itself, again and again and again.</p></div></section>
<footer><p>&copy; footer</p></footer><!-- <p>comment</p> --></body></html>"""


def test_noise_goes(spark):
    pages = [(1, "https://h.test/a", NOISE.replace("{main}", ARTICLE)), (2, "https://h.test/b", NOISE.replace("{main}", f"<div class='post-12 content'>{ARTICLE[9:-10]}</div>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: TEXT, 2: TEXT}


def test_host_consensus_decides(spark):
    """A page whose side box outweighs its content is read as the other pages of its host are."""
    page = lambda n, box: f"<body><div class='content p{n}'><p>{'good words here ' * 12}</p></div><div class='box'><p>{box}</p></div></body>"
    rows = [(k, "https://h.test/", page(k, "short")) for k in range(9)] + [(9, "https://h.test/", page(9, "long side text " * 60))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html.Page(rows[9][2]).best()[0].endswith("div.box")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert all(t == ("good words here " * 12).strip() for t in got.values())


def test_broken_markup():
    page = lambda s: html.Page(s).text(html.Page(s).best()[0])
    assert page("<p>a<p>b</p></p>c") == "a b c"
    assert page("<article>text <i>in</i>side <!-- never closed") == "text inside"
    assert page("<article>a &amp") == "a &"
    assert page("<article><p title='x > y'>kept</p>") == "kept"
    assert page("<article>5 < 6 and 7 > 6</article>") == "5 < 6 and 7 > 6"
    assert page("<ARTICLE><SCRIPT>x</SCRIPT>Up</ARTICLE>") == "Up"


STORY = "A story of some length, told in a sentence or two. " * 8


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article><p>{}</p></article></div>",
        "<div class='content-sidebar-wrap'><main><p>{}</p></main></div>",
        "<div id='page-header-wrap'><div class='post'><p>{}</p></div></div>",
        "<div class='post social-studies'><p>{}</p></div>",
        "<form id='aspnetForm'><div class='page'><p>{}</p></div><div class='footer'>no</div></form>",
        "<div class='top-banner'><article><p>{}</p></article></div>",
        "<div class='story' aria-hidden='false' data-x='hidden'><p>{}</p></div>",
        "<table><tr><td class='sidebar'>a menu<td class='text'><p>{}</p></table>",
        "<div class='post'><p>{}</p></div><div id='comments'><article><p>A reader says a lot. " + "And more. " * 60 + "</p></article></div>",
        "<article><p>{}</p></article><div class='related-posts'><article><p>no</p></article></div><div class='widget'><article>no</article></div>",
        "<section><p>{}</p></section><div class='cookieConsent'>no</div><div class='social_links'>no</div><p hidden>no</p><p style='display: none'>no</p><div role='navigation'>no</div>",
    ],
)
def test_wrappers_keep_the_text(page):
    read = html.Page(f"<html><body><nav>menu</nav>{page.replace('{}', STORY)}<footer>no</footer></body></html>")
    assert read.text(read.best()[0]) == STORY.strip()


def sentences(name, n):
    return "".join(f"<p>The {name} has sentence number {k} of some length in it.</p>" for k in range(n))


def words_of(markup):
    return " ".join(re.sub("<[^>]*>", " ", markup).split())


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='lead'>{sentences('lead', 3)}</div><div class='body'>{sentences('body', 8)}</div>",
        f"<div class='a1'>{sentences('first', 2)}</div><div class='b'>{sentences('second', 9)}</div><div class='c'>{sentences('third', 2)}</div>",
        f"<main>{sentences('teaser', 2)}<article>{sentences('story', 9)}</article></main>",
        f"<div class='intro'>{sentences('intro', 2)}</div><article>{sentences('story', 9)}</article>",
        f"<main><div class='summary'>{sentences('summary', 1)}</div><div class='text'>{sentences('text', 5)}</div></main>",
        f"<div class='post'><div class='post-header'><h1>Title here</h1></div><div class='x'>{sentences('text', 5)}</div></div>",
    ],
)
def test_prose_beside_the_winner_stays(page):
    read = html.Page(f"<html><body><nav>menu</nav><div class='box'><a href='/'>A link. And more of it, as long as prose.</a></div>{page}<footer>no</footer></body></html>")
    assert read.text(read.best()[0]) == words_of(page)


LEAKING = "user-comments post-comments article-comments reader-comments fb-comments comment-thread related-posts related-articles share-buttons google-ads newsletter-signup cookie-consent-message gdpr-banner post-navigation entry-footer comments-area comment-list sharing-buttons social-links sponsored-post cookie-notice"


@pytest.mark.parametrize("name", LEAKING.split())
def test_noise_inside_the_article_goes(name):
    read = html.Page(f"<body><article>{sentences('story', 5)}<div class='{name}'><p>This is no part of it at all. It goes.</p></div></article></body>")
    assert read.text(read.best()[0]) == words_of(sentences("story", 5))


def test_a_discussion_longer_than_the_story_goes():
    talk = "".join(f"<div class='entry'>{sentences(f'reader {k}', 3)}</div>" for k in range(9))
    read = html.Page(f"<body><div class='story'>{sentences('story', 4)}</div><div class='discussion'>{talk}</div></body>")
    assert read.text(read.best()[0]) == words_of(sentences("story", 4))


def test_blocks_that_a_host_repeats_go(spark):
    """No name tells that the box is none of the story; copies of one page don't make its text repeated."""
    page = lambda k: f"<body><article>{sentences(f'story {k}', 4)}<div class='q7'>Read our magazine every week. It is free.</div></article></body>"
    rows = [(k, "https://h.test/", page(k)) for k in range(10)] + [(k, "https://g.test/", page(77)) for k in range(10, 30)] + [(30, "https://h.test/", "<body><p>Read our magazine every week. It is free.</p></body>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[k] == words_of(sentences(f"story {k}", 4)) for k in range(10))
    assert all(got[k] == words_of(page(77)) for k in range(10, 30)) and got[30] == "Read our magazine every week. It is free."


def test_noise_alone_is_no_text():
    read = html.Page("<body><nav>menu</nav><div class='ad'><div>Buy this now, it is cheap.</div></div><div class='comments'><div class='text'>Nice!</div></div></body>")
    assert read.text(read.best()[0]) == ""


def test_a_leading_path_with_little_text_does_not_win(spark):
    """The host voted for div.content; one page has its story elsewhere and a mere date there."""
    usual = [(k, "https://h.test/", f"<body><div class='content'><p>{STORY}</p></div></body>") for k in range(9)]
    odd = (9, "https://H.TEST/x", f"<body><div class='content'>Updated</div><div class='longread'><p>{STORY}{STORY}</p></div></body>")
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([*usual, odd], "page_id long, url string, html string")).collect()}
    assert got == {k: STORY.strip() for k in range(9)} | {9: (STORY + STORY).strip()}


def test_paths_tell_containers_apart():
    """Containers that differ far above, or in the last of many classes, are not taken together."""
    page = "<div class='{a}'>" + "<div>" * 9 + "<div class='x'><p>{b}</p></div>" + "</div>" * 10
    read = html.Page(page.format(a="left", b="short") + page.format(a="a b c d main", b=STORY) + page.format(a="a b c d other", b="short"))
    assert read.text(read.best()[0]) == STORY.strip()
    assert html.Page("<div class='b p7 a'>x</div>").best()[0] == html.Page("<div class='p99 a b'>x</div>").best()[0]


@pytest.mark.parametrize(
    "part, end",
    [("<div>", "</div>"), ("<b>x", ""), ("<div>", ""), ("<div></p>", ""), ("<div></span>", ""), ("<b><p>", ""), ("<h1>x", ""), ("<p><b>", "<h2>"), ("<x-y>", ""), ("<a b='", ""), ("<td><b>", "</tr>"), ("<", ""), ("&#", ""), ("<div class='sidebar'>", "")],
)
def test_nesting_takes_linear_time(part, end):
    """100,000 elements within seconds, closed or not."""
    began = time.monotonic()
    read = html.Page(part * 100_000 + "deep" + end * 100_000)
    read.text(read.best()[0])
    assert time.monotonic() - began < 15


class Plain(HTMLParser):
    """A reader of well-formed pages by the standard library: the text of one element, its blocks joined by spaces."""

    def __init__(self, wanted: str, left_out: set[str]):
        super().__init__()
        self.wanted, self.left_out, self.stack, self.blocks = wanted, left_out, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag not in html.VOID:
            self.stack.append((tag, dict(attrs).get("class", "")))
        if tag not in html.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag not in html.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if any(c == self.wanted for _, c in self.stack) and not any(t in html.NOISE_TAGS or c in self.left_out for t, c in self.stack):
            self.blocks[-1] += data

    def read(self, source):
        self.feed(source)
        self.close()
        return " ".join(" ".join(b.split()) for b in self.blocks if b.split())


def test_random_pages_against_the_standard_parser():
    """Nested containers, tables, lists, inline elements and noise in any place, without <article>."""
    rng = random.Random(4)
    words = lambda: " ".join(rng.choice(["one", "two &amp; three", "f&uuml;r", "x &lt; y", "Wort", "mot"]) for _ in range(rng.randrange(3, 30)))

    def block(depth):
        kind = rng.randrange(8)
        if kind == 0 and depth:
            return f"<div class='part'>{''.join(block(depth - 1) for _ in range(3))}</div>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{words()}</li>' for _ in range(3))}</ul>"
        if kind == 2:
            return f"<table><tr><td>{words()}</td><td>{words()}</td></tr></table>"
        if kind == 3:
            return f"<div class='social-share'>{words()}</div><aside><p>{words()}</p></aside><script>var x = '<p>no</p>';</script>"
        if kind == 4:
            return f"<h2>{words()}</h2>"
        return f"<p>{words()} <b>{words()}</b><i>{words()}</i><br>{words()}</p>\n"

    for _ in range(200):
        story = "".join(block(2) for _ in range(12)) + f"<p>{words() * 30}</p>"
        source = f"<html><body><header><p>{words()}</p></header><div class='story'>{story}</div><div class='comments'><p>{words()}</p></div></body></html>"
        page = html.Page(source)
        path = page.path[next(k for k, p in enumerate(page.path) if p.endswith(":div.story"))]
        assert page.text(path) == Plain("story", {"social-share"}).read(source)


def test_repeated_rows_are_read_each(spark):
    row = (1, "https://h.test/", f"<div class='c'><p>{STORY}</p></div>")
    assert [r["text"] for r in html.extract(spark.createDataFrame([row] * 3, "page_id long, url string, html string")).collect()] == [STORY.strip()] * 3


def test_query_against_the_markup(spark, data):
    got = {r["page_id"]: r for r in op4_html_extraction(spark, data).collect()}
    for p in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = re.search("<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|h1|/h1|br)>", article))
        assert got[p["page_id"]]["text"] == " ".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])
