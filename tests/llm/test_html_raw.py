"""Main-text extraction: elements that are left out, container names, hostile pages, and a plain reader of the test pages."""

import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from tarifa.llm import html_text

SF = "/root/testdata/sf0.01"
ENGLISH = "The story is about the man who was on the road to the sea and of what he had to do."


@pytest.mark.parametrize("tag", ["<svg-icon></svg-icon>", "<object-x>", "<svg/>", "<svg width='1' />", "<math/>", "<video src='a>b'>", "<svg><path d='M0'/></svg>", "<SELECT><option>no</SELECT>", "<style>p{}</style>"])
def test_text_after_the_element_stays(tag):
    assert html_text.extract(f"<p>one</p>{tag}<p>two</p>") == "one two"


def test_unclosed_script_is_no_text():
    assert html_text.extract("<p>one</p><script>let two = 2;") == "one"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="overflow-hidden"><article>{}</article></div>',
        '<article class="post has-comments">{}</article>',
        '<div class="content-with-sidebar"><article>{}</article></div>',
        '<body class="no-sidebar"><div class="widget"><article>{}</article></div><p>x</p>',
        '<div id="searchable-content"><p>{}</p></div>',
        '<article class="sponsored">{}</article>',
        '<div hidden="until-found"><p>{}</p></div>',
    ],
)
def test_articles_stay(page):
    assert html_text.extract(page.format(ENGLISH)) == ENGLISH


@pytest.mark.parametrize(
    "part",
    [
        '<div class="cookie-notice"><p>{}</p></div>',
        '<section id="commentsArea"><p>{}</p></section>',
        '<article class="comment">{}</article>',
        '<div id="comments"><article>{}</article></div>',
        '<div class="Site_Footer"><p>{}</p></div>',
        "<div hidden><p>{}</p></div>",
        '<div style="color: red; DISPLAY:none"><p>{}</p></div>',
        '<div class="sr-only"><p>{}</p></div>',
        "<nav><p>{}</p></nav>",
        "<form><p>{}</p></form>",
        "<aside><p>{}</p></aside>",
        "<footer>{}</footer>",
        "<!-- {} -->",
        "<noscript>{}</noscript>",
    ],
)
def test_other_parts_go(part):
    other = "It is not for the reader to say what the site had in mind with all of this."
    assert html_text.extract(f"<p>{ENGLISH}</p>{part.format(other)}") == ENGLISH


@pytest.mark.parametrize("text", ["他们在北京工作和生活已经很多年了" * 4, "привет мир как дела сегодня утром " * 3, "日本語の文章です。" * 9])
def test_other_scripts_inherit(text):
    assert text.strip() in html_text.extract(f"<p>{ENGLISH}</p><p>{text}</p>")


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("<", "<"), ("<p", "<p"), ('<p class="x', '<p class="x'), ("<!-- open", ""), ("<script>never closed", ""), ("plain words only", "plain words only"), ("<p>a &lt;b&gt; &amp;amp; &#233;  c</p>", "a <b> &amp; é c"), ("<p title='a>b'>one</p>", "one"), ("<p title='a>two", "two")],
)
def test_broken_pages(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<a b='", '<a ">" ', "<!", "<p>x</p>", "<svg>", "<div class='a-b ad'>", "<b></i></div>", "&amp", "<p>x<div>", '<p "a>'])
def test_time_grows_with_the_page(unit):
    begin = time.perf_counter()
    html_text.extract(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begin < 30  # a megabyte; seconds, not hours


def test_neighbours_like_brute_force():
    import random

    r = random.Random(4)
    for _ in range(300):
        labels = [r.choice([0, 0, 0, 1, -1]) for _ in range(r.randrange(0, 12))]
        decided = [(i, x) for i, x in enumerate(labels) if x]
        want = [x or (min(decided, key=lambda d: (abs(d[0] - i), -d[1]))[1] if decided else 0) for i, x in enumerate(labels)]
        assert html_text._inherit(labels) == want


class Plain(HTMLParser):
    """Text of the article element of a page, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append("\n" if tag != "b" else "")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append("\n" if tag != "b" else "")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_query_against_a_plain_reader(spark):
    got = {r["page_id"]: r for r in html_text.op4_html(spark, SF).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, html in pages:
        reader = Plain()
        reader.feed(html or "")
        want = re.sub(r"\s+", " ", "".join(reader.out)).strip()
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, want, len(want))


def test_tables_of_every_kind(spark):
    rows = [(1, "u", "<p>one</p>", "x", "y"), (1, "u", "<p>one</p>", "x", "y"), (None, None, None, None, None), (2, "v", f"<p>{'é ' * 300_000}</p>", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    out = html_text.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out.collect()) == [(0, 0), (1, 3), (1, 3), (2, 599_999)]
    assert html_text.main_text(df.limit(0)).count() == 0


PROSE = "<p>{} is a paragraph of the text that we have in this page, and it is long enough for all of us to read.</p>"


def test_quotes_open_values_only_after_an_equals_sign():
    assert html_text.extract("One <a href=x title=it's>of</a> the stories and that's all of it") == "One of the stories and that's all of it"
    page = "".join(PROSE.format(f"Number {i} <b title=it\"s>bold</b>") for i in range(10))
    assert all(f"Number {i} bold" in html_text.extract(page) for i in range(10))
    assert html_text.extract("<p title='a>b' class=x>" + PROSE.format("A")).startswith("A is") and html_text.extract('<p title="never closed>' + PROSE.format("A")).startswith("A is")


def test_forms_around_the_page_are_no_containers():
    article = "<article>" + PROSE.format("A") + "</article>"
    assert html_text.extract(f"<body><form>{article}</form></body>").startswith("A is")
    assert html_text.extract(f"<body><form id=aspnetForm><div>{PROSE.format('A')}{PROSE.format('B')}</div></form></body>").count(" is a paragraph") == 2
    asked = "<form><p>Please leave your name and the address that we can write to, and we will.</p><input></form>"
    assert "Please" not in html_text.extract(f"<div>{PROSE.format('A')}{PROSE.format('B')}</div>{asked}")
    assert "Please" not in html_text.extract(f"<article>{PROSE.format('A')}{asked}</article>")


def test_links_around_blocks_count_as_links():
    teaser = "<a href=/x><div>Teaser of the other story that you could read in this place now</div></a>"
    page = f"<div>{PROSE.format('A')}</div>{teaser}<div>{PROSE.format('B')}</div>"
    assert "Teaser" not in html_text.extract(page) and html_text.extract(page).count(" is a paragraph") == 2
    assert html_text.extract("<p><a href=/x>an open link" + PROSE.format("A") + PROSE.format("B")).count(" is a paragraph") == 2
    assert "A is" in html_text.extract("<a name=top>" + PROSE.format("A") + "</a>")


def test_block_rules_without_an_article_like_a_plain_version():
    """Pages of flat blocks: labels by the rules, then the nearest decided neighbour, worked out block by block."""
    import random

    stop, other = "the of and to in".split(), "rain hill stone river cloud".split()
    rng = random.Random(2)
    for _ in range(200):
        blocks = []
        for _ in range(rng.randrange(1, 9)):
            words = [rng.choice(stop if rng.random() < rng.choice([0, 0.3]) else other) for _ in range(rng.choice([2, 4, 12, 20]))]
            linked = rng.choice([0, 0, 0, len(words)])
            blocks.append((" ".join(words) + rng.choice(["", "."]), linked))
        page = "".join(f"<p><a href=x>{t}</a></p>" if n else f"<p>{t}</p>" for t, n in blocks)
        labels = []
        for text, linked in blocks:
            words = text.strip(".").split()
            share = sum(w in stop for w in words) / len(words)
            if linked:
                labels.append(-1)
            elif len(text) >= 40 and share >= 0.08:
                labels.append(1)
            elif len(text) >= 40 and share == 0 and "." not in text:
                labels.append(-1)
            else:
                labels.append(0)
        near = [max(((-abs(i - j), v) for j, v in enumerate(labels) if v), default=(0, 0))[1] if not x else x for i, x in enumerate(labels)]
        if 1 not in near:
            near = [0 if n else 1 for _, n in blocks]
        assert html_text.extract(page) == " ".join(t for (t, _), v in zip(blocks, near) if v > 0)
