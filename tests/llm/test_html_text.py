import re
from html.parser import HTMLParser

import duckdb
import pytest

from listingloom.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages())


def test_pages_made_anew_are_told_apart(model):
    own = html_text.Extractor(model)
    right = total = 0
    for blocks, labels in html_text.labelled_pages(150, seed=77):
        unary = [own.path(p) + sum(map(own.feature, html_text.text_features(t, a, i, len(blocks)))) for i, (p, t, a) in enumerate(blocks)]
        right += sum(a == b for a, b in zip(labels, html_text.viterbi(unary, own.moves), strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_pages_give_their_article(spark, sf001, model):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages, model).collect()
    assert len(rows) == len(html)
    same = 0
    for r in rows:
        article = re.search(r"(<article>.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        same += r.text == " ".join(t for _, t, _ in html_text.page_blocks(article))
        assert r.n_chars == len(r.text)
    assert same >= 0.98 * len(rows)


class Article(HTMLParser):
    """What lies in a page's article, by the library's own reader of HTML."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.texts = False, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.texts.append(data)


CONTAINERS = ["<article>", "<div>", '<div class="post">', "<section>", "<main>", '<div class="entry-content">', "", '<div class="row"><div class="col-md-8">', "<div><div><div>", '<div class="zxq">', '<div id="page">', "<table><tr><td>"]


@pytest.mark.parametrize("container", CONTAINERS)
def test_articles_are_found_whatever_they_stand_in(sf001, model, container):
    rows = duckdb.sql(f"SELECT html FROM '{sf001}/pages.parquet'").fetchall()
    own, equal = html_text.Extractor(model), 0
    for (page,) in rows:
        wanted = " ".join(" ".join(Article(page).texts).split())
        closing = "".join(f"</{t}>" for t in reversed(re.findall("<([a-z]+)", container)))
        got = own.main_text(page.replace("<article>", container).replace("</article>", closing))
        equal += got == wanted
        assert got or not wanted
    assert equal >= 0.96 * len(rows)


def test_small_pages(model):
    own = html_text.Extractor(model)
    page = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>{}<h1>The title</h1><p>First paragraph of some text, with words.</p><p>Second one follows here. It has two sentences.</p><p>Third one, the last of them.</p>{}<footer>Copyright 2020</footer>"
    for container in ("", "<div>", '<div class="post">', '<div class="row"><div class="col">'):
        closing = "".join(f"</{t}>" for t in reversed(re.findall("<([a-z]+)", container)))
        assert own.main_text(page.format(container, closing)) == "The title First paragraph of some text, with words. Second one follows here. It has two sentences. Third one, the last of them."
    assert own.main_text("<p>Hello world this is a page.</p>") == "Hello world this is a page."
    assert own.main_text("plain text only") == "plain text only"


def test_viterbi_finds_the_best_labelling():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(200):
        unary = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        moves = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(3)]
        score = lambda y: sum(u for u, l in zip(unary, y, strict=True) if l) + moves[2][y[0]] + sum(moves[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731, E741
        assert score(html_text.viterbi(unary, moves)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(unary)))))


def test_reading_blocks():
    texts = lambda page: [t for _, t, _ in html_text.page_blocks(page)]
    assert texts("<p>a<b>b</b> &amp;&nbsp;c&#233;<br>d<p>e <i>f") == ["ab & cé d", "e f"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><!-- x <p>y --><p title="a>b">z</p>') == ["z"]
    assert texts("1 < 2 <p>x</p") == ["1 < 2", "x</p"] and texts("<div><div>") == [] and texts("<script>never closed") == []
    assert html_text.page_blocks("<ul><li><a href=x>abc</a><li>d")[0] == ("ul li", "abc", 3)


def test_odd_rows(spark, model):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<<<>>>&&&&#x;"), (3, "u", "<article><p>" + "word " * 60_000), (3, "u", "<p>" * 3000), (4, "u", "<article><h1>T</h1><p>One two three four five six seven.</p></article>")]
    got = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string"), model).collect()
    assert len(got) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
