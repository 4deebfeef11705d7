import random
import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from listingloom.sources.markup import read_page
from listingloom.sources import extract


class Reader(HTMLParser):
    """The same by the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.texts, self.links, self.hidden, self.open = [], [], 0, None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a":
            href = dict(attrs).get("href")
            self.open = (href, []) if href else None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.open is not None:
            self.links.append((self.open[0], " ".join(" ".join(self.open[1]).split())))
            self.open = None

    def handle_data(self, data):
        if self.hidden:
            return
        if text := " ".join(data.split()):
            self.texts.append(text)
        if self.open is not None:
            self.open[1].append(data)


PIECES = ["<p>", "</p>", "<div class='x > y'>", '<a href="/a?b=1&amp;c=2">', "<a href=/plain>", "<A HREF='/upper'>", "<a name=x>", "</a>", "</A >", "text ", "a  b\n", "&amp; &eacute;&#233;", "<br/>", "<!-- c <p> > -->", "<!DOCTYPE html>", '<script>if (a < b) "</p>" </script>', "<style>p > a {}</style>", '<img alt="it\'s > that" src=x>', "<b>bold</b>", "<a title='href=no' href='/yes'>", "<a href=''>", "é 漢字 ", "<input disabled value=3>", "5 < 6 "]


@pytest.mark.parametrize("seed", range(300))
def test_pages_read_as_by_the_library(seed):
    rng = random.Random(seed)
    page = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40)))
    reader = Reader(page)
    assert read_page(page) == (reader.texts, reader.links)


@pytest.mark.parametrize("unit", ["<div ", "<a ", "<a href='", '<a href="x" title="', "<", "</", "<!--", "<!", "<a href=x>", "<script>", "&", "='", "= ", "<p>a</p>", "<a href='x'>t</a>"])
@pytest.mark.parametrize("end", ["", ">", "<p>end</p>"])
def test_a_megabyte_of_anything_is_read_in_linear_time(unit, end):
    page = unit * (1_000_000 // len(unit)) + end
    began = time.process_time()
    read_page(page)
    assert time.process_time() - began < 6  # seconds; all tags looking for their end would take hours


def test_odd_pages():
    assert read_page(None) == ([], []) and read_page("") == ([], [])
    assert read_page("<a href=x>never closed") == (["never closed"], [])
    assert read_page("<script>never closed <p>x") == ([], [])
    assert read_page("1 <2> < 3") == (["1", "<", "2>", "<", "3"], [])


def test_pages_of_a_batch_are_read_few_at_a_time():
    """The texts and links of a whole batch, ten thousand pages, were in memory at once."""
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "html": [f"<p>{k}</p>" for k in range(1000)]})
    read = list(extract.pieces(iter([batch])))
    assert max(x.num_rows for x in read) == extract.PAGES_AT_ONCE
    assert [k for x in read for k in x.column(0).to_pylist()] == list(range(1000))
