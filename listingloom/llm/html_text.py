"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into blocks, the stretches of text between block-level tags, each with the tags and class words above it.
The field scores a block as main text or not from its ancestors and its text, and neighbouring labels together; Viterbi
finds the best labelling. It is trained here, by gradient on the exact likelihood, on labelled pages made by rule: layouts
with menus, banners, notices, adverts, side bars, forms, comments and footers around an article, labels known by making.
"""

from __future__ import annotations

import bisect
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"(?>[^'\">]+|\"[^\"]*\"|'[^']*')*+>")
_MARKS = re.compile(r"[\"'>]")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, with the pattern of their end.
RAW = {t: re.compile(f"</{t}\\s*>", re.IGNORECASE) for t in "script style template textarea iframe object svg math".split()}
_CLOSED_BY_OWN_KIND = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Tags without an end that are looked for one by one; then the ends of all tags of the page are found in one pass.
FAILURES = 8
DIMENSIONS = 1 << 13
Block = tuple[str, str, int]


class Node:
    """An open block element: its tag and class words, which of them none of its ancestors has, and whether it and they are
    bare of class words."""

    __slots__ = ("parent", "words", "fresh", "links", "base", "bare")

    def __init__(self, parent: "Node | None", words: tuple[str, ...], fresh: tuple[str, ...], links: int):
        self.parent, self.words, self.fresh, self.links, self.base = parent, words, fresh, links, None
        self.bare = len(words) == 1 and (parent is None or parent.bare)

    def path(self) -> str:
        words, node = [], self
        while node is not None:
            words.append(" ".join(node.words))
            node = node.parent
        return " ".join(reversed(words))


class _Ends:
    """Where the tag whose attributes begin at a place ends (behind its '>'), or -1; in time in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.last, self.failures, self.at = page, page.rfind(">"), 0, None

    def __call__(self, place: int) -> int:
        if self.at is None:
            found = _ATTRIBUTES.match(self.page, place)
            if found or self.failures < FAILURES:
                self.failures += found is None
                return found.end() if found else -1
            self._all()
        return self.ends[bisect.bisect_left(self.at, place)]

    def _all(self) -> None:
        """From the last quote or '>' to the first: a '>' ends the tag, a quote leads to what follows the next one of its kind."""
        marks = [(m.start(), m[0]) for m in _MARKS.finditer(self.page)]
        self.at, self.ends = [i for i, _ in marks], [-1] * (len(marks) + 1)
        after = {'"': len(marks), "'": len(marks)}
        for k in range(len(marks) - 1, -1, -1):
            place, mark = marks[k]
            if mark == ">":
                self.ends[k] = place + 1
            else:
                self.ends[k] = self.ends[min(after[mark] + 1, len(marks))]
                after[mark] = k


def read_blocks(page: str | None) -> list[tuple[Node | None, str, int]]:
    """(element, text, characters inside links) of each block with text, in page order, read in one pass.

    Character references are decoded, white space is collapsed; scripts, styles, comments and markup are left out. A '<'
    that opens no whole tag is text.
    """
    page = page or ""
    out: list[tuple[Node | None, str, int]] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    seen: dict[str, bool] = {}
    parts: list[str] = []
    linked = links = place = 0
    ends = _Ends(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal links
        node = stack.pop()
        links = node.links
        open_[node.words[0]] -= 1
        for w in node.fresh:
            del seen[w]
        return node.words[0]

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    while place < len(page):
        start = page.find("<", place)
        if start != place:
            add(page[place : start if start >= 0 else len(page)])
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            place = end + 3 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, start) if start < ends.last else None
        behind = ends(m.end()) if m else -1
        if behind < 0:
            if start < ends.last and page[start + 1] in "!?/":
                place = page.find(">", start) + 1
            else:
                add("<")
                place = start + 1
            continue
        place, ending, tag = behind, m[1], m[2].lower()
        if tag in RAW and not ending:
            end = RAW[tag].search(page, place)
            place = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                floor = stack[-1].links if stack else 0
                links = max(links - 1, floor) if ending else links + (page[behind - 2] != "/")
            continue
        close()
        if tag in VOID:
            continue
        if ending:
            if open_.get(tag):
                while pop() != tag:
                    pass
            continue
        kinds = _CLOSED_BY_OWN_KIND.get(tag, ("p",) if tag in _ENDS_P else ())
        while stack and stack[-1].words[0] in kinds:
            pop()
            if tag != "tr":
                break
        attributes = page[m.end() : behind - 1]
        names = [f".{x}" for g in _NAMES.findall(attributes) for x in re.findall("[a-z]+", "".join(g).lower())] if attributes else []
        fresh = tuple(w for w in dict.fromkeys([tag, *names]) if w not in seen) if names or tag not in seen else ()
        seen.update(dict.fromkeys(fresh, True))
        open_[tag] = open_.get(tag, 0) + 1
        stack.append(Node(stack[-1] if stack else None, (tag, *names), fresh, links))
    close()
    return out


def page_blocks(page: str | None) -> list[Block]:
    """The blocks with their ancestors as a line of tags and class, id and role words, outermost first."""
    return [(node.path() if node else "", text, linked) for node, text, linked in read_blocks(page)]


def _slot(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMENSIONS


def path_features(path: str) -> list[int]:
    """Every ancestor tag and class word, the innermost ones marked as such, and whether there is no class word at all."""
    own = path.split(" ")
    tags = [t for t in own if t[:1] != "."]
    last = len(own) - 1 - next((i for i, t in enumerate(reversed(own)) if t[:1] != "."), 0)
    return [_slot(f"in {t}") for t in sorted(set(own))] + [_slot(f"at {t}") for t in own[last:]] + [_slot(f"two {' '.join(tags[-2:])}"), _slot(f"bare {len(tags) == len(own)}")]


def text_facts(text: str, linked: int, place: int, count: int) -> tuple:
    """What is looked at in a block's text: length, share of links, end, place in the page, marks, stops."""
    n = len(text)
    share = 0 if not linked else 1 if 2 * linked < n else 2 if linked < 0.9 * n else 3
    return min((n + 1).bit_length() - 1, 10), share, text[-1] in ".!?…", n > 80, place < 2, count - place <= 2, "©" in text, min(text.count(". ") + text.count(", "), 4)


def fact_features(facts: tuple) -> list[str]:
    length, share, ended, long, first, last, mark, stops = facts
    return [f"length {length}", f"links {share}", f"end {'.' if ended else 'x'}", f"long {long} links {share}", f"first {first}", f"last {last}", f"mark {mark}", f"stops {stops}"]


def text_features(text: str, linked: int, place: int, count: int) -> list[str]:
    return fact_features(text_facts(text, linked, place, count))


def _words(rng: random.Random, n: int) -> str:
    parts = ("the", "ion", "en", "ra", "de", "con", "la", "ver", "schau", "eau", "mente", "is", "of", "und", "que", "ti", "o", "ni")
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for i in range(n):
        if rng.random() < 0.12:
            out[i] += rng.choice(",.;")
    if rng.random() < 0.1:
        marks = rng.choice((" |", "***", "%", " ::", "$ #"))
        out = [w + rng.choice((marks, "")) for w in out]
    return " ".join(out).capitalize() + ("." if n > 6 and rng.random() < 0.75 else "")


def labelled_pages(count: int = 800, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages made by rule, as blocks with their labels: 1 for the article's own text."""
    rng = random.Random(seed)
    text = lambda a, b: _words(rng, rng.randint(a, b))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{text(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def boilerplate(kind: str) -> str:
        named = lambda tag, *names: f'<{tag} class="{rng.choice(names)}">'
        if kind == "menu":
            tag = rng.choice(["<nav>", named("div", "menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toolbar"), '<nav class="menu">', '<div role="navigation">', '<ul class="menu">'])
            return tag + links(rng.randint(3, 9)) + f"</{tag[1:4].strip('> ')}>"
        if kind == "banner":
            return rng.choice(["<header>", named("div", "header", "banner", "masthead", "topbar", "logo")]) + rng.choice([f"<h1>{text(1, 5)}</h1>", f"<div>{text(1, 6)}</div>", f"<p>{text(3, 12)}</p>"]) + rng.choice(["</header>", "</div>"])
        if kind == "notice":
            return named("div", "cookie", "cookies", "notice", "consent", "alert", "newsletter", "popup", "modal", "gdpr", "subscribe", "paywall", "message") + rng.choice(["<p>{}</p>", "{}", "<span>{}</span><button>Ok</button>"]).format(text(6, 40)) + "</div>"
        if kind == "advert":
            return named("div", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner ad") + rng.choice(["<p>{}</p>", "{}", "<a href='/b'>{}</a>"]).format(text(4, 50)) + "</div>"
        if kind == "side":
            return rng.choice(["<aside>", named("div", "sidebar", "side", "widget", "related", "recommended", "trending", "more", "tags")]) + f"<h3>{text(1, 4)}</h3>" + rng.choice([links(rng.randint(2, 6)), f"<p>{text(10, 50)}</p>"]) + rng.choice(["</aside>", "</div>"])
        if kind == "form":
            return rng.choice(["<form>", '<form class="search">', '<form class="login">']) + f"<label>{text(1, 3)}</label><input name=q><p>{text(4, 20)}</p><select><option>{text(1, 2)}<option>{text(1, 2)}</select><button>{text(1, 2)}</button></form>"
        if kind == "share":
            return named("div", "share", "sharing", "meta", "byline", "author", "pagination", "tools") + rng.choice([links(3), f"<p>{text(2, 9)}</p>", text(2, 8)]) + "</div>"
        if kind == "comments":
            tag = rng.choice([named("div", "comments", "comment", "discussion", "replies", "responses", "thread"), '<section id="comments">', '<section class="comments">', '<ol class="commentlist">'])
            one = rng.choice(['<div class="comment"><p>{}</p></div>', '<li class="comment"><p>{}</p></li>', "<p>{}</p>", '<article class="comment"><p>{}</p></article>', '<div class="reply">{}</div>'])
            return tag + f"<h3>{text(1, 3)}</h3>" + "".join(one.format(text(8, 70)) for _ in range(rng.randint(1, 5))) + f"</{re.match('<([a-z]+)', tag)[1]}>"
        return rng.choice(["<footer>{}</footer>", "<div class='footer'>{}</div>", "<div id='copyright'>{}</div>"]).format(rng.choice([f"&copy; {text(1, 3)} &middot; {text(4, 30)}", f"<p>{text(5, 30)}</p>", links(3)]))

    out = []
    for _ in range(count):
        top = [k for k in ("banner", "menu", "notice", "advert", "form", "share") if rng.random() < 0.5]
        end = [k for k in ("share", "side", "comments", "advert", "form", "menu", "footer") if rng.random() < 0.5]
        rng.shuffle(top)
        if rng.random() < 0.1:  # little else than the article
            top, end = [], end[: rng.randint(0, 1)]
        # An article stands in an element of its name or in any other: what surrounds it must not be what tells it.
        unknown = [f'<div class="{"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))}">' for _ in range(9)]
        unnamed = ["", "", *["<div>"] * 3, *unknown, "<div><div>", "<div><div><div>", "<section>", "<table><tr><td>", '<div class="row"><div class="col">', '<div class="wrap"><div class="inner">', '<div id="page">', '<div id="wrapper">', f"<section>{unknown[0]}", f"{unknown[0]}{unknown[1]}", '<div class="post">', '<div class="container post">']
        named = ["<article>", "<article>", "<article class='post'>", "<main>", "<main><article>", '<div class="content">', '<div class="article">', '<div id="main">', '<div class="post entry">', '<div class="story body text">', '<div class="article-body">']
        opening = rng.choice(unnamed if rng.random() < 0.6 else named)
        paragraphs = [rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>a<em>{}</em>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]).format(text(*rng.choice([(1, 3), (5, 20), (15, 80), (30, 120), (30, 120), (200, 400)]))) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12]))]
        body = rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", ""]).format(text(2, 12)) + "".join(paragraphs)
        # The article's blocks are marked with a tag that the reader knows nothing about and that never reaches a path.
        inside = [boilerplate(k) for k in ("advert", "share", "notice", "side") if rng.random() < 0.12]
        closing = "".join(f"</{t}>" for t in reversed(re.findall("<([a-z]+)", opening)))
        before, after = "".join(map(boilerplate, top)), "".join(map(boilerplate, end))
        head = f"<html><head><title>{text(2, 9)}</title></head><body>" if rng.random() < 0.85 else ""
        if not head and rng.random() < 0.5:
            body, opening, closing = rng.choice(["{}", "<p>{}</p>", "{}<p>{}"]).format(text(3, 40), text(20, 60)), "", ""
        pieces = [(head + before, 0), (opening, 0), (body, 1), *((x, 0) for x in inside), (closing + after + "</body></html>", 0)]
        blocks, labels = [], []
        whole = ""
        for piece, label in pieces:
            whole += piece
            blocks = page_blocks(whole)
            labels += [label] * (len(blocks) - len(labels))
            labels = labels[: len(blocks)]
        if blocks:
            out.append((blocks, labels))
    return out


def encode(blocks: list[Block]) -> list[list[int]]:
    return [path_features(p) + [_slot(f) for f in text_features(t, a, i, len(blocks))] for i, (p, t, a) in enumerate(blocks)]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 10, rate: float = 0.25, decay: float = 1e-4) -> dict:
    """Weights of the field: block weights for label 1 (label 0 has none), and a 3 x 2 table from the label before (2: start)."""
    data = [(encode(b), y) for b, y in pages]
    # A feature of fewer than three pages would only be learnt by heart, as a class name of one page; it counts for nothing.
    common = Counter(f for rows, _ in data for f in set().union(*rows))
    data = [([[f for f in r if common[f] > 2] for r in rows], y) for rows, y in data]
    weights, square = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    moves, moves_square = np.zeros((3, 2)), np.full((3, 2), 1e-6)
    rng, late = random.Random(3), []
    for k in range(rounds):
        rng.shuffle(data)
        for rows, y in data:
            n = len(rows)
            unary = np.zeros((n, 2))
            unary[:, 1] = [weights[r].sum() for r in rows]
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = unary[0] + moves[2]
            for i in range(1, n):
                forward[i] = unary[i] + np.logaddexp(forward[i - 1, 0] + moves[0], forward[i - 1, 1] + moves[1])
            for i in range(n - 2, -1, -1):
                ahead = unary[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(moves[:2, 0] + ahead[0], moves[:2, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            off = np.array(y) - np.exp(forward[:, 1] + backward[:, 1] - total)
            gradient = np.zeros((3, 2))
            gradient[2, y[0]] += 1
            gradient[2] -= np.exp(forward[0] + backward[0] - total)
            for i in range(1, n):
                gradient[y[i - 1], y[i]] += 1
                gradient[:2] -= np.exp(forward[i - 1][:, None] + moves[:2] + (unary[i] + backward[i])[None, :] - total)
            flat = np.concatenate([np.array(r) for r in rows])
            step = np.bincount(flat, weights=np.repeat(off, [len(r) for r in rows]), minlength=DIMENSIONS)
            used = np.flatnonzero(step)
            square[used] += step[used] ** 2
            weights[used] += rate * (step[used] / np.sqrt(square[used]) - decay * weights[used])
            moves_square += gradient**2
            moves += rate * gradient / np.sqrt(moves_square)
        if 2 * k >= rounds:
            late.append((weights.copy(), moves.copy()))
    # The mean over the later rounds, which hangs less on the last pages seen.
    return {"weights": np.mean([w for w, _ in late], axis=0), "moves": np.mean([m for _, m in late], axis=0)}


def viterbi(unary: list[float], moves: list[list[float]]) -> list[int]:
    """The best labels; unary: scores of label 1. Of equal ones, label 0 is taken."""
    if not unary:
        return []
    zero, one = moves[2][0], moves[2][1] + unary[0]
    back = []
    for u in unary[1:]:
        a, b = zero + moves[0][0], one + moves[1][0]
        c, d = zero + moves[0][1], one + moves[1][1]
        back.append((b > a, d > c))
        zero, one = max(a, b), max(c, d) + u
    label = int(one > zero)
    out = [label]
    for from_zero, from_one in reversed(back):
        label = int(from_one if label else from_zero)
        out.append(label)
    return out[::-1]


class Extractor:
    """main_text() with a trained field; scores of ancestors and of text features are kept, for pages share them."""

    def __init__(self, model: dict):
        self.weights, self.moves = model["weights"], model["moves"].tolist()
        self.features: dict[str, float] = {}
        self.innermost: dict[tuple, float] = {}
        self.facts: dict[tuple, float] = {}

    def path(self, path: str) -> float:
        return float(self.weights[path_features(path)].sum())

    def score(self, node: Node | None) -> float:
        """The same for an element: what its ancestors give is kept with them."""
        if node is None:
            return self.path("")
        chain = []
        above = node
        while above is not None and above.base is None:
            chain.append(above)
            above = above.parent
        for own in reversed(chain):
            own.base = (own.parent.base if own.parent else 0.0) + sum(self.feature(f"in {w}") for w in own.fresh)
        key = (node.parent.words[0] if node.parent else "", node.words)
        if key not in self.innermost:
            if len(self.innermost) > 200_000:
                self.innermost.clear()
            self.innermost[key] = sum(self.feature(f"at {w}") for w in node.words) + self.feature(f"two {key[0]} {node.words[0]}" if key[0] else f"two {node.words[0]}")
        return node.base + self.innermost[key] + self.feature(f"bare {node.bare}")

    def text(self, facts: tuple) -> float:
        if facts not in self.facts:
            self.facts[facts] = sum(map(self.feature, fact_features(facts)))
        return self.facts[facts]

    def feature(self, feature: str) -> float:
        if feature not in self.features:
            if len(self.features) > 200_000:
                self.features.clear()
            self.features[feature] = float(self.weights[_slot(feature)])
        return self.features[feature]

    def main_text(self, page: str | None) -> str:
        blocks = read_blocks(page)
        unary = [self.score(node) + self.text(text_facts(t, a, i, len(blocks))) for i, (node, t, a) in enumerate(blocks)]
        return " ".join(t for (_, t, _), label in zip(blocks, viterbi(unary, self.moves), strict=True) if label)


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    A null or empty html, and a page without main text, give the empty text. Repeated rows are read each; ids and urls
    pass as they are. White space is what Python's str.split() takes for it. Pages are read whole, in one pass whatever
    their markup. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in batches:
            texts = [extractor.main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_pages()))
