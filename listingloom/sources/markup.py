"""Reading a page of HTML in one pass whatever its markup: visible text by node, and anchors that are closed."""

from __future__ import annotations

import bisect
import html
import re

_MARKS = re.compile(r"""=\s*["']|["'>]""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_HIDDEN = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}


class _Tags:
    """Where a tag ends. A '>' within a quoted value doesn't end it; the table is made from the page's end to its start, so
    each mark is looked at once, however many tags stay open."""

    def __init__(self, page: str):
        marks = [(m.start(), m.end(), m[0][-1]) for m in _MARKS.finditer(page)]
        self.places = [start for start, _, _ in marks]
        self.ends = [-1] * (len(marks) + 1)
        behind = {'"': len(marks), "'": len(marks)}  # the first mark behind the nearest quote of each kind
        for k in range(len(marks) - 1, -1, -1):
            start, end, kind = marks[k]
            if kind == ">":
                self.ends[k] = end
                continue
            opens = end - start > 1
            self.ends[k] = self.ends[behind[kind]] if opens else self.ends[k + 1]
            behind[kind] = k + 1

    def end(self, place: int) -> int:
        """Behind the '>' of the tag whose name ends at a place, or -1."""
        return self.ends[bisect.bisect_left(self.places, place)]


def _href(attributes: str) -> str | None:
    found = None
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "href":
            found = m[2]
    return html.unescape(found[1:-1] if found[:1] in ("'", '"') and found[-1:] == found[:1] and len(found) > 1 else found) if found else None


def read_page(page: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """Texts of the visible nodes, white space collapsed, and (href, text) of anchors that are closed.

    What stands in scripts, styles, comments and declarations isn't visible. An anchor without href, or one that another
    anchor follows before its end, is no link. A '<' that opens no whole tag is text.
    """
    page = page or ""
    texts: list[str] = []
    links: list[tuple[str, str]] = []
    anchor: tuple[str, list[str]] | None = None
    tags, last, place = _Tags(page), page.rfind(">"), 0

    def take(data: str) -> None:
        data = html.unescape(data)
        if text := " ".join(data.split()):
            texts.append(text)
        if anchor is not None:
            anchor[1].append(data)

    while place < len(page):
        start = page.find("<", place)
        if start != place:
            take(page[place : start if start >= 0 else len(page)])
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            place = end + 3 if end >= 0 else len(page)
            continue
        ending = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + ending)
        end = tags.end(name.end()) if name and start < last else -1
        if end < 0:
            if start < last and page[start + 1 : start + 2] in ("!", "?", "/") and page[start + 1 : start + 2]:
                place = page.find(">", start) + 1
            else:
                take("<")
                place = start + 1
            continue
        tag, place = name[0].lower(), end
        closed = page[end - 2] == "/"
        if tag in _HIDDEN and not ending and not closed:
            raw = _HIDDEN[tag].search(page, place)
            place = raw.start() if raw else len(page)
        elif tag == "a":
            if ending or closed:
                if anchor is not None and not closed:
                    links.append((anchor[0], " ".join(" ".join(anchor[1]).split())))
                    anchor = None
            else:
                href = _href(page[name.end() : end - 1])
                anchor = (href, []) if href else None
    return texts, links
