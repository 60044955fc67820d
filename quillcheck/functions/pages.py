"""Pages as text: HTML is read into a table of events, from which title, text and links are folded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby, islice
from typing import NamedTuple
from urllib.parse import urldefrag, urljoin, urlsplit

from ..schemas import HIDDEN_TAGS, LINE_TAGS

#: What an element does to the page.
_ROLE = dict.fromkeys(LINE_TAGS, "line") | dict.fromkeys(HIDDEN_TAGS, "hidden") | {"title": "title", "a": "link"}
_STEP = {"open": 1, "close": -1}


class Event(NamedTuple):
    """Something a page says in order: an element's begin or end, or text; ``role`` is empty for text."""

    what: str
    role: str
    text: str


class _Events(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[Event] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if role := _ROLE.get(tag):
            self.seen.append(Event("open", role, dict(attrs).get("href") or "" if role == "link" else ""))

    def handle_endtag(self, tag):
        if role := _ROLE.get(tag):
            self.seen.append(Event("close", role, ""))

    def handle_data(self, data):
        self.seen.append(Event("text", "", data))


def events(html: str) -> list[Event]:
    return _Events(html).seen


def _depths(seen: list[Event]) -> Iterator[int]:
    """How many hidden elements are open after each event; an end without a begin counts for nothing."""
    steps = (_STEP.get(e.what, 0) if e.role == "hidden" else 0 for e in seen)
    return islice(accumulate(steps, lambda depth, step: max(0, depth + step), initial=0), 1, None)


def _titled(seen: list[Event]) -> Iterator[bool]:
    """Whether a title is open after each event; one inside something hidden is none."""
    is_open = False
    for e, depth in zip(seen, _depths(seen), strict=True):
        if e.role == "title":
            is_open = e.what == "open" and (is_open or not depth)
        yield is_open


def html_text(html: str) -> tuple[str, str]:
    """(title, visible text)."""
    seen = events(html)
    title, text = [], []
    for e, depth, in_title in zip(seen, _depths(seen), _titled(seen), strict=True):
        if e.role == "line":
            text.append("\n")
        elif e.what == "text" and (in_title or not depth):
            (title if in_title else text).append(e.text)
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(text).split("\n"))
    return " ".join("".join(title).split()), re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _anchors(seen: list[Event]) -> Iterator[tuple[str, str]]:
    """(href, words) of each link: from its begin to the next begin or end of one."""
    marks = accumulate(e.role == "link" for e in seen)
    for _, own in groupby(zip(marks, seen, strict=True), key=lambda x: x[0]):
        head, *rest = (e for _, e in own)
        if head.role == "link" and head.what == "open" and head.text:
            yield head.text, " ".join("".join(e.text for e in rest if e.what == "text").split())


def links(html: str, base: str) -> list[tuple[str, str]]:
    """(absolute address, words) of each http link; malformed addresses are left out."""

    def absolute(href: str) -> str:
        try:
            address = urldefrag(urljoin(base, href.strip()))[0]
            return address if urlsplit(address).scheme in ("http", "https") else ""
        except ValueError:
            return ""

    found = ((absolute(href), said) for href, said in _anchors(events(html)))
    return [(address, said) for address, said in found if address]


def address_parts(url: str) -> tuple[list[str], str] | None:
    """Host labels but the last and "www", and the path; None if the address is malformed."""
    try:
        parts = urlsplit(url)
        labels = (parts.hostname or "").split(".")[:-1]
    except ValueError:
        return None
    return [x for x in labels if x not in ("", "www")], parts.path
