"""Other ways to read a page than a plain request: a browser that runs its scripts, and a service that reads it for us.

Neither is part of this package. What drives one is a parameter; what may be asked for, and what counts as a page, is decided here.
A way is a function of an address that gives a ``web.Response`` or raises, and so can be dealt out by ``web.fetch``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from .web import Guard, Refused, Response

#: What a rendered page may weigh, in characters, and what a browser need not load to be read.
MOST_RENDERED = 8_000_000
UNREAD_KINDS = ("image", "media", "font")
#: Addresses for which nothing leaves the machine.
LOCAL_SCHEMES = ("data", "blob", "about")


@dataclass
class Gate:
    """Judges the requests that one page makes; a host is looked up once."""

    guard: Guard
    refused: list[str] = field(default_factory=list)
    known: dict[str, bool] = field(default_factory=dict)

    def public(self, url: str) -> bool:
        try:
            parts = urlsplit(url)
            host = parts.hostname or ""
        except ValueError:
            return False
        if parts.scheme in LOCAL_SCHEMES:
            return True
        if host not in self.known:
            try:
                self.guard.judge(url)
                self.known[host] = True
            except Refused:
                self.known[host] = False
        return self.known[host] and parts.scheme in ("http", "https")

    def lets(self, url: str, kind: str = "document") -> bool:
        """May the browser ask for this? What it may not is remembered, but for kinds that are never loaded."""
        if kind in UNREAD_KINDS:
            return False
        if not self.public(url):
            self.refused.append(url)
            return False
        return True


@dataclass(frozen=True)
class Rendered:
    """What a browser gives: the page's HTML after its scripts ran, the address it ended at, the status of the answer."""

    html: str
    address: str
    status: int


def by_browser(render: Callable[[str, Gate], Rendered], guard: Guard | None = None) -> Callable[[str], Response]:
    """A way by ``render``, which asks its gate before each request.

    A page that reached for an address that is not public, or ended at one, is thrown away.
    """

    def read(url: str) -> Response:
        gate = Gate(guard or Guard())
        gate.guard.judge(url)
        seen = render(url, gate)
        if any(urlsplit(u).scheme in ("http", "https") for u in gate.refused) or not gate.public(seen.address):
            raise Refused("the page reached for a private address")
        if len(seen.html) > MOST_RENDERED:
            raise Refused("too large")
        return Response(seen.status, "text/html", "utf-8", seen.html.encode("utf-8", "replace"), address=seen.address)

    return read


def by_service(post: Callable[[dict], dict], guard: Guard | None = None) -> Callable[[str], Response]:
    """A way by ``post``, which sends a request to a service and gives its answer; the page is asked for fresh.

    The address is judged here before it is sent on. The text is what the service made of the page.
    """

    def read(url: str) -> Response:
        (guard or Guard()).judge(url)
        answer = post({"url": url, "formats": ["markdown", "links"], "onlyMainContent": False, "maxAge": 0})
        data = answer.get("data") if isinstance(answer, dict) and answer.get("success") else None
        if not isinstance(data, dict):
            raise Refused(f"the service gave no page: {str(answer)[:200]}")
        about = data.get("metadata") or {}
        status = about.get("statusCode")
        links = tuple((u, "") for u in data.get("links") or () if isinstance(u, str) and urlsplit(u).scheme in ("http", "https"))
        text = str(data.get("markdown") or "")
        return Response(status if isinstance(status, int) else 200, "text/plain", "utf-8", text.encode("utf-8", "replace"), title=str(about.get("title") or ""), links=links)

    return read
