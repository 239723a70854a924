"""Pages as trees of elements, with the features of each element and the blocks of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Element names by the part they play in HTML.
PARTS = {"article", "aside", "footer", "form", "header", "main", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select", "button"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a head can hold; any other opening tag ends an open head.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title", "head"}
HOLDS = {"ul", "ol", "menu", "dl", "table", "select", "tbody", "thead", "tfoot"}
# Words of class and id names, by what they tell.
NAMES = {
    "ad": "ad ads advert advertisement adbox banner promo sponsor sponsored",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pager pagination tabs",
    "frame": "header footer masthead copyright legal colophon foot",
    "side": "sidebar aside side widget related recommended popular trending",
    "notice": "cookie consent notice gdpr popup modal newsletter subscribe alert paywall",
    "talk": "comment comments disqus reply replies respond discussion",
    "share": "share sharing social follow login signup search",
    "body": "article content post entry story main body text page",
}
_NAME = {w: kind for kind, ws in NAMES.items() for w in ws.split()}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_ODD = re.compile(r"<!\[[^>]*>")


class Page(HTMLParser):
    """Elements in page order: tag, parent, names, length of text, of linked text; and (element, text) pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.chars, self.linked = ["#page"], [-1], [()], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self.open, self.silent, self.links = [0], 0, 0
        self.feed(_ODD.sub("", html))
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._leave_head(tag)
        if tag in BLOCK and tag != "hr" or tag in CLOSED_BY:
            self._imply(tag)
        number = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.names.append(tuple({_NAME[w] for w in _SPLIT.split(said.lower()) if w in _NAME}) if said else ())
        self.chars.append(0)
        self.linked.append(0)
        if tag in BLOCK or tag == "br":
            self.pieces.append((number, ""))
        if tag not in VOID:
            self.open.append(number)
            self.silent += tag in SILENT
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.handle_endtag(tag)

    def _leave_head(self, tag: str) -> None:
        """Closes a head whose end tag was left out: by body in any case, else unless an element inside it is open."""
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == "head":
                self._pop(depth)
                return
            if tag != "body":
                return

    def _imply(self, tag: str) -> None:
        """Closes what an opening tag closes: an open p by a block, and list items, cells and terms by their like."""
        wanted = CLOSED_BY.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name in wanted:
                self._pop(depth)
                return
            if name in HOLDS or name in BLOCK and name != "p" and tag not in CLOSED_BY:
                return

    def _pop(self, depth: int) -> None:
        for number in self.open[depth:]:
            self.silent -= self.tag[number] in SILENT
            self.links -= self.tag[number] == "a"
            if self.tag[number] in BLOCK:
                self.pieces.append((self.parent[number], ""))
        del self.open[depth:]

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self._pop(depth)
                return

    def handle_data(self, data):
        if not self.silent and data:
            number = self.open[-1]
            self.pieces.append((number, data))
            size = len(data) - data.count(" ")
            self.chars[number] += size
            if self.links:
                self.linked[number] += size

    def blocks(self, keep: list[bool]) -> list[str]:
        """Texts of the blocks that stand in kept elements, each with its white space as single spaces."""
        block = list(range(len(self.tag)))
        for i in range(1, len(self.tag)):
            if self.tag[i] not in BLOCK:
                block[i] = block[self.parent[i]]
        out, held, last = [], [], 0
        for number, text in self.pieces:
            if not text and self.tag[number] == "br":
                held.append(" ")
                continue
            if not text or block[number] != last:
                out.append("".join(held))
                held, last = [], block[number]
            if text and keep[last]:
                held.append(text)
        out.append("".join(held))
        return [t for t in (" ".join(x.split()) for x in out) if t]


def features(page: Page) -> list[list[str]]:
    """What is known of each element: its tag, names, share of links, length of text, and the part of the page it is in."""
    n = len(page.tag)
    chars, linked = page.chars[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    within = ["none"] * n
    for i in range(1, n):
        over = page.tag[page.parent[i]]
        within[i] = over if over in PARTS else within[page.parent[i]]
    out = []
    for i in range(n):
        share = linked[i] / chars[i] if chars[i] else 0.0
        size = 0 if not chars[i] else 1 if chars[i] < 25 else 2 if chars[i] < 100 else 3 if chars[i] < 400 else 4
        tag = page.tag[i] if page.tag[i] in BLOCK or page.tag[i] in SILENT else "inline"
        out.append(["bias", f"tag={tag}", f"links={0 if share < 0.2 else 1 if share < 0.6 else 2}", f"size={size}", f"within={within[i]}", *(f"name={k}" for k in page.names[i])])
    return out
