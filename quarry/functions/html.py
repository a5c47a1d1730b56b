"""HTML to simplified Markdown: a tree, a pass that rewrites it, and a writer. Used inside an Arrow UDF, one page at a
time; every walk keeps a stack of its own, so a page may be as deep as it likes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import selectors

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "noscript", "ol", "output", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What is left open by mistake goes on in the next paragraph.
_FORMAT = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
#: What a start tag ends: itself and its like, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Blank or not, these are written.
_KEPT = {"a", "table", "thead", "tbody", "tfoot", "th", "td", "iframe", "audio", "video"}
#: What means something in Markdown, anywhere and at the beginning of a text.
ANYWHERE = re.compile(r"([\\*`\[\]_])")
AT_START = re.compile(r"^(-|\+ |=+|#{1,6} |~~~|>)")
NUMBERED = re.compile(r"^(\d+)\. ")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            n = waiting.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                waiting.extend(reversed(n.children))
        return "".join(out)

    def replace(self, new: list) -> None:
        if self.parent is None:
            return
        at = next((i for i, c in enumerate(self.parent.children) if c is self), None)
        if at is not None:
            self.parent.children[at : at + 1] = new
            for c in new:
                if isinstance(c, Node):
                    c.parent = self.parent
        self.parent = None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open, self.formats, self.paragraphs = [self.root], [], 0

    def _put(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.paragraphs += tag == "p"
        return node

    def _pop_to(self, at: int) -> None:
        self.paragraphs -= sum(n.tag == "p" for n in self.open[at:])
        del self.open[at:]

    def _last(self, tags: set[str], within: set[str]) -> int:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in within:
                break
        return 0

    def _again(self) -> None:
        """Opens anew what formats the text and was closed with a block around it."""
        held = {id(n) for n in self.open}
        for i, n in enumerate(self.formats):
            if id(n) not in held:
                self.formats[i] = self._put(n.tag, n.attrs)

    def handle_starttag(self, tag, attrs):
        if self.paragraphs and tag in _BLOCK and tag not in ("html", "body") and (at := self._last({"p"}, {"button", "table", "td", "th"})):
            self._pop_to(at)
        if tag in _ENDS:
            tags, within = _ENDS[tag]
            while at := self._last(tags, within):
                self._pop_to(at)
        if tag in _FORMAT:
            if tag == "a" and any(n.tag == "a" for n in self.formats):
                self.handle_endtag("a")
        if tag not in _BLOCK and tag not in ("head", "title", "script", "style"):
            self._again()
        node = self._put(tag, {k: v or "" for k, v in attrs})
        if tag in _FORMAT:
            alike = [n for n in self.formats if n.tag == tag and n.attrs == node.attrs]
            self.formats = [n for n in self.formats if len(alike) < 3 or n is not alike[0]] + [node]

    def handle_endtag(self, tag):
        if tag in _FORMAT:
            own = next((n for n in reversed(self.formats) if n.tag == tag), None)
            self.formats = [n for n in self.formats if n is not own]
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                break
            if tag in _FORMAT and self.open[i].tag in _BLOCK:
                break

    def handle_data(self, data):
        if data and self.open[-1].tag not in ("script", "style", "title"):
            self._again()
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _in_order(root: Node) -> list[Node]:
    out, waiting = [], [root]
    while waiting:
        n = waiting.pop()
        out.append(n)
        waiting.extend(reversed(n.elements()))
    return out


def simplify(root: Node) -> None:
    """Takes out what says nothing (scripts, styles, heads' content, footers, links to resources, frames and divs without
    content), all attributes but addresses, and divs that only hold a div. Numbered buttons become links."""
    elements = _in_order(root)
    for n in elements:
        if n.tag == "head":
            n.children = []
    for n in elements:
        if n.tag in ("script", "style", "noscript", "link", "footer") or n.tag == "iframe" and not n.children:
            n.replace([])
        elif n.tag == "button" and n.attrs.get("number"):
            link = Node("a", {"href": f"/courses?page={n.attrs['number']}"})
            link.children = [n.text().strip()]
            n.replace([] if n.attrs["number"] == "..." else [link])
        else:
            n.attrs = {k: v for k, v in n.attrs.items() if k == "href"}
            if n.tag == "div":
                own, said = n.elements(), any(isinstance(c, str) and c.strip() for c in n.children)
                if not own and not said:
                    n.replace([])
                elif not said and len(own) == 1 and own[0].tag == "div":
                    n.replace(own)


def _collapse(root: Node) -> None:
    """White space as a browser shows it: one space between words, none at the edges of blocks. ``last`` is where the
    text before stands; while it is None, the next text begins a line."""
    last: tuple[Node, int] | None = None
    keep = False

    def trim() -> None:
        if last is not None:
            n, i = last
            n.children[i] = n.children[i].removesuffix(" ")

    walk: list[tuple[Node, int]] = [(root, 0)]
    while walk:
        n, at = walk.pop()
        if at < len(n.children):
            walk.append((n, at + 1))
            c = n.children[at]
            if isinstance(c, str):
                text = re.sub("[ \r\n\t]+", " ", c)
                if text[:1] == " " and not keep and (last is None or last[0].children[last[1]].endswith(" ")):
                    text = text[1:]
                n.children[at] = text
                if text:
                    last = (n, at)
                continue
            if c.tag in _BLOCK or c.tag == "br":
                trim()
                last, keep = None, False
            elif c.tag in _VOID:
                last, keep = None, True
            elif last is not None:
                keep = False
            if c.tag == "pre":
                continue
            walk.append((c, 0))
        elif n.tag in _BLOCK:
            trim()
            last, keep = None, False
    trim()


def _escaped(text: str) -> str:
    return NUMBERED.sub(r"\1\\. ", AT_START.sub(r"\\\1", ANYWHERE.sub(r"\\\1", text)))


def _joined(parts: list[str]) -> str:
    """Parts one after the other, with as many line ends between two as the one of them with more has, two at most."""
    out, held = [], 0
    for p in parts:
        body = p.lstrip("\n")
        if not p:
            continue
        held = min(2, max(held, len(p) - len(body)))
        if body:
            kept = body.rstrip("\n")
            out += ["\n" * held, kept]
            held = len(body) - len(kept)
    return "".join(out) + "\n" * held


def _fenced(code: str) -> str:
    code = re.sub("\r?\n|\r", " ", code)
    fence = "`"
    while fence in re.findall("`+", code):
        fence += "`"
    room = " " if re.search("^`|^ .*[^ ].* $|`$", code) else ""
    return f"{fence}{room}{code}{room}{fence}" if code else ""


def _wrapped(n: Node, inside: str, blank: bool) -> str:
    """An element around its children's Markdown."""
    tag = n.tag
    if blank and tag not in _KEPT and tag not in _VOID:
        return "\n\n" if tag in _BLOCK else ""
    if re.fullmatch("h[1-6]", tag):
        level = int(tag[1])
        return f"\n\n{inside}\n{('=' if level == 1 else '-') * len(inside)}\n\n" if level < 3 else f"\n\n{'#' * level} {inside}\n\n"
    if tag == "p":
        return f"\n\n{inside}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "blockquote":
        return "\n\n" + re.sub("^", "> ", inside.strip("\n"), flags=re.M) + "\n\n"
    if tag == "pre" and n.elements() and n.children[0] is n.elements()[0] and n.children[0].tag == "code":
        return "\n\n    " + n.children[0].text().replace("\n", "\n    ") + "\n\n"
    if tag in ("ul", "ol"):
        inner = n.parent is not None and n.parent.tag == "li" and n.parent.elements()[-1] is n
        return f"\n{inside}" if inner else f"\n\n{inside}\n\n"
    if tag == "li":
        own = n.parent.elements() if n.parent is not None else [n]
        mark = f"{next(i for i, c in enumerate(own, 1) if c is n)}.  " if n.parent is not None and n.parent.tag == "ol" else "*   "
        content = re.sub("\n+$", "\n", inside.lstrip("\n")).replace("\n", "\n    ")
        return mark + content + ("\n" if own[-1] is not n and not content.endswith("\n") else "")
    if tag in _BLOCK:
        return f"\n\n{inside}\n\n"
    mark = "**" if tag in ("b", "strong") else "_" if tag in ("i", "em") else ""
    if not mark and not (tag == "a" and "href" in n.attrs):
        return inside
    # White space at the edges of the text that is marked stands outside the marks; line breaks aren't text.
    text = n.text()
    lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    inside = inside.strip() if lead or trail else inside
    if not text.strip():
        lead = ""
    if mark:
        return f"{lead}{mark}{inside}{mark}{trail}" if inside.strip() else lead + trail
    href = re.sub(r"([()])", r"\\\1", n.attrs["href"])
    return f"{lead}[{inside}]({href}){trail}"


def blocks(root: Node) -> str:
    """The Markdown of a tree: children before their parent."""
    _collapse(root)
    # An element, what its children have come to, where it stands among them, and whether all of it was blank so far.
    open_: list[list] = [[root, [], 0, True]]
    while True:
        n, parts, at, blank = top = open_[-1]
        if at < len(n.children):
            top[2] += 1
            c = n.children[at]
            if isinstance(c, str):
                parts.append(_escaped(c))
                top[3] = blank and not c.strip()
            elif c.tag == "code" and c.parent.tag != "pre":
                parts.append(_fenced(c.text()))
                top[3] = blank and not c.text().strip()
            else:
                open_.append([c, [], 0, True])
            continue
        open_.pop()
        if not open_:
            return re.sub(r"\s+$", "", _joined(parts).lstrip("\t\r\n"))
        inside = n.text() if n.tag == "pre" else _joined(parts)
        open_[-1][1].append(_wrapped(n, inside, blank))
        if not blank or n.tag in _VOID or n.tag in _KEPT:
            open_[-1][3] = False


def simplified(html: str | None, selector: str | None = None) -> tuple[str | None, str | None]:
    """(Markdown, error): a selector that can't be read or fits nothing, or blank content, is an error of the row, not of
    the job."""
    if html is None:
        return None, None
    root, wanted = parse(html), (selector or "").strip()
    if wanted:
        try:
            found = selectors.first(root, wanted)
        except selectors.SelectorError:
            found = None
        if found is None:
            return None, "ContentSelectorError"
        # What is selected stands alone, in a root of its own, so that it may itself be taken out.
        root = Node("", {})
        root.children, found.parent = [found], root
    simplify(root)
    text = blocks(root)
    return (None, "ContentSelectorError") if wanted and not text else (text, None)


def with_entities(html, names: list[str]):
    """The page, in which only these entities, a semicolon after each, stand for characters; any other & is one. Browsers
    also read cut ones (&amp without its semicolon), as ``markdown`` does by itself."""
    return F.regexp_replace(html, f"&(?!({'|'.join(names)});)", "&amp;")


def markdown(selector: str | None = None):
    """A column function: html to (markdown, error)."""

    def batch(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([simplified(h, selector) for h in html], columns=["markdown", "error"])

    batch.__annotations__ = {"html": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "markdown string, error string")
