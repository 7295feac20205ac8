"""A small DOM over the standard library's parser, with selectors and main-text extraction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

#: Elements without an end tag; elements whose content is no text; elements that begin a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg iframe object".split())
BLOCK = frozenset("p div section article main aside header footer nav h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre form figure figcaption dl dt dd br hr body".split())
#: Elements, and words in classes and ids, that speak against main text.
CHROME = frozenset("nav aside footer header form button select figure menu".split())
BOILERPLATE = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|footer|menu|nav\w*|promo|related|share|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[-_ ])", re.IGNORECASE)


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)
    #: Where it stands in the page: from its start tag to its end tag, or to what ends it without one.
    start: int = 0
    end: int = 0

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self):
        """The elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            stack += e.elements()[::-1]

    def html(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        inner = "".join(c.html() if isinstance(c, Element) else c if self.tag in ("script", "style") else escape(c, quote=False) for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")
        self.lines, self.closed = [0], None

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def new(self, tag, attrs) -> Element:
        start = self.place()
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at, start=start, end=start + len(self.get_starttag_text()))
        self.at.children.append(e)
        return e

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option") and self.at.tag == tag:
            self.at.end = self.place()
            self.at = self.at.parent
        e = self.new(tag, attrs)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.new(tag, attrs)

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.end_at(e.parent, self.place())
            self.closed = e

    def parse_endtag(self, i):
        self.closed = None
        z = super().parse_endtag(i)
        if self.closed is not None and z > i:
            self.closed.end += z - i
        return z

    def end_at(self, outer: Element | None, place: int) -> None:
        """Ends the open elements within ``outer``."""
        while self.at is not outer:
            self.at.end = place
            self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> Element:
    b = _Builder()
    b.lines += [m.end() for m in re.finditer("\n", page)]
    b.feed(page)
    b.close()
    b.end_at(None, len(page))
    return b.root


def classes(page: str) -> list[str]:
    return sorted({c for e in parse(page).walk() for c in e.attrs.get("class", "").split()})


_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<q>[\"']?)(?P<value>.*?)(?P=q)\s*)?\]|:nth-child\((?P<nth>\d+)\)|:(?P<first>first-child)"
)


@lru_cache(64)
def _css(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator before, conditions)."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, at, combinator, text = [], 0, " ", alternative.strip()
        if not text:
            raise ValueError(f"bad selector {selector!r}")
        while at < len(text):
            found = []
            while at < len(text) and (m := _SIMPLE.match(text, at)):
                found.append(tuple(sorted((k, v) for k, v in m.groupdict().items() if v is not None and k != "q")))
                at = m.end()
            if not found:
                raise ValueError(f"selector {selector!r} is not supported")
            steps.append((combinator, tuple(found)))
            m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if m:
                combinator, at = m[1] or " ", m.end()
            elif at < len(text):
                raise ValueError(f"selector {selector!r} is not supported")
        out.append(tuple(steps))
    return tuple(out)


def _is(e: Element, conditions: tuple) -> bool:
    for c in map(dict, conditions):
        value = e.attrs.get(c.get("attr", ""))
        want = c.get("value", "")
        if "tag" in c and c["tag"] not in ("*", e.tag) and c["tag"].lower() != e.tag:
            return False
        if "cls" in c and c["cls"] not in e.attrs.get("class", "").split() or "id" in c and e.attrs.get("id") != c["id"]:
            return False
        if ("nth" in c or "first" in c) and (e.parent is None or e.parent.elements().index(e) + 1 != int(c.get("nth", 1))):
            return False
        if "attr" in c and (
            value is None
            or c.get("op") == "=" and value != want
            or c.get("op") == "~=" and want not in value.split()
            or c.get("op") == "^=" and not value.startswith(want)
            or c.get("op") == "$=" and not value.endswith(want)
            or c.get("op") == "*=" and want not in value
        ):
            return False
    return True


def _fits(e: Element, steps: tuple) -> bool:
    combinator, conditions = steps[-1]
    if not _is(e, conditions):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if combinator == ">":
        return e.parent is not None and _fits(e.parent, rest)
    if combinator in "+~":
        before = e.parent.elements()[: e.parent.elements().index(e)] if e.parent else []
        return any(_fits(b, rest) for b in (before[-1:] if combinator == "+" else before))
    up = e.parent
    while up is not None:
        if _fits(up, rest):
            return True
        up = up.parent
    return False


def select_css(root: Element, selector: str) -> list[Element]:
    alternatives = _css(selector)
    return [e for e in root.walk() if any(_fits(e, a) for a in alternatives)]


_STEP = re.compile(r"(//|/)(\*|[A-Za-z][\w-]*)((?:\[[^\]]*\])*)")


def select_xpath(root: Element, path: str) -> list[Element]:
    text = path if path.startswith("/") else "//" + path.removeprefix("./")
    at, here = 0, [root]
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"XPath {path!r} is not supported")
        at, found = m.end(), []
        for e in here:
            # positions count among the matching children of one parent
            parents = [e, *e.walk()] if m[1] == "//" else [e]
            for p in parents:
                own = [c for c in p.elements() if m[2] in ("*", c.tag)]
                for test in re.findall(r"\[([^\]]*)\]", m[3]):
                    own = _predicate(own, test.strip(), path)
                found += own
        seen: set[int] = set()
        here = [e for e in found if not (id(e) in seen or seen.add(id(e)))]
    order = {id(e): i for i, e in enumerate(root.walk())}
    return sorted(here, key=lambda e: order[id(e)])


def _predicate(found: list[Element], test: str, path: str) -> list[Element]:
    if test.isdigit():
        return found[int(test) - 1 : int(test)] if int(test) else []
    if m := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*([\"'])(.*)\2)?", test):
        return [e for e in found if m[1] in e.attrs and (m[2] is None or e.attrs[m[1]] == m[3])]
    if m := re.fullmatch(r"contains\(\s*@([\w:-]+)\s*,\s*([\"'])(.*)\2\s*\)", test):
        return [e for e in found if m[3] in e.attrs.get(m[1], "")]
    raise ValueError(f"XPath {path!r} is not supported")


def main_text(page: str) -> str:
    """Blocks of text outside navigation and the like that are long or rich in text rather than links; headings before them stay."""
    lines: list[tuple[str, str, int]] = []

    def flush(tag, parts, linked):
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            lines.append((tag, text, linked))

    def visit(e: Element) -> None:
        # an explicit stack: pages can be nested deeper than Python calls
        parts: list[str] = []
        linked, tag = 0, e.tag
        stack: list = [(e, iter(e.children), e.tag == "a")]
        while stack:
            node, children, in_link = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if node.tag in BLOCK:
                    flush(tag, parts, linked)
                    parts, linked, tag = [], 0, stack[-1][0].tag if stack else ""
            elif isinstance(child, str):
                parts.append(child)
                linked += len(child.strip()) if in_link else 0
            elif child.tag not in SILENT and child.tag not in CHROME and not BOILERPLATE.search(f"{child.attrs.get('class', '')} {child.attrs.get('id', '')}"):
                if child.tag in BLOCK:
                    flush(tag, parts, linked)
                    parts, linked, tag = [], 0, child.tag
                stack.append((child, iter(child.children), in_link or child.tag == "a"))
        flush(tag, parts, linked)

    visit(parse(page))
    good = [2 * linked <= len(text) and (len(text) >= 40 or tag in ("p", "li", "td", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")) for tag, text, linked in lines]
    return "\n".join(text for (_, text, _), keep in zip(lines, good, strict=True) if keep)
