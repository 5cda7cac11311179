"""A small tolerant reader of HTML: elements, their text blocks, and hashes of their subtrees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import xxhash

COMMENT_END = re.compile(r"-->|\Z")
NAME_END = re.compile(r"[\s/>]|\Z")
SPECIAL = re.compile(r"[>\"']|\Z")
LETTER = re.compile(r"[a-zA-Z]")
# A tag without a further < in it; whether or not it matches, no more than up to the next < is read.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
# names of a layout, like has-sidebar: they tell of something inside or beside
LAYOUT = frozenset("has with without no".split())
WORD_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot dd dt li legend summary figcaption".split())
# an opening tag on the left ends an open element on the right, up to the given container
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
}


class Element:
    __slots__ = ("attrs", "block", "depth", "hash", "inside", "name", "parent")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.depth = parent.depth + 1 if parent is not None else 0
        # the nearest block around its contents, the root if there is none
        self.block: Element = self if parent is None or name in BLOCKS else parent.block
        self.inside: list[Element | str] = []
        self.hash = 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)}


class _Tags:
    """Ends of tags, found without reading any stretch of the page again and again.

    What follows a position is searched once and remembered for all positions before what was
    found; quotes are followed once each, whatever tag they were met from.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.seen = {NAME_END: (0, -1), SPECIAL: (0, -1)}
        self.ends: dict[int, int] = {}  # place of a quote met outside of quotes -> place of the tag's end, -1 for none

    def _next(self, what: re.Pattern, at: int) -> int:
        low, found = self.seen[what]
        if not low <= at <= found:
            found = what.search(self.page, at).start()
            self.seen[what] = (at, found)
        return found

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin here; -1 if it never ends."""
        met: list[int] = []
        while True:
            at = self._next(SPECIAL, at)
            if at >= len(self.page):
                found = -1
            elif self.page[at] == ">":
                found = at
            elif at in self.ends:
                found = self.ends[at]
            else:
                met.append(at)
                close = self.page.find(self.page[at], at + 1)
                if close >= 0:
                    at = close + 1
                    continue
                found = -1
            self.ends.update(dict.fromkeys(met, found))
            return found

    def read(self, at: int) -> tuple[str, str, int] | None:
        """Name, attributes and end of the tag whose name begins here, or nothing if it never ends."""
        if at > self.last or not LETTER.match(self.page, at):
            return None
        stop = self._next(NAME_END, at)
        end = self.end(stop)
        return None if end < 0 else (self.page[at:stop].lower(), self.page[stop:end], end + 1)


class _Open:
    """The open elements, by name too, so that none has to be looked for among its inner ones."""

    def __init__(self):
        self.root = self.node = Element("", "", None)
        self.named: dict[str, list[Element]] = {}

    def enter(self, made: Element) -> None:
        self.node = made
        self.named.setdefault(made.name, []).append(made)

    def leave_to(self, outer: Element) -> None:
        """Close everything inside ``outer``; each element is closed once."""
        while self.node is not outer:
            self.named[self.node.name].pop()
            self.node = self.node.parent

    def close(self, name: str) -> None:
        if found := self.named.get(name):
            self.leave_to(found[-1].parent)

    def _innermost(self, names: list[str] | tuple[str, ...]) -> Element:
        return max((self.named[n][-1] for n in names if self.named.get(n)), key=lambda e: e.depth, default=self.root)

    def make_room(self, name: str) -> None:
        """Implied ends before an element of this name opens."""
        if self.node.block.name == "p" and name in CLOSES_P:
            self.leave_to(self.node.block.parent)
        if name not in ENDS:
            return
        ended, containers = ENDS[name]
        around = self._innermost(containers).depth
        if name == "tr" and self._innermost(["tr"]).depth > around:
            self.leave_to(self._innermost(["tr"]).parent)
            return
        while (found := self._innermost(ended)).depth > around:
            self.leave_to(found.parent)
            if name != "tr":
                return


def parse(page: str) -> Element:
    """The tree of a page, in one pass. Stray end tags are ignored, open elements end with their parent.

    A ``<`` that begins no tag, or a tag that never ends, is text.
    """
    tags, tree = _Tags(page), _Open()
    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            tree.node.inside.append(page[at:mark])
            at = mark
            continue
        if plain := PLAIN_TAG.match(page, at):
            closes, name, attrs = plain.groups()
            name, at = name.lower(), plain.end()
        elif page.startswith("<!--", at):
            at = COMMENT_END.search(page, at + 4).end()
            continue
        elif page.startswith(("<!", "<?"), at):
            over = page.find(">", at)
            at = over + 1 if over >= 0 else end
            continue
        else:
            closes = page.startswith("</", at)
            found = tags.read(at + 1 + closes)
            if found is None:
                tree.node.inside.append("<")
                at += 1
                continue
            name, attrs, at = found
        if closes:
            tree.close(name)
            continue
        tree.make_room(name)
        made = Element(name, attrs, tree.node)
        tree.node.inside.append(made)
        if name in VOID or attrs.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            made.inside.append(page[at:stop])
            at = stop
            if close:
                over = page.find(">", stop)
                at = over + 1 if over >= 0 else end
            continue
        tree.enter(made)
    return tree.root


def hash_subtrees(root: Element) -> None:
    """Set ``hash`` of every element: its name and, in order, its texts and elements; not its attributes."""
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(x, False) for x in node.inside if isinstance(x, Element)]
            continue
        parts = [node.name.encode()]
        for x in node.inside:
            if isinstance(x, str):
                text = SPACE.sub(" ", x).strip()
                if text:
                    parts.append(b"t" + text.encode("utf-8", "surrogatepass"))
            else:
                parts.append(b"e" + x.hash.to_bytes(8, "little"))
        node.hash = xxhash.xxh3_64_intdigest(b"\0".join(parts))


def elements(root: Element) -> Iterator[Element]:
    stack = [x for x in reversed(root.inside) if isinstance(x, Element)]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.inside) if isinstance(x, Element)]


def name_words(attributes: dict[str, str]) -> set[str]:
    """``class``, ``id`` and ``role`` in lower-case words: ``siteHeader-main`` has site, header and main.

    A name with a word like ``has`` or ``with`` is left out.
    """
    out: set[str] = set()
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = {w.lower() for w in WORD_PARTS.findall(name)}
        if not words & LAYOUT:
            out |= words
    return out


def tidy(texts: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(texts))).strip()
