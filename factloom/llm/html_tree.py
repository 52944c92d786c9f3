"""Forgiving HTML parsing into flat node arrays: what the extraction model labels."""

from __future__ import annotations

import html
import re

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
#: Elements of formulas and drawings, which a slash closes; they are no nodes, their text is that of the element around them.
APART = set("annotation mtr mtd text desc foreignobject".split())
FOREIGN = APART | set("math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable menclose maction semantics".split())
FOREIGN |= set("svg g tspan textpath path rect circle ellipse line polyline polygon defs use symbol marker lineargradient radialgradient stop clippath pattern mask filter metadata image".split())
INLINE = FOREIGN - APART | set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = set("script style head title iframe textarea".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?]))")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: The rest of a tag after its name, by one scan; a > in a quoted value does not end it, an unclosed quote counts as a sign.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """Nodes in page order: tags, parents (-1 for the root), names (class and id words), own text; chunks of text in order."""

    __slots__ = ("tags", "parents", "names", "labels", "chunks")

    def __init__(self) -> None:
        self.tags, self.parents, self.names, self.labels = ["#root"], [-1], [()], [None]
        #: (node, decoded text, number of the run of one block it belongs to)
        self.chunks: list[tuple[int, str, int]] = []


def _names(attributes: str) -> tuple[tuple[str, ...], str | None]:
    found, label = [], None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            found += [w.lower() for w in _WORDS.findall(html.unescape(value))]
        elif name == "data-label":
            label = value
    return tuple(dict.fromkeys(found)), label


class _Stack:
    """The open elements (node, tag) above the root, with the places of each tag and of those that are not inline, so that no tag searches the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = [(0, "#root")]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((node, tag))

    def cut(self, depth: int) -> None:
        """Close all from ``depth`` on."""
        while len(self.open) > depth:
            _, tag = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost of ``tags``, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def block(self) -> int:
        """Place of the innermost element that is not inline, 0 if there is none."""
        return self.blocks[-1] if self.blocks else 0


def parse(source: str) -> Page:
    """Parse a page of any quality; never fails, and reads the whole of it."""
    page = Page()
    stack = _Stack()
    at, size, run = 0, len(source), 0

    def text(piece: str) -> None:
        if piece:
            page.chunks.append((stack.open[-1][0], html.unescape(piece), run))

    while at < size:
        m = _OPEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        if m.group(1):
            end = source.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        end = source.find(">", m.end())
        if m.group(4):
            at = size if end < 0 else end + 1
            continue
        tag = m.group(3).lower()
        body = source[m.end() : end if end >= 0 else size]
        if end >= 0 and ('"' in body or "'" in body):  # a > inside a quoted value
            rest = _REST.match(source, m.end())
            if rest:
                end = rest.end() - 1
                body = source[m.end() : end]
        at = size if end < 0 else end + 1
        if m.group(2):
            depth = stack.last(tag)
            if depth and not (tag in INLINE and stack.block() > depth):
                run += stack.block() >= depth
                stack.cut(depth)
            elif tag == "br" or tag == "p":
                run += tag == "p"
                text(" ")
            continue
        if tag in CLOSES_P:
            depth = stack.block()
            if depth and stack.open[depth][1] == "p":
                stack.cut(depth)
        if tag in SAME_CLOSES:
            depth = stack.last(*SAME_CLOSES[tag])
            if depth and depth > stack.last(*(SCOPES[tag] - {"#root"})):
                stack.cut(depth)
        if tag not in INLINE:
            run += 1
        if tag == "br":
            text(" ")
            continue
        if tag in FOREIGN:
            if not body.endswith("/"):
                stack.push(stack.open[-1][0], tag)
            continue
        names, label = _names(body) if body else ((), None)
        page.tags.append(tag)
        page.parents.append(stack.open[-1][0])
        page.names.append(names)
        page.labels.append(label)
        if tag in RAW and not body.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            inner = source[at : close.start() if close else size]
            if tag == "textarea" or tag == "title":
                page.chunks.append((len(page.tags) - 1, html.unescape(inner), run))
            at = close.end() if close else size
        elif tag not in VOID and not (body.endswith("/") and tag not in INLINE and tag not in CLOSES_P):
            stack.push(len(page.tags) - 1, tag)
    return page
