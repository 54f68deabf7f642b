"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer that keeps blocks, lists and tables.

All visible text comes out, in document order. Blocks start on lines of their own, paragraphs and the like stand between
blank lines, list items have their markers and depth, and the cells of a table line up in columns. Pages are independent:
one pass, no shuffle, memory for one page at a time.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import slices

CHUNK_BYTES = 4 << 20
# Element sets of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist area base link meta param source track col colgroup rp".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr caption ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul fieldset listing dir hr".split())
SVG_UNSEEN = frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: What stands between the parts of a formula that are not in one line.
MATH_BETWEEN = {"mfrac": "/", "msup": "^", "mover": "^", "msub": "_", "munder": "_", "msubsup": "_^", "munderover": "_^", "mtr": "  ", "mtable": "  "}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
SCOPE = frozenset("table td th caption html template object button".split())
#: An opening tag on the left ends the nearest open element of the first set, unless one of the second set is nearer.
ENDS = {
    "li": (frozenset(["li"]), LISTS | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"]) | SCOPE),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select"]) | SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "caption": (frozenset(["caption"]), frozenset(["table"])),
}

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Where the text of an element of ``RAW`` ends.
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I | re.A) for t in RAW}
SPACE = re.compile(r"[ \t\n\r\f]+")
SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
CSS_MARK = re.compile(r"""[{};]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
AT_RULE = re.compile(r"@([\w-]+)\s*(.*)", re.S)
#: A media query that every screen meets; with a condition on its size or the like, some screens show the text.
SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+(?!all\b|screen\b)[\w-]+)?\Z", re.I)
COMPOUND = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#]-?[A-Za-z_][\w-]*)*)\Z")
PART = re.compile(r"[.#][\w-]+")
INHERITED = ("inherit", "unset", "revert")


class Node:
    """An element; ``gone``: it and all in it are not rendered; ``veiled``: its own text is not."""

    __slots__ = ("tag", "attrs", "kids", "gone", "veiled")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.gone, self.veiled = tag, attrs, [], False, False

    def get(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        out: dict[str, str] = {}
        for name, a, b, c in ATTRIBUTE.findall(self.attrs):
            out.setdefault(name.lower(), html.unescape(a or b or c))
        return out


def _screen(media: str) -> bool:
    return any(SCREEN.match(x.strip()) for x in media.split(","))


def _applies(at_rule: str) -> bool:
    """Whether the rules in the block of an at-rule hold on every screen."""
    m = AT_RULE.match(at_rule)
    name, rest = (m[1].lower(), m[2].strip()) if m else ("", "")
    return name == "layer" or (name == "media" and _screen(rest)) or (name == "supports" and not rest.lower().startswith("not"))


class Styles:
    """The rules on display and visibility that hold on every screen, by what the last part of their selectors names.

    Selectors are made of tags, classes and ids, joined by blanks and ``>``; rules with others are left out, as are those nested
    in rules, which hold for some elements only.
    """

    def __init__(self):
        self.rules: dict[str, list[tuple]] = {}
        self.n = 0

    def read(self, css: str) -> None:
        css = CSS_COMMENT.sub("", css)
        css += "}" * css.count("{")
        # of each open block: whether its rules count, its selectors if it is a rule, its declarations
        open_: list[tuple[bool, str, list[str]]] = [(True, "", [])]
        start = 0
        for m in CSS_MARK.finditer(css):
            if m[0] not in "{};":
                continue
            part, start = css[start : m.start()].strip(), m.end()
            if m[0] == "{":
                if part.startswith("@"):
                    open_.append((open_[-1][0] and _applies(part), "", []))
                else:
                    open_.append((False, part if open_[-1][0] else "", []))
                continue
            open_[-1][2].append(part)
            if m[0] == "}" and len(open_) > 1:
                _, names, body = open_.pop()
                if names and (found := SHOWING.findall(";".join(body))):
                    for name in names.split(","):
                        self._add(name.strip(), found)

    def _add(self, selector: str, found: list[tuple[str, str, str]]) -> None:
        steps, ids, classes, tags, direct = [], 0, 0, 0, False
        for word in selector.replace(">", " > ").split():
            if word == ">":
                direct = True
                continue
            m = COMPOUND.match(word)
            if m is None:
                return
            parts = PART.findall(m[2])
            tag = (m[1] or "*").lower()
            ids, classes, tags = ids + sum(p[0] == "#" for p in parts), classes + sum(p[0] == "." for p in parts), tags + (tag != "*")
            steps.append((tag, frozenset(parts), direct))
            direct = False
        if not steps:
            return
        tag, parts, _ = steps[-1]
        self.n += 1
        for prop, value, important in found:
            rank = (bool(important), False, ids, classes, tags, self.n)
            self.rules.setdefault(min(parts, default=tag), []).append((steps, prop.lower(), rank, value.lower()))
            self.n += 1

    def of(self, path: list[tuple[str, frozenset]], inline: str) -> dict[str, str]:
        """display and visibility as the rules and a style attribute set them for the element at the end of ``path``."""
        best: dict[str, tuple] = {}
        tag, parts = path[-1]
        for key in ("*", tag, *parts):
            for steps, prop, rank, value in self.rules.get(key, ()):
                if (prop not in best or best[prop][0] < rank) and _matches(steps, path):
                    best[prop] = (rank, value)
        for k, (prop, value, important) in enumerate(SHOWING.findall(inline)):
            rank = (bool(important), True, 0, 0, 0, k)
            if prop.lower() not in best or best[prop.lower()][0] < rank:
                best[prop.lower()] = (rank, value.lower())
        return {prop: value for prop, (_, value) in best.items()}


def _fits(step: tuple, element: tuple[str, frozenset]) -> bool:
    return step[0] in ("*", element[0]) and step[1] <= element[1]


def _matches(steps: list[tuple], path: list[tuple[str, frozenset]]) -> bool:
    """Whether the last element of ``path`` meets the selector: each step stands in the path, the last one at its end."""
    if not _fits(steps[-1], path[-1]):
        return False
    # places where the step at hand may stand, from the last one back
    at = {len(path) - 1}
    for k in range(len(steps) - 2, -1, -1):
        if steps[k + 1][2]:
            at = {i - 1 for i in at if i and _fits(steps[k], path[i - 1])}
        else:
            top = max(at)
            at = {i for i in range(top) if _fits(steps[k], path[i])}
        if not at:
            return False
    return True


def show(root: Node, styles: Styles) -> int:
    """Mark what is gone and what is veiled in the tree; its depth."""
    path: list[tuple[str, frozenset]] = []
    todo: list[tuple[Node, int, bool, bool]] = [(root, 0, False, False)]
    deepest = 0
    while todo:
        node, depth, veiled, drawn = todo.pop()
        deepest = max(deepest, depth)
        del path[depth:]
        attrs = node.get()
        names = frozenset("." + c for c in attrs.get("class", "").split()) | ({"#" + attrs["id"]} if attrs.get("id") else set())
        path.append((node.tag, names))
        drawn = drawn or node.tag == "svg"
        set_ = styles.of(path, attrs.get("style", "")) if styles.rules or "style" in attrs else {}
        display = set_.get("display") or (attrs.get("display", "").lower() if drawn else "")
        if not display or display in INHERITED:
            closed = "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs)
            display = "none" if closed else ""
        node.gone = node.tag in UNSEEN or display == "none" or (node.tag == "input" and attrs.get("type", "").lower() == "hidden")
        visibility = set_.get("visibility") or (attrs.get("visibility", "").lower() if drawn else "")
        node.veiled = veiled if not visibility or visibility in INHERITED else visibility in ("hidden", "collapse")
        if not node.gone:
            todo += [(kid, depth + 1, node.veiled, drawn) for kid in node.kids if not isinstance(kid, str)]
    return deepest


def parse(page: str) -> tuple[Node, Styles]:
    """The tree of a page, with implied tags, and its styles. Elements may be nested to any depth."""
    root = Node("html")
    open_ = [root]
    held: Counter[str] = Counter()  # open elements by tag
    styles = Styles()
    at = 0

    def drop(i: int) -> None:
        held.subtract(n.tag for n in open_[i:])
        del open_[i:]

    def close(targets: frozenset, stops: frozenset) -> None:
        if not any(held[t] for t in targets):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in targets:
                drop(i)
                return
            if open_[i].tag in stops:
                return

    def foreign() -> bool:
        """Whether the innermost of these is svg or math, where a slash ends an element."""
        if not held["svg"] and not held["math"]:
            return False
        return next((n.tag for n in reversed(open_) if n.tag in ("svg", "math", "foreignobject")), "foreignobject") != "foreignobject"

    def put(node: Node, holds: bool = True) -> None:
        open_[-1].kids.append(node)
        if holds:
            open_.append(node)
            held[node.tag] += 1

    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            open_[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in HEADINGS:
                close(HEADINGS, SCOPE)
            elif tag in ("body", "html"):
                continue
            else:
                close(frozenset((tag,)), SCOPE - {tag} if tag not in ENDS and tag != "table" else frozenset(("table",)) - {tag})
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close(frozenset(("head",)), frozenset())
                if m[3]:
                    put(Node(tag, m[3]))
            continue
        if open_[-1].tag == "head" and tag not in HEAD_ONLY:
            drop(len(open_) - 1)
        if tag in CLOSES_P:
            close(frozenset(("p",)), SCOPE)
        if tag in HEADINGS and open_[-1].tag in HEADINGS:
            drop(len(open_) - 1)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            put(Node("tr"))
        node = Node(tag, m[3])
        put(node, tag not in VOID and not (m[3].endswith("/") and (tag in ("svg", "math") or foreign())))
        if tag in RAW and open_[-1] is node:
            end = RAW_END[tag].search(page, at)
            text = page[at : end.start()] if end else page[at:]
            at = end.start() if end else len(page)
            if tag == "style":
                if _screen(node.get().get("media", "")):
                    styles.read(text)
            elif tag == "textarea":
                node.kids.append(text)
    if at < len(page):
        open_[-1].kids.append(page[at:])
    return root, styles


class Lines:
    """Finished lines and the inline text of the line under way."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if "&" in s:
            s = html.unescape(s)
        if pre:
            *whole, last = s.replace("\r\n", "\n").split("\n")
            for x in whole:
                self.now.append(x)
                self.end(keep=True, raw=True)
            self.now.append(last)
        else:
            self.now.append(SPACE.sub(" ", s))

    def end(self, keep: bool = False, raw: bool = False) -> None:
        """End the line; an empty one only counts if it is to be kept (a line break)."""
        s = "".join(self.now)
        s = s.rstrip() if raw else re.sub("  +", " ", s).strip(" \t\n\r\f")
        self.now = []
        if s or keep:
            self.put([s])

    def put(self, lines: list[str]) -> None:
        if self.gap and self.done and lines:
            self.done.append("")
        self.gap = False
        self.done += lines

    def block(self, lines: list[str], spaced: bool) -> None:
        self.end()
        if lines:
            self.gap |= spaced
            self.put(lines)
            self.gap = spaced


def _number(value: str | None, other: int) -> int:
    return int(m[0]) if value and (m := re.match(r"\s*-?\d{1,9}", value)) else other


def render(node: Node, pre: bool = False) -> list[str]:
    """The lines of a block element."""
    out = Lines()
    _fill(out, node, pre)
    out.end(raw=pre)
    while out.done and not out.done[-1]:
        out.done.pop()
    while out.done and not out.done[0]:
        out.done.pop(0)
    return out.done


def _fill(out: Lines, node: Node, pre: bool) -> None:
    number = None
    if node.tag in LISTS:
        number = _number(node.get().get("start"), 1) if node.tag == "ol" else None
    closed = node.tag == "details" and "open" not in node.get()
    for kid in node.kids:
        if isinstance(kid, str):
            if not closed:
                # what is veiled keeps its place
                out.text(" " if node.veiled else kid, pre and not node.veiled)
            continue
        tag = kid.tag
        if kid.gone or (closed and tag != "summary"):
            continue
        elif tag == "br":
            if not kid.veiled:
                out.end(keep=True, raw=pre)
        elif tag == "hr":
            if not kid.veiled:
                out.block(["---"], True)
        elif tag == "li":
            mark = "- "
            if number is not None:
                number = _number(kid.get().get("value"), number)
                mark, number = f"{number}. ", number + 1
            lines = render(kid, pre)
            if kid.veiled:
                out.block(lines, False)
                continue
            lines = lines or [""]
            out.block([(mark if i == 0 else " " * len(mark)) + x if x or not i else "" for i, x in enumerate(lines)], False)
        elif tag == "table":
            out.block(_table(kid, pre), True)
        elif tag in ("blockquote", "dd"):
            out.block([("  " + x) if x else "" for x in render(kid, pre)], tag in SPACED)
        elif tag in BLOCK:
            inside = node.tag == "li" and tag in LISTS
            out.block(render(kid, pre or tag in ("pre", "listing", "plaintext", "xmp")), tag in SPACED and not inside)
        elif tag == "input":
            if kid.veiled:
                continue
            attrs = kid.get()
            if attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search"):
                out.text(html.escape(" " + attrs.get("value", "") + " ", quote=False), pre)
        elif tag == "svg":
            _svg(out, kid, pre)
        elif tag == "math":
            _math(out, kid)
        elif tag == "q":
            mark = "" if kid.veiled else '"'
            out.now.append(mark)
            _fill(out, kid, pre)
            out.now.append(mark)
        else:
            _fill(out, kid, pre)


def _svg(out: Lines, node: Node, pre: bool, shown: bool = False) -> None:
    """The text elements of a drawing and the HTML in it, spaces around each; other character data is not drawn."""
    for kid in node.kids:
        if isinstance(kid, str):
            if shown and not node.veiled:
                out.text(kid, False)
            continue
        if kid.tag in SVG_UNSEEN or kid.gone:
            continue
        if kid.tag == "foreignobject":
            out.block(render(kid, pre), False)
        elif kid.tag == "text":
            out.text(" ", False)
            _svg(out, kid, pre, True)
            out.text(" ", False)
        else:
            _svg(out, kid, pre, shown)


def _math(out: Lines, node: Node) -> None:
    """A formula in one line."""
    between, n = MATH_BETWEEN.get(node.tag, ""), 0
    for kid in node.kids:
        if isinstance(kid, str):
            if not node.veiled:
                out.text(kid.strip() if between else kid, False)
            continue
        if kid.tag in MATH_UNSEEN or kid.gone:
            continue
        if between and n:
            out.text(between[min(n, len(between)) - 1], False)
        n += 1
        _math(out, kid)


def _rows(node: Node) -> tuple[list[Node], list[Node]]:
    """Rows and everything else (captions, stray content) of a table."""
    rows, other = [], []
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                stray = Node("span")
                stray.veiled = node.veiled
                stray.kids.append(kid)
                other.append(stray)
        elif not kid.gone:
            if kid.tag == "tr":
                rows.append(kid)
            elif kid.tag in ("thead", "tbody", "tfoot"):
                more, rest = _rows(kid)
                rows += more
                other += rest
            else:
                other.append(kid)
    return rows, other


def _table(node: Node, pre: bool) -> list[str]:
    """Captions and stray content first, then the rows, cells padded to their columns and two spaces apart."""
    rows, other = _rows(node)
    before = Node("div")
    before.kids = other
    lines = render(before, pre) if other else []
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        cells, col = [], 0
        for kid in row.kids:
            if isinstance(kid, str):
                if kid.strip():
                    kid, text = Node("td"), kid
                    kid.veiled = row.veiled
                    kid.kids.append(text)
                else:
                    continue
            if kid.gone:
                continue
            while taken.get(col, 0):
                col += 1
            attrs = kid.get()
            wide, high = min(max(_number(attrs.get("colspan"), 1), 1), 1000), min(max(_number(attrs.get("rowspan"), 1), 1), 65534)
            cells.append((col, wide, render(kid, pre)))
            for c in range(col, col + wide):
                if high > 1:
                    taken[c] = high
            col += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for col, wide, text in cells:
            if wide == 1:
                width[col] = max(width.get(col, 0), *map(len, text or [""]))
    for cells in grid:
        for k, (col, wide, text) in enumerate(cells):
            if wide > 1 and k < len(cells) - 1:
                lack = max(map(len, text or [""])) - sum(width.get(c, 0) + 2 for c in range(col, col + wide)) + 2
                if lack > 0:
                    width[col + wide - 1] = width.get(col + wide - 1, 0) + lack
    for cells in grid:
        for i in range(max((len(text) for _, _, text in cells), default=0)):
            line = ""
            for col, _, text in cells:
                if i < len(text):
                    line = line.ljust(sum(width.get(c, 0) + 2 for c in range(col))) + text[i]
            lines.append(line.rstrip())
    return lines


def extract(page: str | None) -> str:
    """The visible text of a page, lines joined by \\n; null and empty pages give an empty text."""
    if not page:
        return ""
    tree, styles = parse(page)
    # Python's own calls take no C stack: two or three for each level of the tree
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * show(tree, styles) + 1000))
    return "\n".join(render(tree))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page; malformed markup is rendered as far as it can be, an unclosed tag is dropped.

    Rows, repeated ones too, stay; other columns are ignored; an empty table gives an empty one.
    """
    plain = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", CHUNK_BYTES):
            texts = pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], names=["page_id", "url", "text"])

    kinds = dict(plain.dtypes)
    return plain.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


op10 = extract_pages
