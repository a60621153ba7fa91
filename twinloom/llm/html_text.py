"""Visible text of HTML pages, laid out.

A tree is built from the tags, closing and opening what HTML implies; what
browsers do not show is left out (head, scripts, templates, comments, ``hidden``,
closed ``details`` and ``dialog``, and what ``display`` and ``visibility`` hide,
inline or by the rules of the page's own style sheets that select by one tag,
class or id; the last rule of the highest rank wins, and rules for other media
than a screen of 1280 pixels do not count). Blocks are set apart by line breaks, paragraphs and
the like by an empty line; list items have marks and indentation; the cells of a
table are padded to columns, also below cells that span rows; ``pre`` keeps its
white space. Of drawings and formulas their texts are shown, a line for each text
of a drawing, a space between the parts of a fraction and the like.

Edge cases: a null page gives null, an empty one the empty text; text that is no
HTML comes out as it is, white space collapsed; tags nested beyond 400 are read
as if they stood at that depth; rows that repeat are rendered each; other columns
are not looked at.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 400

# Names of elements by their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
NOT_SHOWN = frozenset("head script style template noscript iframe object datalist audio video canvas area base link meta param title".split())
#: In drawings and formulas: elements that are not drawn, and those whose own characters are not.
NOT_DRAWN = frozenset("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
SHAPES = frozenset("svg g path rect circle ellipse line polyline polygon use image switch".split())
#: In formulas: elements whose parts stand above each other or raised.
STACKED = frozenset("mfrac msup msub msubsup mroot munder mover munderover mmultiscripts mtr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav section summary caption option optgroup tr thead tbody tfoot td th".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr thead tbody tfoot caption option optgroup html body".split())
#: What a tag closes if it is open, and the elements that bound the search.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
HEAD_ONLY = frozenset("head title meta link base script style noscript template".split())
BOUNDS = frozenset("table td th caption html body button".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_PARTS = re.compile(r"[{};]|[^{};]+")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*(\d+)\s*px", re.I)
SCREEN = 1280
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$", re.I)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_MARKS = str.maketrans("", "", "\x01\x02\x03")
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "visible")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.visible = tag, attrs, [], True


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def build(html: str) -> tuple[Node, str]:
    """The tree of a page and the text of its style sheets."""
    root = Node("#root", {})
    open_, styles, at = [root], [], 0

    def close(names: frozenset, bounds: frozenset) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in names:
                # an outer one may be open too: <tr> closes the cell and its row
                del open_[i:]
                return close(names, bounds)
            if open_[i].tag in bounds:
                return None
        return None

    def foreign() -> bool:
        return any(x.tag in ("svg", "math") for x in open_)

    def push(tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if tag not in VOID and not closed and len(open_) < MAX_DEPTH:
            open_.append(node)

    def add_text(text: str) -> None:
        if text:
            if open_[-1].tag == "head" and text.strip():
                open_.pop()
            if open_[-1].tag in SHAPES and foreign():
                return
            open_[-1].children.append(unescape(text))

    n, last = len(html), html.rfind(">")
    while at < n:
        m = _TAG.search(html, at) if at <= last or html.find("<!", at) >= 0 else None
        if not m:
            add_text(html[at:])
            break
        add_text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                add_text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "p" and not any(x.tag == "p" for x in open_):
                push("p", {})
            if tag == "br":
                push("br", {})
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        source = m[3] if m[2] else m[6]
        if open_[-1].tag == "head" and tag not in HEAD_ONLY:
            open_.pop()
        if tag in CLOSES_P:
            close(frozenset(["p"]), BOUNDS)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})
        attrs = _attributes(source) if source.strip() else {}
        if tag in NOT_DRAWN and foreign():
            attrs["hidden"] = ""
        closed = source.endswith("/") and bool(_SELF_CLOSED.search(source)) and (tag in ("svg", "math") or foreign())
        push(tag, attrs, closed)
        if closed:
            continue
        if tag in RAW or tag == "title" or tag == "textarea":
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            body = html[at : end.start() if end else n]
            if tag == "style":
                styles.append(body)
            elif tag in ("title", "textarea"):
                open_[-1].children.append(unescape(body))
            at = end.end() if end else n
            if open_[-1].tag == tag:
                open_.pop()
    return root, "\n".join(styles)


def _on_screen(query: str) -> bool:
    """Whether a media query, or one of its list, holds for a screen of SCREEN pixels."""
    for q in query.lower().split(","):
        turned = q.strip().startswith("not ")
        other = re.search(r"\b(print|speech|aural|braille|embossed|handheld|projection|tty|tv)\b", q)
        fits = not other and all((SCREEN >= int(n)) if kind == "min" else (SCREEN <= int(n)) for kind, n in _WIDTH.findall(q))
        if fits != turned:
            return True
    return False


def rules_of(css: str) -> dict[str, list[tuple]]:
    """Rules that show or hide, by the tag, ".class" or "#id" they select: (rank, required tag, property, value)."""
    out: dict[str, list[tuple]] = {}
    level: list[bool] = []  # whether the at-rules around hold
    before, order, skip = "", 0, 0
    body: list[str] | None = None
    for part in _PARTS.findall(re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)):
        if part == "{":
            head = before.strip()
            before = ""
            if head.startswith("@") and body is None:
                name = head[1:].split(None, 1)[0].split("(")[0].lower() if len(head) > 1 else ""
                level.append(name in ("supports", "layer", "container", "scope") or name == "media" and _on_screen(head[6:]))
                skip += name not in ("media", "supports", "layer", "container", "scope")
            elif body is None:
                selectors, body = head, []
            else:
                skip += 1  # nested rules select more narrowly than one tag, class or id
                level.append(False)
        elif part == "}":
            if body is not None and not (level and skip and not level[-1] and before is None):
                body.append(before)
                if all(level):
                    found = _DECLARED.findall(";".join(body))
                    for s in selectors.split(",") if found else ():
                        m = _SIMPLE.match(s.strip())
                        if m and (m[1] or m[2]):
                            order += 1
                            rank = {"#": 100, ".": 10}.get(m[2], 0) + bool(m[1])
                            key = m[2] + m[3] if m[2] else m[1].lower()
                            for prop, value, important in found:
                                out.setdefault(key, []).append(((bool(important), rank, order), (m[1] or "").lower(), prop.lower(), value.lower()))
                body = None
            elif level:
                level.pop()
            before = ""
        elif part == ";":
            if body is not None:
                body.append(before)
            before = ""
        else:
            before += part
    return out


class Layout:
    """Text of a tree. Lines are gathered in ``out``; ``gap`` is what must stand before the next piece."""

    def __init__(self, css: str):
        self.rules = rules_of(css) if css else {}

    def style(self, node: Node) -> dict[str, str]:
        """The values of display and visibility that are declared for a node."""
        best: dict[str, tuple] = {}
        a = node.attrs
        if self.rules:
            for key in (node.tag, *("." + c for c in a.get("class", "").split()), "#" + a.get("id", "")):
                for rank, tag, prop, value in self.rules.get(key, ()):
                    if tag in ("", node.tag) and best.get(prop, ((False, -1, 0),))[0] < rank:
                        best[prop] = rank, value
        if "style" in a:
            for i, (prop, value, important) in enumerate(_DECLARED.findall(a["style"])):
                rank = bool(important), 1000, i
                if best.get(prop.lower(), ((False, -1, 0),))[0] < rank:
                    best[prop.lower()] = rank, value.lower()
        return {k: v for k, (_, v) in best.items()}

    def shown(self, node: Node, visible: bool) -> bool:
        """Whether a node takes part, given whether what is around it is visible; sets whether its own text is."""
        node.visible = visible
        if node.tag in NOT_SHOWN:
            return False
        a = node.attrs
        hidden = "hidden" in a or (node.tag == "dialog" and "open" not in a)
        if not a and not self.rules:
            return not hidden
        style = self.style(node)
        if "visibility" in style:
            node.visible = style["visibility"] not in ("hidden", "collapse") if style["visibility"] != "inherit" else visible
        return style["display"] != "none" if "display" in style else not hidden

    def text(self, node: Node) -> str:
        pieces: list[str] = []
        self.flow(node, pieces, False)
        return self.join(pieces)

    @staticmethod
    def join(pieces: list[str]) -> str:
        """``pieces`` are texts and the marks \\x01 (line) and \\x02 (empty line); spaces at line ends go.

        A text that begins with \\x03 keeps its leading space.
        """
        out: list[str] = []
        gap = 0
        for p in pieces:
            if p == "\x01":
                gap = max(gap, 1)
            elif p == "\x02":
                gap = 2
            elif p:
                if p[0] == "\x03":  # laid out already
                    p = p[1:]
                elif gap or not out:
                    p = p[1:] if p[0] == " " else p
                elif p[0] == " " and out[-1][-1:] in (" ", "\n"):
                    p = p[1:]
                if not p:
                    continue
                if gap and out:
                    out[-1] = out[-1].rstrip(" ")
                    out.append("\n" * gap)
                gap = 0
                out.append(p)
        text = "".join(out)
        return re.sub(r" +\n", "\n", text).rstrip(" ").strip("\n") if out else ""

    def flow(self, node: Node, out: list[str], pre: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not node.visible:
                    continue
                out.append(child.replace("\r\n", "\n").translate(_MARKS) if pre else _SPACE.sub(" ", child).translate(_MARKS))
            elif self.shown(child, node.visible):
                self.element(child, out, pre)

    def element(self, node: Node, out: list[str], pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            out.append("\n")
            return
        mark = "\x02" if tag in PARAGRAPHS else "\x01" if tag in BLOCKS or tag == "text" else ""
        if mark:
            out.append(mark)
        if tag == "hr":
            out.append("---")
        elif tag == "table":
            out.append("\x03" + self.table(node))
        elif tag in ("ul", "ol", "menu", "dir"):
            out.append(self.listing(node))
        elif tag == "details" and "open" not in node.attrs:
            for c in node.children:
                if isinstance(c, Node) and c.tag == "summary" and self.shown(c, node.visible):
                    self.flow(c, out, pre)
        elif tag == "dd":
            out.append("\x03  " + self.text(node).replace("\n", "\n  "))
        elif tag == "pre":
            inner: list[str] = []
            self.flow(node, inner, True)
            out.append("\x03" + "".join(x.lstrip("\x03") for x in inner if x not in ("\x01", "\x02")).strip("\n"))
        elif tag in STACKED:
            for i, c in enumerate(c for c in node.children if isinstance(c, Node) and self.shown(c, node.visible)):
                out.append(" " if i else "")
                self.element(c, out, pre)
        elif tag == "q":
            out.append("“")
            self.flow(node, out, pre)
            out.append("”")
        else:
            self.flow(node, out, pre)
        if mark:
            out.append(mark)

    def listing(self, node: Node) -> str:
        ordered = node.tag == "ol"
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        lines = []
        for child in node.children:
            if isinstance(child, str):
                if child.strip() and node.visible:
                    lines.append(_SPACE.sub(" ", child).translate(_MARKS).strip())
                continue
            if not self.shown(child, node.visible):
                continue
            text = self.text(child)
            if child.tag != "li":
                inner: list[str] = []
                self.element(child, inner, False)
                if text := self.join(inner):
                    lines.append("  " + text.replace("\n", "\n  "))
                continue
            if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                number = int(child.attrs["value"])
            mark = f"{number}. " if ordered else "- "
            number += 1
            if text or child.visible:
                lines.append(mark + re.sub(r"\n\n+", "\n", text).replace("\n", "\n" + " " * len(mark)))
        return "\n".join(lines)

    def table(self, node: Node) -> str:
        rows: list[list[str]] = []
        before: list[str] = []
        spans: list[int] = []  # rows that cells above still take, by column

        def visit(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    if c.strip() and n.visible:
                        before.append(_SPACE.sub(" ", c).translate(_MARKS).strip())
                elif not self.shown(c, n.visible):
                    continue
                elif c.tag == "tr":
                    cells: list[str] = []
                    below: dict[int, int] = {}
                    for x in c.children:
                        if isinstance(x, str):
                            if x.strip() and c.visible:
                                before.append(_SPACE.sub(" ", x).translate(_MARKS).strip())
                        elif self.shown(x, c.visible):
                            while len(cells) < len(spans) and spans[len(cells)]:
                                cells.append("")
                            column = len(cells)
                            cells.append(_SPACE.sub(" ", self.text(x)) if x.tag in ("td", "th") else self.text(x))
                            span = x.attrs.get("colspan", "1")
                            cells += [""] * (min(int(span), 100) - 1 if span.isdigit() and len(span) < 5 else 0)
                            span = x.attrs.get("rowspan", "1")
                            if span.isdecimal() and len(span) < 6 and span != "1":
                                below |= dict.fromkeys(range(column, len(cells)), int(span) - 1 if int(span) else 65534)  # 0: all rows of the group
                    rows.append(cells)
                    spans[:] = [max(0, k - 1) for k in spans] + [0] * (max(below, default=-1) + 1 - len(spans))
                    for column, k in below.items():
                        spans[column] = max(spans[column], k)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    spans.clear()
                    visit(c)
                    spans.clear()
                else:  # a caption, or content that has no place in a table: it stands before the rows
                    inner: list[str] = []
                    self.element(c, inner, False)
                    if text := self.join(inner):
                        before.append(text)

        visit(node)
        for r in rows:
            while r and not r[-1].strip():
                r.pop()
        width: list[int] = []
        for r in rows:
            width += [0] * (len(r) - len(width))
            for i, cell in enumerate(r):
                width[i] = max(width[i], len(cell))
        lines = [" | ".join(cell.ljust(width[i]) for i, cell in enumerate(r)).rstrip(" ") for r in rows]
        return "\n".join(before + [x for x in lines if x])


def render(html: str | None) -> str | None:
    if html is None:
        return None
    tree, css = build(html)
    return Layout(css).text(tree)


def extract_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """id and text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [render(x) for x in part.column(1).to_pylist()]
                yield pa.record_batch({id_col: part.column(0), "text": pa.array(texts, pa.string())})

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInArrow(run, f"{id_col} long, text string")
