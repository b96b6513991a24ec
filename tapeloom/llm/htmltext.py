"""Layout-aware text of HTML pages.

A tokenizer and a small tree builder read the page: implied tags are opened and closed (a paragraph ends
where a block begins, list items, table rows and cells end where the next begins, end tags close what is
open inside them). The renderer then emits all visible text: blocks stand on lines of their own,
paragraph-like ones with an empty line around them, list items with a bullet or number and an indent,
``pre`` keeps its white space, table cells are padded to the width of their columns, those that a cell spans included.
Options of a list and texts of an inline ``svg`` stand on lines of their own, formulas within their line. Not visible
are head content, scripts, styles, templates, comments, ``hidden`` elements (``body`` included) and those whose own style
sets ``display: none``, ``visibility: hidden`` or ``collapse``; a ``dialog`` that is not open; all but the summary of a ``details`` that is not
open; title, desc, metadata and defs of an ``svg``; annotations of a formula; a ``datalist``. A page is read as with
scripts on and media that play: ``noscript`` and what stands in ``audio``, ``video``, ``iframe`` and ``noembed`` in
case they cannot be shown is not visible. The text in an ``object`` is: it shows unless its data loads, which extraction never does.

Each page is read in its task; nothing is shuffled. Defined cases: null or empty html gives the empty text;
broken markup is read as browsers would roughly do and never raises (what an unclosed quote or comment begins reaches to the
page's end); a head ends at the first text or tag that does not belong into one; a nested table is rendered inside
its cell on one line; elements nested deeper than 200 add no further levels, but hide what they hide and keep their text; a page is
read in time linear in its length; repeated rows are read one by one; a column ``text`` is replaced, others stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.batches import add_columns, strings

# Possessive, so that a tag without an end is read once: what is open at the page's end reaches to it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^>\"']++)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?")
_INVISIBLE_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f\v]+")
_DEEPEST = 200

# Fixed values of the HTML standard: element categories.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template title noscript iframe noembed noframes audio video datalist".split())
HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
UNSEEN_INSIDE = {"svg": set("title desc metadata defs symbol".split()), "math": {"annotation", "annotation-xml"}}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure article section".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
# What an opening tag closes, and the elements that such closing does not leave.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_SCOPE = {"table", "td", "th", "html"}


class Element:
    __slots__ = ("children", "columns", "label", "line", "rows", "seen", "start", "tag")

    def __init__(self, tag: str, seen: bool = True, start: int = 1):
        self.tag, self.seen, self.start = tag, seen, start
        self.children: list[Element | str] = []
        self.label, self.line, self.columns, self.rows = "", False, 1, 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


class _Stack(list):
    """Open elements, and how many there are of each tag: what is not open is not looked for."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.open = Counter([root.tag])

    def put(self, e: Element) -> None:
        self.append(e)
        self.open[e.tag] += 1

    def close(self, tags: set[str], barrier: set[str]) -> None:
        """Pop up to and including the innermost open element of ``tags``, unless a barrier stands above it."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self) - 1, 0, -1):
            if self[i].tag in tags:
                for e in self[i:]:
                    self.open[e.tag] -= 1
                del self[i:]
                return
            if self[i].tag in barrier:
                return


def _number(text: str | None, most: int) -> int:
    return min(int(text), most) if text and re.fullmatch(r"[1-9]\d{0,8}", text.strip()) else 1


def build(page: str) -> Element:
    root = Element("html")
    stack, at, n = _Stack(root), 0, len(page)
    foreign = re.search(r"<(?:svg|math)\b", page, re.I) is not None

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                stack.close({"head"}, set())
            stack[-1].children.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            elif tag not in ("html", "body"):
                stack.close({tag}, set() if tag == "table" else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else {"td", "th", "table"})
            continue
        attributes = _attributes(m[3]) if m[3].strip(" /\n\t\r") else {}
        hidden = "hidden" in attributes or _INVISIBLE_STYLE.search(attributes.get("style", "")) is not None
        if tag in ("html", "body"):
            stack.close({"head"}, set())
            root.seen = root.seen and not hidden
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.close({"head"}, set())
        if tag in ENDS_PARAGRAPH:
            stack.close({"p"}, _SCOPE | {"li", "dd"})
        if tag in CLOSES:
            inner, barrier = CLOSES[tag]
            while True:
                before = len(stack)
                stack.close(inner, barrier)
                if len(stack) == before:
                    break
        if tag == "tr" and stack[-1].tag not in ("table", "tbody", "thead", "tfoot") and not stack.open["table"]:
            tag = "div"
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot") and len(stack) < _DEEPEST:
            row = Element("tr")
            stack[-1].children.append(row)
            stack.put(row)
        inside = next((e.tag for e in reversed(stack) if e.tag in UNSEEN_INSIDE), None) if foreign else None
        drawn = inside == "svg"
        seen = tag not in UNSEEN and tag not in UNSEEN_INSIDE.get(inside, ()) and not hidden and not (tag == "dialog" and "open" not in attributes)
        start = attributes.get("start", "")
        element = Element(tag, seen, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
        element.line = tag in ("option", "optgroup") or drawn and tag == "text"
        if tag == "optgroup":
            element.label = attributes.get("label", "")
        elif tag in ("td", "th"):
            element.columns, element.rows = _number(attributes.get("colspan"), 1000), _number(attributes.get("rowspan"), 65534)
        elif tag == "details" and "open" not in attributes:
            element.label = "closed"
        if tag == "img" and seen and attributes.get("alt"):
            stack[-1].children.append(attributes["alt"])
        if len(stack) < _DEEPEST or tag in VOID:
            stack[-1].children.append(element)
        elif seen:  # no further level: what it holds stands in the deepest one
            if tag in BLOCK:
                stack[-1].children.append(Element("br"))
            element.children = stack[-1].children
        if m[3].rstrip().endswith("/") and inside is not None:
            continue
        if tag in RAW and not (drawn and tag == "title"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            element.children.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            at = n if end is None else (page.find(">", end.start()) + 1 or n)
        elif tag not in VOID:
            stack.put(element)
    return root


class Renderer:
    """Collects lines; spacing before a block is asked for and only then made when text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = 0

    def end_line(self, gap: int = 0) -> None:
        text = "".join(self.line).strip()
        self.line = []
        if text:
            self.put(text)
        self.gap = max(self.gap, gap)

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(f"{self.indent}{self.mark}{text}")
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def text(self, s: str) -> None:
        s = _BLANK.sub(" ", s)
        if s.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.line.append(s)

    def walk(self, e: Element) -> None:
        if not e.seen:
            return
        if e.tag == "br":
            self.end_line()
        elif e.tag == "pre":
            self.end_line(1)
            for line in plain(e).strip("\n").split("\n"):
                self.put(line.rstrip())
            self.gap = 1
        elif e.tag == "table":
            self.end_line(1)
            self.table(e)
            self.gap = 1
        elif e.tag in ("ul", "ol", "menu"):
            self.items(e)
        elif e.tag == "details" and e.label:
            self.end_line()
            first = next((c for c in e.children if isinstance(c, Element) and c.tag == "summary"), None)
            if first is not None:
                self.walk(first)
            self.end_line()
        elif e.line:
            self.end_line()
            self.text(e.label)
            self.end_line()
            self.inside(e)
            self.end_line()
        elif e.tag in BLOCK:
            gap = int(e.tag in SPACED)
            self.end_line(gap)
            quoted = e.tag in ("blockquote", "dd")
            before, self.indent = self.indent, self.indent + "  " * quoted
            self.inside(e)
            self.end_line(gap)
            if quoted:
                self.indent = before
        else:
            self.inside(e)

    def inside(self, e: Element) -> None:
        for child in e.children:
            if isinstance(child, str):
                self.text(child)
            else:
                self.walk(child)

    def items(self, e: Element) -> None:
        nested = bool(self.indent or self.mark)
        self.end_line(int(not nested))
        number = e.start
        for child in e.children:
            if isinstance(child, str) or child.tag != "li":
                self.text(child) if isinstance(child, str) else self.walk(child)
            elif child.seen:
                self.end_line()
                outer, outer_mark = self.indent, self.mark
                self.mark = outer_mark + (f"{number}. " if e.tag == "ol" else "- ")
                self.gap = self.gap if number == e.start else 0
                self.inside(child)
                self.end_line()
                self.gap = 0
                self.indent, self.mark = outer, ""
                number += 1
        self.end_line(int(not nested))

    def table(self, e: Element) -> None:
        rows: list[list[tuple[str, int, int]]] = []  # text, columns and rows of every cell

        def collect(part: Element) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if child.strip():
                        self.text(child)
                        self.end_line()
                elif not child.seen:
                    continue
                elif child.tag in ("tbody", "thead", "tfoot"):
                    collect(child)
                elif child.tag == "tr":
                    rows.append([(_BLANK.sub(" ", " ".join(render(c).split())), c.columns, c.rows) for c in child.children if isinstance(c, Element) and c.seen])
                    loose = [c for c in child.children if isinstance(c, str) and c.strip()]
                    rows[-1] += [(c.strip(), 1, 1) for c in loose]
                else:  # a caption, or content that does not belong into a table
                    self.walk(child)
                    self.end_line()

        collect(e)
        # A cell over several columns takes no more of them than the fullest row has cells.
        most = max((len(row) for row in rows), default=0)
        placed: list[list[tuple[int, int, str]]] = []
        taken: dict[int, int] = {}  # column to the number of further rows that a cell above reaches into
        width: list[int] = []
        for row in rows:
            at, line = 0, []
            below = {c: k - 1 for c, k in taken.items() if k > 1}
            for text, columns, down in row:
                while at in taken:
                    at += 1
                columns = min(columns, most)
                line.append((at, columns, text))
                below |= dict.fromkeys(range(at, at + columns), down - 1) if down > 1 else {}
                at += columns
            taken = below
            width += [0] * (at - len(width))
            placed.append(line)
        for line in placed:
            for at, columns, text in line:
                if columns == 1:
                    width[at] = max(width[at], len(text))
        for line in placed:
            for at, columns, text in line:
                width[at + columns - 1] += max(0, len(text) - sum(width[at : at + columns]) - 2 * (columns - 1))
        starts = [0, *accumulate(w + 2 for w in width)]
        for line in placed:
            out = ""
            for at, _, text in line:
                if text:
                    out = out.ljust(starts[at]) + text
            if out:
                self.put(out)


def plain(e: Element) -> str:
    """Text with its white space as it stands."""
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else plain(c) if c.seen else "" for c in e.children)


def render(e: Element) -> str:
    r = Renderer()
    r.inside(e)
    r.end_line()
    return "\n".join(r.lines)


def html_to_text(page: str) -> str:
    root = build(page)
    return render(root) if root.seen else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the visible text of the page."""

    def make():
        return lambda part: [pa.array([html_to_text(p) for p in strings(part.column(html)).to_pylist()], pa.string())]

    return add_columns(pages, html, T.StructType([T.StructField("text", T.StringType())]), make)
