"""HTML extraction by layout: all visible text of a page, as a text browser would set it.

A tree is built with the tags that HTML implies, then rendered: blocks on lines of their own, paragraphs and
headings set off by blank lines, list items with bullets or numbers, and tables with aligned columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Generator, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from barograph.llm.common import table

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes object audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form article section aside header footer nav main details hr menu".split())
BLOCKS = SPACED | frozenset("html body address div li dt dd center figcaption legend hgroup dir search summary caption tr thead tbody tfoot td th option optgroup select".split())
CLOSES_P = SPACED | frozenset("address div center dir hgroup li dt dd search summary".split())
#: An opening tag ends the open elements named first, up to the ones named second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"caption", "colgroup", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"caption", "colgroup", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}
HEADS = frozenset("base link meta title style script noscript template head html".split())
#: Elements inside which a closing tag finds no opening tag further out.
WALLS = frozenset("table td th caption html body template".split())
#: Elements inside which neither </p> nor a block's opening tag finds a <p> further out.
P_WALLS = frozenset("table td th caption button template object marquee applet html mi mo mn ms mtext foreignobject".split())
#: SVG elements that draw nothing where they stand, and MathML elements that hold text or set parts apart.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask pattern marker".split())
TOKENS = frozenset("mi mo mn ms mtext".split())
APART = frozenset("mfrac msup msub msubsup munder mover munderover mmultiscripts mroot mtable mtr mlabeledtr".split())
#: HTML may stand inside these elements of SVG and MathML; elsewhere in them the tags of BREAKS end the drawing.
HOSTS = TOKENS | {"foreignobject", "desc", "title", "annotation-xml"}
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Columns and rows that a cell can take by the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Deeper elements are put beside the deepest one, as browsers do.
DEPTH = 400
TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?>(?:"[^"]*"|'[^']*'|[^"'>])*))>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
UNQUOTED = re.compile(r"""=\s*[^\s"'=]*/$""")
SPACE = re.compile(r"[ \t\n\r\f]+")
STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def build(page: str) -> Node:
    """The tree of a page. Text is unescaped; raw text elements hold their source."""
    root = Node("html", {})
    open_ = [root]

    def add(text: str) -> None:
        if text:
            if open_[-1].tag == "head" and text.strip():
                open_.pop()
            if open_[-1].tag == "table" and not text.strip():
                return
            open_[-1].kids.append(html.unescape(text) if "&" in text else text)

    def end(names: set[str], walls: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in walls:
                return
            if open_[k].tag in names:
                del open_[k:]
                return end(names, walls)

    def drawing() -> bool:
        for x in reversed(open_):
            if x.tag in HOSTS or x.tag in ("svg", "math"):
                return x.tag not in HOSTS
        return False

    at, drawings = 0, False
    while True:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            return root
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if drawings and page.startswith("<![CDATA[", m.start()) and drawing():
                stop = page.find("]]>", m.start())
                open_[-1].kids.append(page[m.start() + 9 : stop if stop >= 0 else len(page)])
                at = stop + 3 if stop >= 0 else len(page)
            continue
        if m[1] or m[4]:
            if name == "p":
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k].tag == "p" or open_[k].tag in P_WALLS), 0)
                if open_[k].tag == "p":
                    del open_[k:]
                else:
                    open_[-1].kids.append(Node("p", {}))  # a lone </p> is an empty paragraph
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == name:
                    if name != "body":
                        del open_[k:]
                    break
                if open_[k].tag in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "html"):
                    break
            continue
        text = m[3] or m[6] or ""
        attrs: dict[str, str] = {}
        if text.strip("/ \t\n\r\f"):
            for a in ATTR.finditer(text):
                attrs.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        if name == "html" and len(open_) >= 1 and open_[0] is root and not root.attrs:
            root.attrs.update(attrs)
            continue
        if open_[-1].tag == "head" and name not in HEADS:
            open_.pop()
        drawn = drawings and drawing()
        if drawn and name in BREAKS:
            while drawing():
                open_.pop()
            drawn = False
        if drawn:
            node = Node(name, attrs)
            open_[-1].kids.append(node)
            if len(open_) < DEPTH and not (text.endswith("/") and not UNQUOTED.search(text)):
                open_.append(node)
            continue
        if name in CLOSES_P:
            end({"p"}, P_WALLS)
        if name in ENDS:
            end(*ENDS[name])
        if name in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_[-1].kids.append(row := Node("tr", {}))
            open_.append(row)
        node = Node(name, attrs)
        open_[-1].kids.append(node)
        if name in ("svg", "math"):
            drawings = True
            if text.endswith("/") and not UNQUOTED.search(text):
                continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : stop.start() if stop else len(page)]
            node.kids.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = page.find(">", stop.start()) + 1 or len(page) if stop else len(page)
        elif name not in VOID and len(open_) < DEPTH:
            open_.append(node)


def width(text: str) -> int:
    """Columns that a text takes: wide letters take two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of text with pending blank lines and an open line."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.blank = False

    def text(self, s: str) -> None:
        self.open.append(s)

    def flush(self) -> None:
        if self.open:
            line = SPACE.sub(" ", "".join(self.open)).strip(" ")
            self.open = []
            if line:
                self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        self.done += lines

    def gap(self) -> None:
        self.flush()
        self.blank = True

    def take(self) -> list[str]:
        self.flush()
        return self.done


def seen(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element is laid out at all, and whether its own text is visible."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return False, False
    display = ""
    for what, value in STYLE.findall(a.get("style", "")):
        if what.lower() == "display":
            display = value.lower()
        else:
            visible = visible if value.lower() == "inherit" else value.lower() not in ("hidden", "collapse")
    return display != "none", visible and display != "none"


COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
RULE = re.compile(r"\s*(?:(@[^{};]*)([{;]|\Z)|([^{}@]+)\{([^{}]*)(?:\}|\Z)|.)", re.S)
SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)


def sheet_rules(css: str) -> list[tuple[str, frozenset[str], frozenset[str], list[tuple[str, str, bool]]]]:
    """(element or '', classes, ids, [(property, value, important)]) of a style sheet's rules for display and visibility.

    Selectors of one element, its classes and ids are read; those with relations, attributes or states aren't. Of blocks
    with a condition those for all media or the screen count.
    """
    css, out, at = COMMENT.sub(" ", css), [], 0
    while m := RULE.match(css, at):
        at = m.end()
        if m[1] and m[2] == "{":
            depth, end = 1, at
            for brace in re.finditer(r"[{}]", css[at:]):
                depth += 1 if brace[0] == "{" else -1
                end = at + brace.start()
                if not depth:
                    break
            end = end if not depth else len(css)
            if re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)\s*", m[1], re.I):
                out += sheet_rules(css[at:end])
            at = end + 1
        elif m[3] and (said := [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARED.findall(m[4])]):
            for one in m[3].split(","):
                if (s := SELECTOR.fullmatch(one.strip())) and s[0]:
                    names = re.findall(r"[.#][\w-]+", s[2])
                    out.append(((s[1] or "*").lower(), frozenset(n[1:] for n in names if n[0] == "."), frozenset(n[1:] for n in names if n[0] == "#"), said))
    return out


def apply_sheets(root: Node) -> None:
    """Put what style sheets say of an element before its own style, and what they say is important behind it."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    sheets = ["".join(k for k in n.kids if isinstance(k, str)) for n in nodes if n.tag == "style" and n.attrs.get("media", "all").lower() in ("", "all", "screen")]
    rules = [r for css in sheets if "display" in css.lower() or "visibility" in css.lower() for r in sheet_rules(css)]
    if not rules:
        return
    # by an id, a class or the element that it needs
    keyed: dict[str, list[int]] = {}
    for k, (tag, classes, ids, _) in enumerate(rules):
        keyed.setdefault(f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag, []).append(k)
    for node in nodes:
        has, name = set(node.attrs.get("class", "").split()), node.attrs.get("id", "").strip()
        near = {k for key in (node.tag, "*", f"#{name}", *(f".{c}" for c in has)) for k in keyed.get(key, ())}
        fits = [k for k in near if rules[k][0] in ("*", node.tag) and rules[k][1] <= has and rules[k][2] <= {name}]
        if fits:
            fits.sort(key=lambda k: (len(rules[k][2]), len(rules[k][1]), rules[k][0] != "*", k))
            said = [(f"{p}:{v}", i) for k in fits for p, v, i in rules[k][3]]
            node.attrs["style"] = ";".join([*(d for d, i in said if not i), node.attrs.get("style", ""), *(d for d, i in said if i)])


#: Work on an element: it yields the work on others that it waits for.
type Task = Generator[Task, Any, Any]


def finished(task: Task) -> Any:
    """Run a task and those it waits for, on a list of its own: no page is nested too deeply for Python's stack."""
    tasks, value = [task], None
    while tasks:
        try:
            tasks.append(tasks[-1].send(value))
            value = None
        except StopIteration as e:
            tasks.pop()
            value = e.value
    return value


def inside(node: Node, out: Lines, visible: bool) -> Task:
    number = int(node.attrs["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    closed, summary = node.tag == "details" and "open" not in node.attrs, False
    for kid in node.kids:
        if isinstance(kid, str):
            if visible and not closed:
                out.text(kid)
            continue
        shown, sees = seen(kid, visible)
        if not shown or closed and (kid.tag != "summary" or summary):
            continue
        tag = kid.tag
        summary = summary or tag == "summary"
        if tag == "br":
            out.flush() if any(x.strip() for x in out.open) else out.put([""]) if out.done and out.done[-1] else None
        elif tag == "pre" or tag == "textarea":
            out.gap()
            raw = Lines()
            yield inside_pre(kid, raw.open, sees)
            lines = "".join(raw.open).replace("\r\n", "\n").removeprefix("\n").rstrip("\n").split("\n")
            if any(x.strip() for x in lines):
                out.put([x.rstrip() for x in lines])
            out.gap()
        elif tag == "table":
            out.gap()
            lines = yield table_lines(kid, sees)
            if lines:
                out.put(lines)
            out.gap()
        elif tag == "li":
            out.flush()
            mark = "- "
            if node.tag == "ol":
                number = int(kid.attrs["value"]) if re.fullmatch(r"-?\d{1,9}", kid.attrs.get("value", "")) else number
                mark, number = f"{number}. ", number + 1
            own = Lines()
            yield inside(kid, own, sees)
            if lines := own.take():
                out.put([mark + lines[0], *((" " * len(mark) + x).rstrip() for x in lines[1:])])
        elif tag in ("dd", "blockquote"):
            out.gap() if tag == "blockquote" else out.flush()
            own = Lines()
            yield inside(kid, own, sees)
            if lines := own.take():
                out.put([("    " + x).rstrip() for x in lines])
            out.gap() if tag == "blockquote" else out.flush()
        elif tag in ("ul", "ol", "menu", "dir") and node.tag in ("li", "ul", "ol"):
            out.flush()
            yield inside(kid, out, sees)
            out.flush()
        elif tag in SPACED:
            out.gap()
            yield inside(kid, out, sees)
            out.gap()
        elif tag in BLOCKS:
            out.flush()
            yield inside(kid, out, sees)
            out.flush()
        elif tag == "input":
            if kid.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and sees:
                out.text(" " + kid.attrs.get("value", "") + " ")
        elif tag == "svg":
            yield svg_text(kid, out.text, lambda x, y: inside(x, out, y), sees)
        elif tag == "math":
            apart = kid.attrs.get("display", "").lower() == "block"
            out.flush() if apart else None
            yield math_text(kid, out.text, lambda x, y: inside(x, out, y), sees)
            out.flush() if apart else None
        elif tag not in VOID:
            if tag == "q" and sees:
                out.text('"')
            yield inside(kid, out, sees)
            if tag == "q" and sees:
                out.text('"')
            if tag == "button":
                out.text(" ")


def inside_pre(node: Node, out: list[str], visible: bool) -> Task:
    for kid in node.kids:
        if isinstance(kid, str):
            if visible:
                out.append(kid)
        elif kid.tag == "br":
            out.append("\n")
        else:
            shown, sees = seen(kid, visible)
            if shown and kid.tag in ("svg", "math"):
                yield (svg_text if kid.tag == "svg" else math_text)(kid, out.append, lambda x, y: inside_pre(x, out, y), sees)
            elif shown:
                yield inside_pre(kid, out, sees)


def svg_text(node: Node, put: Callable[[str], None], flow: Callable[[Node, bool], Task], visible: bool, label: bool = False) -> Task:
    """The labels of a drawing in their order, each set off by spaces, and the HTML in it; copies by <use> aren't made."""
    for kid in node.kids:
        if isinstance(kid, str):
            if label and visible:
                put(kid)
            continue
        shows = kid.attrs.get("visibility", "").lower()
        shown, sees = seen(kid, visible if shows in ("", "inherit") else shows == "visible")
        if not shown or kid.tag in UNDRAWN or kid.attrs.get("display", "").lower() == "none":
            continue
        own = kid.tag in ("text", "foreignobject")
        put(" ") if own else None
        if kid.tag == "foreignobject":
            yield flow(kid, sees)
        else:
            yield svg_text(kid, put, flow, sees, label or kid.tag == "text")
        put(" ") if own else None


def math_text(node: Node, put: Callable[[str], None], flow: Callable[[Node, bool], Task], visible: bool) -> Task:
    """A formula's text in its order; the parts of fractions, scripts and tables stand apart, annotations are unseen."""
    first = True
    for kid in node.kids:
        if isinstance(kid, str):
            if visible:
                put(kid)
            continue
        shown, sees = seen(kid, visible)
        if not first and node.tag in APART:
            put(" ")
        if not first and node.tag in ("semantics", "maction"):
            continue
        first = False
        if not shown or kid.tag in ("annotation", "annotation-xml"):
            continue
        if kid.tag in TOKENS:
            yield flow(kid, sees)
        elif kid.tag == "mspace":
            put(" ")
        else:
            yield math_text(kid, put, flow, sees and kid.tag != "mphantom")


def spanned(text: str | None, least: int, most: int) -> int:
    """A colspan or rowspan as browsers read it: 1 where it is no number."""
    m = re.match(r"[ \t\n\r\f]*\+?([0-9]+)", text or "")
    return min(max(int(m[1][:9]), least), most) if m else 1


def table_lines(node: Node, visible: bool) -> Task:
    """Caption, then a line for each line of a row's cells, columns padded to one width."""
    out, groups = Lines(), {"thead": [], "tbody": [], "tfoot": []}

    def collect(n: Node, sees: bool, rows: list) -> Task:
        cells: list[tuple[list[str], int, int]] = []
        for kid in n.kids:
            if isinstance(kid, str):
                if kid.strip() and sees:
                    out.text(kid)  # stray text stands before the table
                continue
            shown, seen_ = seen(kid, sees)
            if not shown or kid.tag in ("colgroup", "col"):
                continue
            if kid.tag in ("td", "th"):
                own = Lines()
                yield inside(kid, own, seen_)
                cells.append((own.take(), spanned(kid.attrs.get("colspan"), 1, MOST_COLUMNS), spanned(kid.attrs.get("rowspan"), 0, MOST_ROWS)))
            elif kid.tag == "tr":
                yield collect(kid, seen_, rows)
            elif kid.tag in groups:
                groups[kid.tag].append([])
                yield collect(kid, seen_, groups[kid.tag][-1])
                rows = rows if n.tag != "table" else fresh()
            else:
                holder = Node("div", {})
                holder.kids.append(kid)
                out.flush()
                yield inside(holder, out, sees)
                out.flush()
        if cells or n.tag == "tr":
            rows.append(cells)

    def fresh() -> list:
        groups["tbody"].append([])
        return groups["tbody"][-1]

    yield collect(node, visible, fresh())
    # Cells at their columns; a cell of several rows takes its columns in the rows below, up to the end of their group.
    rows: list[list[tuple[int, int, list[str]]]] = []
    for group in groups["thead"] + groups["tbody"] + groups["tfoot"]:
        held: list[tuple[int, int, int]] = []
        for k, cells in enumerate(group):
            held = [x for x in held if x[2] > k]
            taken, col = sorted(held), 0
            row = [(start, stop, []) for start, stop, _ in taken]
            at = 0
            for lines, span, down in cells:
                while at < len(taken) and taken[at][0] <= col:
                    col, at = max(col, taken[at][1]), at + 1
                row.append((col, col + span, lines))
                if down != 1:
                    held.append((col, col + span, k + down if down else len(group)))
                col += span
            if any(lines for _, _, lines in row):
                rows.append(sorted(row, key=lambda x: x[:2]))
    starts = sorted({start for r in rows for start, _, _ in r})
    wide = [0] * len(starts)
    # Columns in which no cell begins have no width of their own.
    rows_at = [[(bisect_left(starts, start), bisect_left(starts, stop), lines) for start, stop, lines in r] for r in rows]
    for r in rows_at:
        for start, stop, lines in r:
            if stop - start == 1:
                wide[start] = max([wide[start], *map(width, lines)])
    # A cell of several columns widens the last of them where they are too narrow for it; shorter spans come first.
    need: dict[tuple[int, int], int] = {}
    for r in rows_at:
        for start, stop, lines in r:
            if stop - start > 1 and lines:
                need[start, stop] = max([need.get((start, stop), 0), *map(width, lines)])
    for (start, stop), most in sorted(need.items(), key=lambda x: (x[0][1] - x[0][0], x[0])):
        wide[stop - 1] += max(0, most - sum(wide[start:stop]) - 3 * (stop - start - 1))
    # before[k]: the width of the columns left of k, with a bar after each
    before = [0, *accumulate(w + 3 for w in wide)]
    set_: list[str] = []
    for r in rows_at:
        for k in range(max(len(lines) for _, _, lines in r)):
            parts, col = [], 0
            for start, stop, lines in r:
                parts += [" " * wide[c] for c in range(col, start)]
                if start < col and not lines:
                    continue  # overlapped by a wider cell
                text = lines[k] if k < len(lines) else ""
                parts.append(text + " " * max(0, before[stop] - before[max(start, col)] - 3 - width(text)))
                col = max(col, stop)
            set_.append(" | ".join(parts).rstrip())
    return out.take() + set_


def visible_text(page: str | None) -> str:
    """The visible text of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    out, root = Lines(), build(page)
    apply_sheets(root)
    holder = Node("div", {})
    holder.kids.append(root)
    finished(inside(holder, out, True))
    return "\n".join(out.take()).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` in place of it, as column ``to``.

    A null page has an empty text. Repeated rows are rows of their own; a page of any length is one row of one task, and takes time in
    proportion to it; elements that are nested deeper than DEPTH are put beside the deepest. A column named ``to`` is replaced; all others
    pass through.
    """
    kept = [c for c in pages.columns if c not in (to, html_col)]
    schema = StructType([f for f in pages.schema.fields if f.name in kept]).add(to, "string")
    source = pages.select(*kept, pages[html_col].alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([visible_text(x) for x in b["_html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), text], [*kept, to])

    return source.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "html"))
