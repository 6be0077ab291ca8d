"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer for blocks, lists and tables.

The tree builder closes what HTML lets authors leave open; the renderer walks the tree without recursion, so nesting may
be of any depth. All text that a browser would show comes out once, in order.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title rp desc metadata defs".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
#: A blank line stands before and after these.
APART = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
#: End tags of other elements don't look beyond these.
SPECIAL = BLOCK | frozenset("applet area base basefont bgsound br button col colgroup embed frame frameset head iframe img input link listing marquee meta noembed noframes noscript object param plaintext script select source style template textarea title track wbr xmp".split()) - {"legend", "optgroup", "option"}
#: A new list item doesn't look beyond these for the one that it ends.
KEEPS_ITEM = SPECIAL - {"address", "div", "p"}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
LIST_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset({"table", "template"})
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
GROUPS = frozenset("thead tbody tfoot".split())
ITEMS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
#: A quote opens a value right after = only; elsewhere it is a character like others.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=[ \t\n\r\f]*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>|\Z))|[^>=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Wider columns aren't padded: their cells follow each other with two blanks only.
ALIGN_WIDTH = 80
#: Lists, quotes and tables nested deeper than this are shown as plain blocks, so that indentation stays bounded.
MAX_DEPTH = 24
#: What HTML itself allows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        """By name; the first of a name counts."""
        return {a.lower(): html.unescape(b or c or d) for a, b, c, d in reversed(_ATTR.findall(self.attrs))}


class _Tree:
    """The open elements. Where each tag is open is kept by tag, so that no rule has to walk the stack."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}
        self.special, self.keeps_item = [0], [0]

    def push(self, node: Node) -> None:
        i, tag = len(self.stack), node.tag
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.at.setdefault(tag, []).append(i)
        if tag in SPECIAL:
            self.special.append(i)
            if tag in KEEPS_ITEM:
                self.keeps_item.append(i)

    def cut(self, i: int) -> None:
        """Closes everything from place i on."""
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in SPECIAL:
                self.special.pop()
                if tag in KEEPS_ITEM:
                    self.keeps_item.pop()

    def innermost(self, tags) -> int:
        """Place of the innermost open one of tags, 0 if none is."""
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)

    def close(self, tags, limits) -> bool:
        """Closes the innermost of tags this side of limits."""
        i = self.innermost(tags)
        if not i or i < self.innermost(limits):
            return False
        self.cut(i)
        return True

    def start(self, tag: str) -> bool:
        """What a start tag closes or implies. False where it is itself ignored."""
        top = self.stack[-1].tag
        if tag in TABLE_PARTS:
            return self._table_part(tag)
        if tag in ("html", "body") and self.at.get(tag):
            return False
        if tag in ITEMS and self.stack[self.keeps_item[-1]].tag in ITEMS[tag]:
            self.cut(self.keeps_item[-1])
        elif tag == "table" and (top == "table" or top == "tr" or top in GROUPS):
            self.cut(self.at["table"][-1])
        elif tag in ("option", "optgroup"):
            while self.stack[-1].tag in ("option", tag):
                self.cut(len(self.stack) - 1)
        elif tag in ("rb", "rt", "rp", "rtc"):
            while self.stack[-1].tag in ("rb", "rt", "rp", "rtc"):
                self.cut(len(self.stack) - 1)
        elif tag == "button":
            self.close(("button",), SCOPE)
        elif tag == "a":
            self.end("a")
        if tag in CLOSES_P:
            self.close(("p",), BUTTON_SCOPE)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.cut(len(self.stack) - 1)
        return True

    def _table_part(self, tag: str) -> bool:
        table = self.innermost(("table",))
        if not table or tag in ("col", "colgroup"):
            return False
        group, row = max(self.innermost(GROUPS), table), self.innermost(("tr",))
        if tag in ("td", "th"):
            if row > table:
                self.cut(row + 1)
            else:
                self.cut(group + 1)
                self.push(Node("tr"))
        else:
            self.cut((group if tag == "tr" else table) + 1)
        return True

    def end(self, tag: str) -> None:
        if tag == "p":
            if not self.close(("p",), BUTTON_SCOPE):
                self.stack[-1].children.append(Node("p"))
        elif tag == "br":
            self.stack[-1].children.append(Node("br"))
        elif tag in ("html", "body"):  # what follows them still belongs to the page
            pass
        elif tag == "table" or tag in TABLE_PARTS:
            self.close((tag,), TABLE_SCOPE - {tag})
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag in SPECIAL:
            self.close((tag,), LIST_SCOPE if tag == "li" else SCOPE)
        elif (i := self.innermost((tag,))) > self.special[-1] or i > self.innermost(SCOPE) and not styled(self.stack[i])[0]:
            # Across a block an inline end tag closes nothing that layout shows, but it ends a hidden part.
            self.cut(i)


def parse(source: str) -> Node:
    """The tree of a page. Children are nodes and strings (text with entities resolved)."""
    tree = _Tree()
    stack, opened = tree.stack, tree.at

    def show(text: str) -> None:
        if stack[-1].tag == "head" and not text.isspace():
            tree.cut(len(stack) - 1)
        stack[-1].children.append(html.unescape(text))

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            show(source[at:])
            break
        if m.start() > at:
            show(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            tree.end(tag)
            continue
        if opened.get("head") and tag not in VOID and tag not in RAW and tag not in ESCAPABLE and tag not in ("noscript", "template", "head", "html"):
            tree.cut(opened["head"][0])
        if not tree.start(tag):
            continue
        node = Node(tag, m[3])
        if tag in RAW or tag in ESCAPABLE or tag == "plaintext":
            stack[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at) if tag != "plaintext" else None
            raw = source[at : end.start() if end else n]
            node.children.append(html.unescape(raw) if tag in ESCAPABLE else raw)
            at = end.end() if end else n
        elif tag in VOID or m[3].endswith("/") and (opened.get("svg") or opened.get("math")):
            stack[-1].children.append(node)
        else:
            tree.push(node)
            if tag in ("pre", "listing") and source.startswith(("\n", "\r\n"), at):
                at += 1 if source[at] == "\n" else 2
    return tree.root


def styled(node: Node) -> tuple[bool, bool | None]:
    """Whether the node has a box, and whether its own text is visible (None: as its parent's)."""
    if node.tag in HIDDEN:
        return False, None
    if node.tag == "dialog" and "open" not in node.attributes():
        return False, None
    if not node.attrs:
        return True, None
    lower = node.attrs.lower()
    if "hidden" not in lower and "style" not in lower:
        return True, None
    attrs = node.attributes()
    found = {}
    for name, value, important in _DECLARED.findall(_CSS_COMMENT.sub("", attrs.get("style", ""))):
        if important or not found.get(name.lower(), ("", ""))[1]:
            found[name.lower()] = value.lower(), important
    if "hidden" in attrs and (attrs["hidden"].lower() == "until-found" or "display" not in found):
        return False, None
    seen = {"visible": True, "hidden": False, "collapse": False}.get(found["visibility"][0]) if "visibility" in found else None
    return "display" not in found or found["display"][0] != "none", seen


class _Page:
    """Lines of a block, with what spacing is due before the next text."""

    __slots__ = ("out", "due", "blank")

    def __init__(self):
        self.out, self.due, self.blank = [], 0, False

    def text(self, s: str) -> None:
        flat = _SPACE.sub(" ", s)
        lead = flat.startswith(" ")
        body = flat.strip(" ")
        if not body:
            self.blank = self.blank or lead
            return
        self._space(lead)
        self.out.append(body)
        self.blank = flat.endswith(" ")

    def _space(self, lead: bool) -> None:
        if self.out and self.due:
            self.out.append("\n" * self.due)
        elif self.out and (lead or self.blank) and not self.out[-1].endswith("\n"):
            self.out.append(" ")
        self.due, self.blank = 0, False

    def raw(self, s: str) -> None:
        """Text whose spaces stay."""
        if s:
            self._space(False)
            self.out.append(s)

    def br(self) -> None:
        if self.out:
            self.due = min(self.due + 1, 2) if self.due else 1
        self.blank = False

    def edge(self, lines: int) -> None:
        self.due, self.blank = max(self.due, lines), False

    def block(self, s: str, lines: int = 1) -> None:
        if s:
            self.edge(lines)
            self.raw(s)
            self.edge(lines)

    def done(self) -> str:
        return "".join(self.out)


def render(root: Node) -> str:
    """Visible text: paragraphs apart by a blank line, blocks by a new line, list items marked and indented, table cells in columns."""
    page = _Page()
    pages: list[_Page] = [page]
    lists: list[list] = []  # [kind, number of the next item]
    tables: list[list | None] = []  # rows of cells; None where a table is shown as plain blocks
    pre = 0
    walk: list[tuple[Node, int, bool, bool]] = [(root, 0, True, False)]  # node, next child, whether text shows, whether it has a page of its own
    while walk:
        node, k, shown, own = walk.pop()
        tag = node.tag
        if k == 0:
            if tag == "br":
                page.br()
                continue
            box, seen = styled(node)
            if not box:
                continue
            shown = shown if seen is None else seen
            if tag == "details" and "open" not in node.attributes():
                node.children = [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1]
            if tag == "table":
                own = len(pages) <= MAX_DEPTH
                tables.append([] if own else None)
            elif tag in ("td", "th"):
                own = bool(tables) and tables[-1] is not None
            elif tag in ("li", "blockquote", "dd"):
                own = len(pages) <= MAX_DEPTH
            if own:
                page = _Page()
                pages.append(page)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif tag in BLOCK:
                page.edge(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                first = node.attributes().get("start", "") if tag == "ol" and node.attrs else ""
                lists.append([tag, int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
            pre += tag in ("pre", "listing", "xmp")
        children = node.children
        paused = False
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, Node):
                walk.append((node, k, shown, own))
                walk.append((child, 0, shown, False))
                paused = True
                break
            if shown:
                (page.raw if pre else page.text)(child)
        if paused:
            continue
        # The node is done.
        pre -= tag in ("pre", "listing", "xmp")
        text = ""
        if own:
            text = pages.pop().done()
            page = pages[-1]
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        if tag == "table":
            rows = tables.pop()
            if own:  # captions and what stands outside of cells come first
                page.block("\n".join(x for x in (text, _columns(rows)) if x), 2)
                continue
        elif tag in ("td", "th") and own:
            if not tables[-1]:
                tables[-1].append([])
            spans = node.attributes() if "span" in node.attrs.lower() else {}
            tables[-1][-1].append((text, _span(spans.get("colspan"), 1, MAX_COLSPAN), _span(spans.get("rowspan"), MAX_ROWSPAN, MAX_ROWSPAN)))
            continue
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                value = node.attributes().get("value", "") if node.attrs else ""
                if re.fullmatch(r"-?[0-9]{1,9}", value):
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if own:
                page.block(mark + _indented(text, " " * len(mark)) if text else "")
                continue
        elif own:
            page.block("  " + _indented(text, "  ") if text else "", 2 if tag == "blockquote" else 1)
            continue
        if tag in BLOCK and not (tag == "tr" and tables and tables[-1] is not None):
            page.edge(2 if tag in APART and not (tag in ("ul", "ol") and lists) else 1)
    return page.done()


def _indented(text: str, by: str) -> str:
    """Lines after the first begin with by, but for empty ones."""
    return re.sub(r"\n(?!\n|\Z)", "\n" + by, text)


def _span(value: str | None, zero: int, most: int) -> int:
    """A span attribute; what isn't a number counts as 1."""
    digits = re.match(r"\s*\+?([0-9]{1,9})", value or "1")
    return min(int(digits[1]) or zero, most) if digits else 1


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(first column, column after the last, text) of each cell. A cell takes the next place that none from a row above reaches down to."""
    out, busy = [], []  # busy: (first, after, rows left), in order
    for row in rows:
        at, i, here, down = 0, 0, [], []
        for text, columns, lines in row:
            while i < len(busy) and busy[i][0] <= at:
                at = max(at, busy[i][1])
                i += 1
            here.append((at, at + columns, text))
            if lines > 1:
                down.append((at, at + columns, lines))
            at += columns
        out.append(here)
        busy = sorted((a, b, n - 1) for a, b, n in [*busy, *down] if n > 1)
        merged = busy[:1]
        for a, b, n in busy[1:]:
            if merged[-1][1:] == (a, n):
                merged[-1] = merged[-1][0], b, n
            else:
                merged.append((a, b, n))
        busy = merged
    return out


def _columns(rows: list[list[tuple[str, int, int]]]) -> str:
    rows = [r for r in _placed(rows) if any(t for _, _, t in r)]
    if not rows:
        return ""
    # Only where a cell begins is there a column.
    starts = sorted({a for r in rows for a, _, _ in r})
    cells = [[(bisect_left(starts, a), bisect_left(starts, b), t.split("\n")) for a, b, t in r] for r in rows]
    widths = [0] * len(starts)
    for a, b, lines in sorted((c for r in cells for c in r), key=lambda c: c[1] - c[0]):
        wide = max(map(len, lines)) - sum(widths[a : b - 1]) - 2 * (b - a - 1)
        widths[b - 1] = max(widths[b - 1], wide)
    ends = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for r in cells:
        for line in range(max(len(c[2]) for c in r)):
            parts, at = [], 0
            for a, b, lines in r:
                if a > at:
                    parts.append(("", ends[a] - ends[at] - 2))
                parts.append((lines[line] if line < len(lines) else "", ends[b] - ends[a] - 2))
                at = b
            out.append("  ".join(p.ljust(w) if w <= ALIGN_WIDTH else p for p, w in parts).rstrip())
    return "\n".join(out)


def extract(source: str) -> str:
    return render(parse(source))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, text, n_chars. Null and empty pages, and those without visible text, have an empty text; ids aren't looked at; other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [extract(s or "") for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["id", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
