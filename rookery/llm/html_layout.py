"""Layout-aware text of HTML pages.

A tree builder adds the tags that HTML implies; visibility rules (elements that
never show, the hidden attribute, ``display`` and ``visibility`` of inline styles and
style-sheet rules) take out what a reader would not see; rendering emits everything else. Blocks
keep their spacing, list items their bullets, numbers and nesting, preformatted
text its lines, and the cells of a table stand aligned in columns.

Tree building and rendering both work on explicit stacks, so nesting of any
depth is handled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: element classes by their parsing and default layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noframes iframe audio video canvas datalist annotation annotation-xml area base link meta param source track".split())
#: parts of a drawing that are not drawn themselves, and those whose text is
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
SVG_TEXT = frozenset("text foreignobject".split())
HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
# blank line before and after / own lines only
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address li dt dd form details summary dialog figcaption center legend hgroup search menu tr caption optgroup option".split())
CLOSES_P = SPACED | frozenset("div section article aside nav header footer main address form details dialog center menu hgroup search".split())
#: open element -> start tags that end it
IMPLIED_END = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option", "optgroup"}), "optgroup": frozenset({"optgroup"}),
    "td": frozenset("td th tr tbody thead tfoot".split()), "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()), "caption": frozenset("tr td th tbody thead tfoot colgroup".split()),
    "tbody": frozenset("tbody thead tfoot".split()), "thead": frozenset("tbody thead tfoot".split()), "tfoot": frozenset("tbody thead tfoot".split()),
    "colgroup": frozenset("tr td th tbody thead tfoot".split()), "p": CLOSES_P,
}
#: elements that an implied end does not reach through
SCOPE = {"li": frozenset("ul ol menu table td th".split()), "dt": frozenset("dl table td th".split()), "dd": frozenset("dl table td th".split()),
         "option": frozenset({"select", "datalist"}), "optgroup": frozenset({"select"}), "p": frozenset("table td th button li dd object".split()),
         **{t: frozenset({"table"}) for t in "td th tr caption tbody thead tfoot colgroup".split()}}
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption".split())

_SPACES = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_PART = r"[.#][\w-]+|\[\s*[\w-]+\s*(?:[~^$*]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]"
_COMPOUND = re.compile(rf"([a-zA-Z][\w-]*|\*)?((?:{_PART})*)")
_PARTS = re.compile(_PART)
_ATTRIBUTE = re.compile(r"\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*(.*?)\s*)?\]", re.S)
_COMBINATOR = re.compile(r"\s*>\s*|\s+")
_SELECTORS = re.compile(r",(?![^\[]*\])")
_DECLARED = {name: re.compile(rf"\s*{name}\s*:\s*([\w-]+)[^!]*(!\s*important)?", re.I) for name in ("display", "visibility")}
_FEATURE = re.compile(r"\(\s*(min-|max-)?(width|height)\s*:\s*([\d.]+)(px|em|rem)\s*\)")
#: the screen that media conditions are tested against
SCREEN = {"width": 1280.0, "height": 720.0}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree of a page, with implied tags; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.depth = {"html": 1}  # open elements by tag
        self.sheets: list[Node] = []  # style elements

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.depth[node.tag] = self.depth.get(node.tag, 0) + 1

    def _pop_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.depth[node.tag] -= 1
        del self.open[at:]

    def _end_implied(self, tag: str) -> None:
        for held in [t for t, ends in IMPLIED_END.items() if tag in ends and self.depth.get(t)]:
            stop = SCOPE[held]
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == held:
                    self._pop_to(at)
                    break
                if self.open[at].tag in stop:
                    break

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):  # their attributes join the implied element
            target = self.root if tag == "html" else self._body()
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if tag not in HEAD_ONLY and tag != "head" and self.open[-1].tag == "head":
            self._pop_to(len(self.open) - 1)
        if tag not in HEAD_ONLY and tag != "head" and len(self.open) == 1:
            self._body()
        self._end_implied(tag)
        if tag in TABLE_PARTS and self.depth.get("table"):
            self._imply_row(tag)
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _body(self) -> Node:
        if self.open[-1].tag == "head":
            self._pop_to(len(self.open) - 1)
        for node in self.root.children:
            if isinstance(node, Node) and node.tag == "body":
                return node
        self._push(Node("body", {}))
        return self.open[-1]

    def _imply_row(self, tag: str) -> None:
        here = self.open[-1].tag
        if tag in ("td", "th") and here in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr", {}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # "/" closes parts of drawings and formulas, but no HTML element
        if (self.depth.get("svg") or self.depth.get("math")) and self.open[-1].tag == tag:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag in ("html", "body") or not self.depth.get(tag):
            return
        stop = SCOPE.get(tag, frozenset() if tag == "table" else frozenset({"td", "th"}))
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._pop_to(at)
                return
            if self.open[at].tag in stop:
                return

    def handle_data(self, data):
        here = self.open[-1]
        if here.tag == "style" and here not in self.sheets[-1:]:
            self.sheets.append(here)
        if here.tag == "head" and data.strip():
            self._pop_to(len(self.open) - 1)
        if len(self.open) == 1 and data.strip():
            self._body()
        self.open[-1].children.append(data)


def on_screen(media: str) -> bool:
    """Whether one of a list of media queries applies to ``SCREEN``; conditions that are not known do not."""
    return not media.strip() or any(_query(q) for q in media.lower().split(","))


def _query(query: str) -> bool:
    m = re.fullmatch(r"\s*(not\b|only\b)?\s*(.*?)\s*", query, re.S)
    for part in re.split(r"\s+and\s+|\band\b(?=\s*\()", m[2]):
        part = part.strip()
        if f := _FEATURE.fullmatch(part):
            size = float(f[3] if f[3].count(".") < 2 and f[3] != "." else 0) * (1 if f[4] == "px" else 16)
            have = SCREEN[f[2]]
            true = have >= size if f[1] == "min-" else have <= size if f[1] == "max-" else have == size
        elif part.startswith("("):
            if part.replace(" ", "") not in ("(orientation:landscape)", "(orientation:portrait)"):
                return False
            true = "landscape" in part
        else:
            true = part in ("screen", "all")
        if not true:
            return m[1] == "not"
    return m[1] != "not"


def _block_applies(head: str) -> bool:
    """Whether the rules in an at-rule's braces count."""
    m = re.match(r"@(media|supports|layer)(.*)", head.lower(), re.S)
    if not m:
        return False
    return on_screen(m[2]) if m[1] == "media" else m[1] == "layer" or not m[2].strip().startswith("not")


def sheet_rules(css: str) -> Iterator[tuple[str, list[str]]]:
    """Selectors and declarations of the rules of a sheet that apply on a screen, in order."""
    css = _COMMENT.sub("", css)
    css += "}" * css.count("{")  # open blocks end with the sheet
    opened: list[tuple[str, list[str], bool]] = []
    at, on = 0, True
    for m in _CSS.finditer(css):
        sign = m.group()
        if sign == "{":
            head = css[at:m.start()].strip()
            opened.append((head, [], on))
            # rules inside a plain rule are about its descendants
            on = on and _block_applies(head) if head.startswith("@") else on
        elif sign not in (";", "}"):
            continue
        elif opened:
            opened[-1][1].append(css[at:m.start()])
            if sign == "}":
                head, declarations, on = opened.pop()
                if on and not head.startswith("@") and all(h.startswith("@") for h, _, _ in opened[-1:]):
                    yield head, declarations
        at = m.end()


def declared(name: str, declarations: list[str]) -> tuple[bool, str] | None:
    """(important, value) of the declaration of a property that wins, if there is one."""
    found = None
    for d in declarations:
        if (m := _DECLARED[name].match(d)) and (found is None or m[2] or not found[0]):
            found = (bool(m[2]), m[1].lower())
    return found


@dataclass(frozen=True)
class Step:
    """A compound selector at its place in a complex one: what the element itself must
    be, and the step that an ancestor, or the parent if ``child``, must have taken."""

    bit: int
    before: int
    child: bool
    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str, str], ...]
    #: of the last step: property -> (important, specificity, place, value)
    says: dict[str, tuple] | None

    def fits(self, node: Node, classes: set[str]) -> bool:
        a = node.attrs
        return (self.tag in ("*", node.tag) and all(i == a.get("id") for i in self.ids) and classes.issuperset(self.classes)
                and all(name in a and _compared(a[name], sign, value) for name, sign, value in self.attributes))


def _compared(have: str, sign: str, value: str) -> bool:
    if sign == "^=" or sign == "$=" or sign == "*=":
        return bool(value) and (have.startswith(value) if sign == "^=" else have.endswith(value) if sign == "$=" else value in have)
    return value in have.split() if sign == "~=" else not sign or have == value


def compounds(selector: str) -> list[tuple[bool, str, tuple, tuple, tuple]] | None:
    """The compounds of a selector from the outermost: (child of the one before, tag, ids, classes,
    attributes). None for selectors of other kinds (siblings, pseudo-classes, functions)."""
    out, at, child = [], 0, False
    selector = selector.strip()
    while True:
        m = _COMPOUND.match(selector, at)
        if m.end() == at:
            return None
        parts = _PARTS.findall(m[2])
        attributes = [(n.lower(), sign or "", (value or "").strip("\"'")) for n, sign, value in (_ATTRIBUTE.fullmatch(p).groups() for p in parts if p[0] == "[")]
        out.append((child, (m[1] or "*").lower(), tuple(p[1:] for p in parts if p[0] == "#"), tuple(p[1:] for p in parts if p[0] == "."), tuple(attributes)))
        if m.end() == len(selector):
            return out
        if not (c := _COMBINATOR.match(selector, m.end())):
            return None
        at, child = c.end(), ">" in c.group()


class Rules:
    """What style-sheet rules say of ``display`` and ``visibility``.

    Selectors are compounds of tag, id, classes and attributes, joined as descendants
    or children. The steps of all selectors are numbered; an element carries the set
    of steps taken at itself and the set taken at it or any ancestor, so that a
    selector costs the same at any depth."""

    def __init__(self, sheets: list[str]):
        self.steps: dict[str, list[Step]] = {}   # by one thing that the element must have
        bit, place = 1, 0
        for sheet in sheets:
            for selectors, declarations in sheet_rules(sheet):
                says = {name: found for name in _DECLARED if (found := declared(name, declarations))}
                if not says:
                    continue
                place += 1
                for selector in _SELECTORS.split(selectors):
                    parts = compounds(selector) or []
                    weight = sum(10_000 * len(ids) + 100 * (len(classes) + len(attributes)) + (tag != "*") for _, tag, ids, classes, attributes in parts)
                    before = 0
                    for i, (child, tag, ids, classes, attributes) in enumerate(parts):
                        last = {n: (important, weight, place, value) for n, (important, value) in says.items()} if i == len(parts) - 1 else None
                        key = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag
                        self.steps.setdefault(key, []).append(Step(bit, before, child, tag, ids, classes, attributes, last))
                        before, bit = bit, bit << 1

    def look(self, node: Node, parent: tuple[int, int]) -> tuple[dict[str, str], tuple[int, int]]:
        """The winning value of each property, and the steps taken: here, and here or above."""
        a = node.attrs
        here, above = 0, parent[1]
        found: dict[str, tuple] = {}
        if self.steps:
            classes = set(a.get("class", "").split())
            keys = ["*", node.tag, *(f".{c}" for c in classes)]
            if "id" in a:
                keys.append(f"#{a['id']}")
            for key in keys:
                for step in self.steps.get(key, ()):
                    if (not step.before or step.before & (parent[0] if step.child else above)) and step.fits(node, classes):
                        here |= step.bit
                        for name, rule in (step.says or {}).items():
                            found[name] = max(rule, found.get(name, rule))
        if "style" in a:
            declarations = a["style"].split(";")
            for name in _DECLARED:
                if own := declared(name, declarations):
                    rule = (own[0], 1_000_000_000, 0, own[1])
                    found[name] = max(rule, found.get(name, rule))
        return {name: rule[3] for name, rule in found.items()}, (here, above | here)

    @staticmethod
    def removed(node: Node, style: dict[str, str]) -> bool:
        """Whether an element is not laid out at all."""
        a = node.attrs
        if node.tag in HIDDEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
            return True
        if "display" in style:
            return style["display"] == "none"
        return "hidden" in a or node.tag == "dialog" and "open" not in a


class Flow:
    """Lines of text under construction: the page, or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the current line
        self.space = False  # a collapsed space is due
        self.blank = False  # an empty line is due before the next one
        self.indent: list[str] = []
        self.bullet = ""

    def text(self, data: str) -> None:
        words = _SPACES.split(data)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                if self.space and self.parts:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(word)

    def pre(self, data: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.line(keep=True)
            if line:
                self.parts.append(line)

    def line(self, keep: bool = False) -> None:
        """End the current line; an empty one counts only with ``keep``."""
        if self.parts or keep:
            self._emit("".join(self.parts))
        self.parts, self.space = [], False

    def _emit(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = "".join(self.indent)
        if self.bullet:
            lead = lead[:len(lead) - len(self.bullet)] + self.bullet
            self.bullet = ""
        self.lines.append((lead + text).rstrip().replace("\xa0", " "))

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank = self.blank or spaced

    def finished(self) -> list[str]:
        self.line()
        return self.lines


def _span(value: str | None) -> int:
    m = re.match(r"\s*(\d{1,4})", value or "")
    return max(1, int(m[1])) if m else 1


def _row_span(value: str | None) -> int:
    """Rows of a cell; 0 stands for all to the end of the row group."""
    m = re.match(r"\s*(\d{1,5})", value or "")
    return (int(m[1]) or 65534) if m else 1


Cell = tuple[int, int, list[str]]  # columns and rows spanned, lines


def _placed(rows: list[list[Cell] | None]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (first column, columns, lines): cells stand beside those that reach down from above.

    None among the rows is the end of a row group, which no cell reaches over.
    """
    out: list[list[tuple[int, int, list[str]]]] = []
    until: dict[int, int] = {}  # column -> first row that is free again
    for row in rows:
        if row is None:
            until = {}
            continue
        at, placed = 0, []
        for span, down, lines in row:
            while until.get(at, 0) > len(out):
                at += 1
            placed.append((at, span, lines))
            if down > 1:
                until.update((c, max(until.get(c, 0), len(out) + down)) for c in range(at, at + span))
            at += span
        out.append(placed)
    return out


def table_lines(rows: list[list[Cell] | None]) -> list[str]:
    """Rows of cells with every column as wide as its widest single cell."""
    table = _placed(rows)
    width: dict[int, int] = {}
    for row in table:
        for at, span, lines in row:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
    for row in table:  # a spanning cell widens its last column
        for at, span, lines in row:
            if span > 1:
                need = max(map(len, lines), default=0) - sum(width.get(c, 0) for c in range(at, at + span - 1)) - 2 * (span - 1)
                width[at + span - 1] = max(width.get(at + span - 1, 0), need)
    out = []
    for row in table:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            done, cells = 0, []
            for at, span, lines in row:
                cells += [" " * width.get(c, 0) for c in range(done, at)]
                room = sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                cells.append((lines[k] if k < len(lines) else "").ljust(room))
                done = at + span
            out.append("  ".join(cells).rstrip())
    return out


class Renderer:
    """Walks a tree once, in document order, and writes its visible text."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.tables: list[list[list[Cell] | None]] = []
        self.lists: list[list] = []  # [ordered, next number]
        self.pre = 0
        self.counts = {"tables": 0, "items": 0}

    def run(self, root: Node) -> list[str]:
        # inside a drawing the place is "svg", or "text" where text is drawn
        stack: list[tuple] = [("enter", root, True, "", (0, 0))]
        while stack:
            what, node, seen, place, taken = stack.pop()
            if what == "text":
                (self.flow.pre if self.pre else self.flow.text)(node)
                continue
            if what == "leave":
                self.leave(node)
                continue
            style, taken = self.rules.look(node, taken)
            if self.rules.removed(node, style) or place and (node.tag in SVG_HIDDEN or node.attrs.get("display") == "none"):
                continue
            if node.tag == "svg":
                place = "svg"
            elif place == "svg" and node.tag in SVG_TEXT:
                place = "text"
                self.flow.text(" ")
            if (visibility := style.get("visibility")) in ("visible", "hidden", "collapse"):
                seen = visibility == "visible"
            self.enter(node)
            stack.append(("leave", node, seen, place, taken))
            closed = node.tag == "details" and "open" not in node.attrs
            for child in reversed(node.children):
                if isinstance(child, str):
                    if seen and not closed and place != "svg":
                        stack.append(("text", child, seen, place, taken))
                elif not closed or child.tag == "summary":
                    stack.append(("enter", child, seen, place, taken))
        return self.flow.finished()

    def enter(self, node: Node) -> None:
        tag, flow = node.tag, self.flow
        if tag == "br":
            flow.line(keep=True)
        elif tag == "table":
            flow.block(True)
            self.tables.append([])
            self.counts["tables"] += 1
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("thead", "tbody", "tfoot"):
            self.tables[-1].append(None)
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1] or self.tables[-1][-1] is None:
                self.tables[-1].append([])
            self.flows.append(flow)
            self.flow = Flow()
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and self.lists
            flow.block(tag in SPACED and not nested)
            if tag in ("ul", "ol", "menu"):
                start = re.match(r"\s*-?\d{1,9}", node.attrs.get("start", ""))
                self.lists.append([tag == "ol", int(start[0]) if start else 1])
            elif tag == "li":
                ordered, n = self.lists[-1] if self.lists else (False, 1)
                if self.lists:
                    self.lists[-1][1] += 1
                flow.bullet = f"{n}. " if ordered else "- "
                flow.indent.append(" " * len(flow.bullet))
                self.counts["items"] += 1
            elif tag == "blockquote":
                flow.indent.append("> ")
            elif tag == "dd":
                flow.indent.append("    ")
            elif tag == "pre":
                self.pre += 1
                if node.children and isinstance(node.children[0], str):  # its first line end does not count
                    node.children[0] = re.sub(r"^\r?\n", "", node.children[0])
        elif tag == "input" and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
            flow.text(node.attrs.get("value", ""))

    def leave(self, node: Node) -> None:
        tag, flow = node.tag, self.flow
        if tag == "table":
            rows = self.tables.pop()
            for line in table_lines(rows):
                flow._emit(line)
            flow.block(True)
        elif self.tables and tag in ("td", "th"):
            lines = flow.finished()
            self.flow = self.flows.pop()
            self.tables[-1][-1].append((_span(node.attrs.get("colspan")), _row_span(node.attrs.get("rowspan")), lines))
        elif self.tables and tag in ("thead", "tbody", "tfoot"):
            self.tables[-1].append(None)
        elif self.tables and tag == "tr":
            pass
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu"):
                self.lists.pop()
            if tag == "pre":
                self.pre -= 1
            flow.line(keep=bool(flow.bullet) and tag == "li")
            if tag in ("li", "blockquote", "dd") and flow.indent:
                flow.indent.pop()
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists))


def render(html: str | None) -> tuple[str, int, int]:
    """Visible text of a page, its tables and its list items."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    sheets = ["".join(c for c in s.children if isinstance(c, str)) for s in builder.sheets if on_screen(s.attrs.get("media", ""))]
    renderer = Renderer(Rules(sheets))
    lines = renderer.run(builder.root)
    return "\n".join(lines), renderer.counts["tables"], renderer.counts["items"]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_tables and n_items of every page.

    A null or empty html gives an empty text with 0 lines. Every input row gives
    one row, repeated rows and null ids included; an empty table gives an empty
    table. Broken markup never fails: what cannot be a tag is text, unclosed
    elements end with their parent. Only page_id, url and html are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(h.as_py()) for h in batch.column(2)]
            texts, tables, items = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(tables, pa.int64()), pa.array(items, pa.int64())],
                                             names=["page_id", "url", "text", "n_tables", "n_items"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_tables long, n_items long")
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"), "n_tables", "n_items")
