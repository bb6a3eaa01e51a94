"""HTML to text as a browser lays it out: a tree with implied tags, visibility, blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import by_batch, table

# Elements by how they are built or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NEVER_SHOWN = frozenset(
    "area audio base canvas col colgroup datalist embed head iframe input link meta noembed noframes param script "
    "source style svg template title track video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption "
    "optgroup option".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("body html optgroup option caption".split())
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
# A start tag ends open elements of these names, up to the nearest element of the second set.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
}
# An end tag does not reach beyond these.
SCOPE = frozenset(["table", "td", "th", "caption", "html", "object", "template"])

_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
    # A quote opens a value right after the equals sign only; elsewhere it is a character like others.
    r"((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=)))*+)>"
    r"|</>|</[^a-zA-Z>][^>]*+>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*+))?)?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_RULE = re.compile(r"([^{};]*)([{};])")
_MEDIA = re.compile(r"(?:only\s+)?(?:screen|all)|not\s+(?:print|speech)")
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # of Node or str


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        found.setdefault(m.group(1).lower(), html.unescape(value))
    return found


def tree(source: str) -> tuple[Node, list[str]]:
    """The root of the page's tree, and its style sheets.

    Missing html, head and body are implied by not being needed: the root stands for them.  Tags that HTML lets
    authors leave out are put in: ends of paragraphs, list items, table parts, and rows of lone cells.  An end tag
    without its start is dropped, except </p> and </br>, which make one; a tag that the page ends in is dropped too.
    """
    root = Node("html")
    stack, styles = [root], []
    opened: Counter[str] = Counter()  # open elements by tag
    at, end = 0, len(source)

    def text(piece: str) -> None:
        if piece:
            if stack[-1].tag == "head" and piece.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def nearest(tags: frozenset[str], limit: frozenset[str]) -> int:
        """Depth of the innermost of these elements; 0 if there is none before one of the limit."""
        if not any(opened[tag] for tag in tags):
            return 0
        depth = len(stack) - 1
        while depth > 0 and stack[depth].tag not in tags and stack[depth].tag not in limit:
            depth -= 1
        return depth if depth > 0 and stack[depth].tag in tags else 0

    def close(tags: frozenset[str], limit: frozenset[str]) -> None:
        while depth := nearest(tags, limit):
            cut(depth)

    def end_tag(tag: str) -> None:
        if tag == "br":
            push("br", {})
        elif not opened[tag]:
            if tag == "p":
                push("p", {})
                cut(len(stack) - 1)
        else:
            limit = frozenset(["table"]) if tag in ("tr", "tbody", "thead", "tfoot") else SCOPE
            depth = nearest(frozenset([tag]), frozenset() if tag == "table" else limit - {tag})
            if depth:
                cut(depth)

    while at < end:
        m = _MARKUP.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        m = _TAG.match(source, m.start())
        if m is None:  # the page ends in a tag
            break
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            end_tag(tag)
            continue
        attributes = attributes_of(m.group(3)) if m.group(3) else {}
        if tag in ("html", "body"):
            if tag == "body":
                close(frozenset(["head"]), frozenset())
            root.attributes = attributes | root.attributes
            continue
        if opened["head"] and tag not in HEAD_ONLY:
            close(frozenset(["head"]), frozenset())
        if tag in CLOSES_P:
            close(frozenset(["p"]), SCOPE)
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        push(tag, attributes)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
            inner = source[at : stop.start() if stop else end]
            if tag == "style":
                styles.append(inner)
            elif tag in ("textarea", "title"):
                text(inner)
            elif tag == "xmp" and inner:
                stack[-1].children.append(inner)
            at = stop.start() if stop else end
        elif m.group(3).endswith("/") and tag in ("path", "rect", "circle", "use", "line"):
            cut(len(stack) - 1)
    return root, styles


def screen_rules(sheet: str) -> list[tuple[str, str]]:
    """Selectors and declarations of the rules for any screen; what depends on more than that is left out."""
    found: list[tuple[str, str]] = []
    opened: list[tuple[str, bool]] = []  # what stands before each open brace, and whether it applies
    body = ""
    for m in _RULE.finditer(sheet):
        piece, mark = m.group(1).strip(), m.group(2)
        if mark == "{":
            name, _, rest = piece.partition(" ") if piece.startswith("@") else ("", "", "")
            applies = not opened or opened[-1][1]
            if name.startswith("@"):
                media = name.lower() == "@media" and any(_MEDIA.fullmatch(q.strip().lower()) for q in rest.split(","))
                applies &= media or name.lower() == "@layer"
            opened.append((piece, applies))
            body = ""
        elif opened:
            body += piece + ";"
            if mark == "}":
                head, applies = opened.pop()
                if applies and not head.startswith("@"):
                    found.append((head, body))
                body = ""
    return found


def hidden_selectors(styles: list[str]) -> list[tuple[str, frozenset[str], frozenset[str]]]:
    """Tag, classes and ids of the simple selectors that a style sheet hides."""
    found = []
    for sheet in styles:
        for selectors, body in screen_rules(re.sub(r"/\*.*?\*/", "", sheet, flags=re.DOTALL)):
            if not _HIDING.search(body):
                continue
            for selector in (s.strip() for s in selectors.split(",")):
                if selector and _SIMPLE.fullmatch(selector):
                    tag = re.match(r"[a-zA-Z][\w-]*", selector)
                    found.append((
                        tag.group().lower() if tag else "",
                        frozenset(re.findall(r"\.([\w-]+)", selector)),
                        frozenset(re.findall(r"#([\w-]+)", selector)),
                    ))
    return found


def shown(node: Node, hiding: list[tuple[str, frozenset[str], frozenset[str]]]) -> bool:
    if node.tag in NEVER_SHOWN:
        return False
    attributes = node.attributes
    if not attributes and not hiding:
        return True
    if "hidden" in attributes and attributes["hidden"].lower() != "until-found":
        return False
    if "style" in attributes and _HIDING.search(attributes["style"]):
        return False
    if node.tag == "dialog" and "open" not in attributes:
        return False
    classes = frozenset(attributes.get("class", "").split())
    ids = frozenset([attributes["id"]]) if "id" in attributes else frozenset()
    return not any((not tag or tag == node.tag) and c <= classes and i <= ids for tag, c, i in hiding)


class Lines:
    """Text laid out in lines: inline text is joined with single blanks, blocks start lines, spaced ones leave one empty."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # white space is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.marker = ""
        self.indent = 0

    def add(self, text: str) -> None:
        words = text.split()
        if not words:
            self.blank = self.blank or bool(text)
            return
        if self.now and (self.blank or text[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.blank = text[-1].isspace()

    def exact(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.end(keep=True)
            if line:
                self.now.append(line.expandtabs())

    def end(self, keep: bool = False) -> None:
        if self.now or keep:
            self.put("".join(self.now).rstrip())
        self.now, self.blank = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = " " * max(0, self.indent - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append((lead + line).rstrip())

    def space(self) -> None:
        self.end()
        self.gap = True


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks that combine."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(source: str | None) -> str | None:
    """All visible text of a page; null for null, empty for a page that shows nothing."""
    if source is None:
        return None
    root, styles = tree(source)
    hiding = hidden_selectors(styles)
    return "\n".join(_laid_out(root, hiding)).strip("\n")


def _laid_out(top: Node, hiding: list) -> list[str]:
    """Lines of a node; tables are laid out from the innermost on, none of this recurs on the depth of a page."""
    out = Lines()
    # An entry is a node to open or the end of one: (node, None) or (node, what to restore).
    todo: list[tuple] = [(top, None)]
    lists: list[list] = []  # [tag, number of the next item]
    pre = 0
    done: dict[int, list[str]] = {}
    tables: dict[int, tuple] = {}
    waiting: list[tuple[Lines, list[list], int, list[tuple]]] = []
    while True:
        if not todo:
            out.end()
            if not waiting:
                return out.lines
            lines = out.lines
            out, lists, pre, todo, cell = waiting.pop()
            done[id(cell)] = lines
            continue
        node, ending = todo.pop()
        if isinstance(node, str):
            out.exact(node) if pre else out.add(node)
            continue
        tag = node.tag
        if ending is not None:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag == "pre":
                pre -= 1
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.space()
            else:
                out.end()
            out.indent = ending
            if tag == "li":
                out.marker = ""
            continue
        if not shown(node, hiding):
            continue
        if tag == "br":
            out.end(keep=True)
            continue
        if tag == "hr":
            out.space()
            continue
        if tag == "img":
            if node.attributes.get("alt"):
                out.add(node.attributes["alt"])
            continue
        if tag == "table":
            if id(node) not in tables:
                rows, caption = _rows(node, hiding)
                tables[id(node)] = rows, caption, iter([c for row in rows for c, _ in row] + caption)
            rows, caption, cells = tables[id(node)]
            open_cell = next(cells, None)
            if open_cell is not None:
                todo.append((node, None))
                waiting.append((out, lists, pre, todo, open_cell))
                out, lists, pre, todo = Lines(), [], 0, [(Node("div", {}, open_cell.children), None)]
                continue
            out.space()
            for line in [x for c in caption for x in done[id(c)]] + _grid(rows, done):
                out.put(line)
            out.space()
            continue
        block = tag in BLOCKS
        if block:
            before = out.indent
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.space()
            else:
                out.end()
            if tag in ("ul", "ol", "menu", "dir"):
                first = node.attributes.get("start", "")
                lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                out.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.indent += max(2, len(out.marker))
            elif tag == "dd":
                out.indent += 4
            elif tag == "blockquote":
                out.indent += 2
            elif tag == "pre":
                pre += 1
            todo.append((node, before))
        todo.extend((child, None) for child in reversed(node.children))


def _rows(node: Node, hiding: list) -> tuple[list[list[tuple[Node, int]]], list[Node]]:
    """Rows of a table, each cell with the columns it spans, and the captions.  What lies beside cells is a row."""
    rows: list[list[tuple[Node, int]]] = []
    captions: list[Node] = []
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                rows.append([(Node("td", {}, [child]), 1)])
        elif not shown(child, hiding):
            continue
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag in ("tbody", "thead", "tfoot"):
            todo.extend(reversed(child.children))
        elif child.tag == "tr":
            row = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        row.append((Node("td", {}, [cell]), 1))
                elif shown(cell, hiding):
                    span = cell.attributes.get("colspan", "")
                    row.append((cell, min(1000, max(1, int(span))) if re.fullmatch(r"\d{1,4}", span) else 1))
            rows.append(row)
        else:
            rows.append([(child, 1)])
    return rows, captions


def _grid(rows: list[list[tuple[Node, int]]], done: dict[int, list[str]]) -> list[str]:
    """Lines of a table, its columns aligned and two blanks apart; a cell may have several lines."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for cell, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(width, done[id(cell)]), default=0))
            column += span
    lines = []
    for row in rows:
        texts = [done[id(cell)] for cell, _ in row]
        for i in range(max(map(len, texts), default=0)):
            line, column, due = "", 0, 0
            for (_, span), cell in zip(row, texts, strict=True):
                part = cell[i] if i < len(cell) else ""
                line += " " * (due - width(line)) + part if due > width(line) else (" " if line and part else "") + part
                due += sum(widths.get(k, 0) + 2 for k in range(column, column + span))
                column += span
            lines.append(line.rstrip())
    return lines


def rendered(pages: DataFrame, *keep: str, source: str = "html") -> DataFrame:
    """The `keep` columns of each row and `text`, the page's visible text.  Each page is laid out for itself."""
    fields = {f.name: f.dataType.simpleString() for f in pages.select(*keep).schema}

    def batch(rows: pa.RecordBatch) -> dict:
        out: dict = {name: rows.column(i) for i, name in enumerate(fields)}
        return out | {"text": [render(value.as_py()) for value in rows.column(len(fields))]}

    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in fields.items()), "text string"])
    return by_batch(pages.select(*keep, F.col(source).alias("_source")), batch, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "pages"), "page_id")
