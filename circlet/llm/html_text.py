"""Layout-aware text of HTML pages.

A tokeniser and a tree builder with implied tags turn a page into a tree; a
visibility rule leaves out what a browser doesn't show; rendering emits all
visible text with blocks on lines of their own, blank lines around paragraphs,
markers and indents for lists, kept white space in pre, and aligned table cells.

Every step is linear in the page, or nearly so, whatever its nesting or its
mistakes: open elements are found by tag, not by search, and rendering keeps a
stack of its own. Three bounds concern the layout alone, never text: an indent
is at most ``INDENT`` columns wide, the cells of tables inside ``NESTED`` others
are blocks below one another, and tables of more than ``ALIGNED`` characters
aren't aligned.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import groups

#: Elements without content, of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never shown.
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist select meta link base".split())
#: Elements inside svg or math that are never shown.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
#: Elements that stand on lines of their own.
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table ul caption tr thead tbody tfoot".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset".split())
#: A start tag of the key ends an open element of the value, unless one of the last set is nearer.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "col": ({"caption"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rp": ({"rp", "rt"}, {"ruby"}),
    "rt": ({"rp", "rt"}, {"ruby"}),
}
#: Blocks that end an open p.
ENDS_P = BLOCK - {"html", "body", "caption", "tr", "thead", "tbody", "tfoot", "legend"}
#: Widest indent, and deepest table that is laid out in columns.
INDENT, NESTED = 200, 16
#: Most characters of a table whose columns are aligned; the cells of a larger one are two blanks apart.
ALIGNED = 1 << 25
#: Largest colspan and rowspan of HTML (fixed values).
COLSPAN, ROWSPAN = 1000, 65_534

#: A tag as most are written; others are read by _slow_tag. Nothing here backtracks over what it has taken.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:\s++[^\s\"'<>/=]++(?:=\"[^\"<>]*+\")?+)*+)\s*+(/?)>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_KEY = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?+\s*+")
_BARE = re.compile(r"[^\s>]*+")
_GAP = re.compile(r"\s*+")
_ATTR = re.compile(r"([^\s=]++)(?:=\"([^\"]*+)\")?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SEEN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_RULE = re.compile(r"(?:([a-z][\w-]*)|([.#])([\w-]+))", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_LONG_ZEROS, _LONG_NUMBER = re.compile("&#0++"), re.compile("&#[0-9]{8,}+")


def _unescape(text: str) -> str:
    """Character references resolved; numbers beyond Unicode, however long, are the replacement character."""
    if "&" not in text:
        return text
    return _html.unescape(_LONG_NUMBER.sub("&#x110000", _LONG_ZEROS.sub("&#0", text)) if "&#" in text else text)


def _number(text: str | None, low: int, high: int, default: int) -> int:
    """A number of HTML, held between low and high."""
    m = re.match(r"\s*+(-?)\+?0*+([0-9]*+)", text or "")
    if not m[2] and "0" not in m[0]:
        return default
    n = int(m[2][:12] or 0)
    return max(low, min(high, -n if m[1] else n))


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden", "veiled", "foreign")

    def __init__(self, tag: str, attrs: dict | None = None, hidden: bool = False, veiled: bool = False, foreign: bool = False):
        """hidden: not displayed with all it holds; veiled: text isn't visible, that of descendants may be; foreign: inside svg or math."""
        self.tag, self.attrs, self.hidden, self.veiled, self.foreign = tag, attrs or {}, hidden, veiled, foreign
        self.children: list[Node | str] = []


def _slow_tag(source: str, at: int, quotes: bool = True):
    """(name, attributes, self-closing, end) of the tag whose name begins at a place; None if the page ends inside it. quotes: whether a quoted value may hold >."""
    m = _NAME.match(source, at)
    name, at, attrs = m[0], m.end(), {}
    while True:
        m = _KEY.match(source, at)
        at = m.end()
        if at >= len(source):
            return None
        key = m[1]
        if key is None:
            return name, attrs, source[at - 1] == "/", at + 1
        value = ""
        if source[at] == "=":
            at = _GAP.match(source, at + 1).end()
            quote = source[at : at + 1]
            if quotes and quote and quote in "'\"":
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                value = _BARE.match(source, at)[0]
                at += len(value)
        attrs.setdefault(key.lower(), _unescape(value))


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        found.setdefault(name.lower(), _unescape(value))
    return found


def _declared(text: str) -> dict[str, str]:
    """display and visibility of a list of declarations, the last of each."""
    return {k.lower(): v.lower() for k, v in _SEEN.findall(text)}


def _sheet(source: str, folded: str) -> dict[str, dict[str, str]]:
    """What a page's style elements say of display and visibility, by selector of one tag, .class or #id; other selectors and conditional rules are left out."""
    rules: dict[str, dict[str, str]] = {}
    at = folded.find("<style")
    while at >= 0:
        begin = folded.find(">", at)
        end = folded.find("</style", begin) if begin >= 0 else -1
        if end < 0:
            break
        depth, selector, text = 0, "", _COMMENT.sub(" ", source[begin + 1 : end])
        for part in re.split(r"([{}])", text):
            if part == "{":
                depth += 1
            elif part == "}":
                depth = max(0, depth - 1)
            elif depth == 0:
                selector = part.rsplit(";", 1)[-1]
            elif depth == 1 and "@" not in selector:
                if declared := _declared(part):
                    for one in selector.split(","):
                        if m := _RULE.fullmatch(one.strip()):
                            rules.setdefault((m[2] or "") + (m[3] or m[1].lower()), {}).update(declared)
        at = folded.find("<style", end)
    return rules


def _shown(tag: str, attrs: dict[str, str], rules: dict) -> tuple[bool, bool | None]:
    """Whether an element is hidden, and whether its text is veiled (None: as its parent's). A rule of an id comes before one of a class, this before one of a tag; the style attribute before all."""
    hidden, veiled = tag in HIDDEN or tag == "dialog" and "open" not in attrs, None
    if not attrs and not rules:
        return hidden, veiled
    if tag == "input" or attrs.get("aria-hidden", "").lower() == "true":
        hidden = True
    said = dict(rules.get(tag, {}))
    if rules:
        for name in attrs.get("class", "").split():
            said |= rules.get("." + name, {})
        said |= rules.get("#" + attrs.get("id", ""), {})
    if "style" in attrs:
        said |= _declared(attrs["style"])
    hidden = hidden or said.get("display", "none" if "hidden" in attrs else "") == "none"
    if "visibility" in said:
        veiled = said["visibility"] in ("hidden", "collapse")
    return hidden, veiled


def build(source: str) -> Node:
    """The tree of a page: html and body are implied; unclosed, misnested and stray tags are mended, and no text is lost: a tag that never ends is text, and a quote that never ends is none."""
    root = Node("html")
    stack, places = [root], {"html": [0]}  # places: by tag, where it is open in the stack
    end, folded = len(source), source.lower()
    if len(folded) != end:  # some letters fold to two
        folded = re.sub("[A-Z]", lambda x: x[0].lower(), source)
    rules = _sheet(source, folded) if "<style" in folded else {}

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(_unescape(piece))

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(names, bounds) -> None:
        at = last(names)
        if at and at > last(bounds):
            cut(at)

    def close_all(names, bounds) -> None:
        """Ends every open element of names that is inside all of bounds, and so what is inside the outermost of these."""
        bound = last(bounds)
        inside = (places[t][i] for t in names if t in places and (i := bisect_right(places[t], bound)) < len(places[t]))
        at = min(inside, default=0)
        if at:
            cut(at)

    def open_(tag: str, attrs: dict) -> Node:
        up = stack[-1]
        hidden, veiled = _shown(tag, attrs, rules)
        hidden = hidden or up.hidden and len(stack) > 1 or tag in UNDRAWN and up.foreign or up.tag == "details" and tag != "summary" and "open" not in up.attrs
        node = Node(tag, attrs, hidden, up.veiled if veiled is None else veiled, up.foreign or tag in ("svg", "math"))
        up.children.append(node)
        return node

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    at = start = wasted = 0  # start: of the text that waits; wasted: characters read for quotes that never end
    while True:
        at = source.find("<", at)
        if at < 0:
            text(source[start:])
            break
        m = _TAG.match(source, at)
        if m:
            text(source[start:at])
            closing, tag, closed = m[1], m[2].lower(), bool(m[4])
            attrs = _attributes(m[3]) if m[3] and not closing else {}
            at = start = m.end()
        else:
            mark = source[at + 1 : at + 3]
            if mark[:1] in ("!", "?") or mark[:1] == "/" and len(mark) == 2 and not (mark[1].isascii() and mark[1].isalpha()):
                text(source[start:at])
                if source.startswith("<!--", at):
                    # <!--> and <!---> are comments, too
                    stop = at + 4 if source.startswith((">", "->"), at + 4) else source.find("-->", at + 4)
                    at = source.find(">", stop) + 1 if stop >= 0 else end
                elif source.startswith("<![CDATA[", at):
                    stop = source.find("]]>", at)
                    stack[-1].children.append(source[at + 9 : stop if stop >= 0 else end])
                    at = stop + 3 if stop >= 0 else end
                else:
                    stop = source.find(">", at)
                    at = stop + 1 if stop >= 0 else end
                start = at
                continue
            closing = mark[:1] == "/"
            first = mark[1:] if closing else mark[:1]
            if not (first.isascii() and first.isalpha()):
                at += 1  # a lone < is text
                continue
            found = None
            if wasted < 4 * end:
                found = _slow_tag(source, at + 1 + closing)
                wasted += 0 if found else end - at
            found = found or _slow_tag(source, at + 1 + closing, False)  # a quote that never ends is none
            if found is None:  # neither is a tag
                text(source[start:])
                break
            text(source[start:at])
            tag, attrs, closed, at = found
            tag, start = tag.lower(), at
        if closing:
            if tag == "p" and not places.get("p"):
                open_("p", {})
            elif tag == "br":
                open_("br", {})
            elif tag in ("td", "th", "tr", "li", "tbody", "thead", "tfoot"):
                close((tag,), ("table",) if tag != "li" else ("ul", "ol", "menu"))
            elif tag not in ("html", "body"):
                close((tag,), ("td", "th") if tag not in ("table", "tr") else ())
            continue
        if tag in ("html", "body"):
            hidden, veiled = _shown(tag, attrs, rules)
            root.hidden |= hidden
            root.veiled = root.veiled if veiled is None else veiled
            continue
        if tag in ENDS_P and places.get("p"):
            close(("p",), ("td", "th", "button", "table"))
        if tag in IMPLIED_END:
            close_all(*IMPLIED_END[tag])
        if stack[-1].tag == "head" and tag not in HIDDEN:  # the body is implied
            cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(open_("tr", {}))
        if tag == "a" and places.get("a"):
            close(("a",), ("td", "th", "table"))
        node = open_(tag, attrs)
        if tag in VOID or closed and node.foreign and tag not in ("svg", "math"):
            continue
        if tag in RAW:
            stop = folded.find(f"</{tag}", at)
            stop = end if stop < 0 else stop
            body = source[at:stop]
            node.children.append(_unescape(body) if tag in ("textarea", "title") else body)
            close_at = source.find(">", stop)
            at = start = end if close_at < 0 else close_at + 1
            continue
        push(node)
    return root


def width(text: str) -> int:
    """Columns that a text takes: wide letters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Out:
    """Lines of text. Marks go before the lines of the indented blocks that are open: ``first`` before a block's first line, ``more`` before the others."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False
        self.fresh: list[tuple[str, str]] = []  # blocks without a line so far, inside all others
        self.leads = [""]  # what goes before a line, by open block that has one

    def text(self, piece: str, pre: bool) -> None:
        if pre:
            first, *more = piece.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.parts.append(first)
            for x in more:
                self.line(True)
                self.parts.append(x)
            return
        piece = _SPACE.sub(" ", piece)
        if piece.startswith(" ") and (not self.parts or self.parts[-1].endswith(" ")):
            piece = piece[1:]
        if piece:
            self.parts.append(piece)

    def line(self, keep: bool = False) -> None:
        text = "".join(self.parts)
        text = text if keep else text.rstrip(" ")
        self.parts = []
        if text or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = self.leads[-1]
            for first, more in self.fresh:
                self.leads.append((self.leads[-1] + more)[:INDENT])
                lead = lead[: INDENT - len(first)] + first
            marked, self.fresh = bool(self.fresh), []
            self.lines.append(lead + text if text else lead.rstrip(" ") if marked else "")

    def space(self) -> None:
        if not self.fresh:
            self.blank = True

    def indent(self, first: str, more: str) -> None:
        self.fresh.append((first, more))

    def dedent(self) -> None:
        if self.fresh:
            self.fresh.pop()
        else:
            self.leads.pop()
            self.blank = False


class _Columns:
    """Where the cells of a group of rows stand: those that reach down keep their columns for as many rows."""

    def __init__(self):
        self.begins, self.ends = [0], [1 << 62]  # free columns
        self.taken: list[tuple[int, int, int]] = []  # (row that frees them, begin, end)

    def row(self, number: int, spans: list[tuple[int, int]]) -> list[int]:
        """The first column of each cell (colspan, rowspan) of a row."""
        begins, ends = self.begins, self.ends
        while self.taken and self.taken[0][0] <= number:
            _, a, b = heappop(self.taken)
            i = bisect_left(begins, a)
            if i < len(begins) and begins[i] <= b:
                b = max(b, ends.pop(i))
                begins.pop(i)
            if i and ends[i - 1] >= a:
                ends[i - 1] = max(b, ends[i - 1])
            else:
                begins.insert(i, a)
                ends.insert(i, b)
        at, found, down = 0, [], []
        for wide, deep in spans:
            i = bisect_right(begins, at) - 1
            if i < 0 or ends[i] <= at:
                at = begins[i + 1]
            found.append(at)
            if deep > 1:
                down.append((at, at + wide, deep))
            at += wide
        for a, b, deep in down:
            heappush(self.taken, (number + deep, a, b))
            i = bisect_right(begins, a) - 1
            x, y = begins[i], ends[i]
            if y <= a:
                continue
            if x < a:
                ends[i] = a
                i += 1
            else:
                del begins[i], ends[i]
            if b < y:
                begins.insert(i, b)
                ends.insert(i, y)
        return found


def _table(node: Node, out: _Out, level: int) -> None:
    rows: list[list[tuple[int, list[str]]]] = []

    def astray(text: str, owner: Node) -> None:
        if text.strip() and not owner.veiled:  # text astray in a table is shown before it
            out.text(text, False)
            out.line()

    def row(tr: Node, group: list) -> None:
        cells = []
        for c in tr.children:
            if isinstance(c, str):
                astray(c, tr)
            elif c.hidden:
                continue
            elif c.tag in ("td", "th"):
                inner = _Out()
                _flow(c.children, c, inner, level)
                inner.line()
                cells.append((_number(c.attrs.get("colspan"), 1, COLSPAN, 1), _number(c.attrs.get("rowspan"), 0, ROWSPAN, 1), inner.lines or [""]))
            else:
                _flow([c], tr, out, level)
        group.append(cells)

    def place(group: list) -> None:
        columns = _Columns()
        for k, cells in enumerate(group):
            deep = lambda n: min(n or len(group), len(group) - k)
            at = columns.row(k, [(wide, deep(n)) for wide, n, _ in cells])
            if cells:
                rows.append([(i, lines) for i, (_, _, lines) in zip(at, cells)])

    def walk() -> None:
        """Rows of the table in order. What is open: (children left, owner, rows of its group); rowspans end with their group of rows."""
        stack: list[tuple] = [(iter(node.children), node, [])]
        while stack:
            left, owner, group = stack[-1]
            c = next(left, None)
            if c is None:
                place(group)
                stack.pop()
            elif isinstance(c, str):
                astray(c, owner)
            elif c.hidden:
                continue
            elif c.tag == "tr":
                row(c, group)
            elif c.tag in ("thead", "tbody", "tfoot", "colgroup"):
                place(group)
                group.clear()
                stack.append((iter(c.children), c, []))
            elif c.tag != "col":
                _flow([c], owner, out, level)
                out.line()

    walk()
    wide: dict[int, int] = {}
    for r in rows:
        for i, lines in r:
            wide[i] = max(wide.get(i, 0), *map(width, lines))
    begins, total = {}, 0
    for i in sorted(wide):  # a column in which no cell begins takes no room
        begins[i] = total
        total += wide[i] + 2
    aligned = total * len(rows) <= ALIGNED
    for r in rows:
        by_line: list[list[tuple[int, str]]] = [[] for _ in range(max(len(lines) for _, lines in r))]
        for i, lines in r:
            for k, x in enumerate(lines):
                by_line[k].append((i, x))
        for cells in by_line:
            parts, at = [], 0
            for i, x in cells:
                pad = begins[i] - at if aligned else 2 * bool(parts)
                parts += [" " * pad, x]
                at += pad + width(x)
            out.parts = ["".join(parts).rstrip()]
            out.line(True)


def _flow(children: list, owner: Node, out: _Out, level: int = 0) -> None:
    """Renders nodes with a stack of its own: (nodes left, their owner, pre, depth of lists, count of the list's items, what to do at their end)."""
    stack: list[tuple] = [(iter(children), owner, False, 0, None, None)]
    while stack:
        left, owner, pre, depth, items, done = stack[-1]
        c = next(left, None)
        if c is None:
            stack.pop()
            if done:
                done()
            continue
        if isinstance(c, str):
            if not owner.veiled and not (items and not c.strip()) and not (owner.tag == "details" and "open" not in owner.attrs):
                out.text(c, pre)
            continue
        if c.hidden:
            continue
        tag = c.tag
        if tag == "br":
            out.line(True)
            continue
        if tag in ("img", "wbr", "col"):
            alt = c.attrs.get("alt", "") if tag == "img" else ""
            if alt.strip() and not c.veiled:
                out.text(alt, False)
            continue
        if items and tag == "li":
            out.line()
            mark = f"{items[1]}. " if items[0] == "ol" else "- "
            items[1] += 1
            mark = " " * len(mark) if c.veiled else mark

            def end_item():
                out.line()
                out.dedent()

            out.indent(mark, " " * len(mark))
            stack.append((iter(c.children), c, pre, depth, None, end_item))
            continue
        own = tag in BLOCK or tag == "text" or level >= NESTED and tag in ("td", "th")  # svg's text stands by itself
        spaced = tag in SPACED and not (tag in ("ul", "ol") and depth)
        indented = tag in ("blockquote", "dd")
        if own:
            out.line()
            if spaced:
                out.space()

        def end(own=own, spaced=spaced, indented=indented, cell=tag in ("td", "th")):
            if cell:
                out.text(" ", False)
            if own:
                out.line()
            if indented:
                out.dedent()
            if spaced:
                out.space()

        if tag == "table" and level < NESTED:
            _table(c, out, level + 1)
            end()
        elif tag == "hr":
            out.parts = [] if c.veiled else ["---"]
            end()
        elif tag in ("ul", "ol", "menu"):
            stack.append((iter(c.children), c, pre, depth + 1, [tag, _number(c.attrs.get("start"), -999_999_999, 999_999_999, 1)], end))
        else:
            if indented:
                out.indent("  ", "  ")
            stack.append((iter(c.children), c, pre or tag in ("pre", "textarea", "xmp"), depth, None, end))


def visible_text(source: str | None) -> str:
    """All visible text of a page; null and empty pages have none."""
    if not source:
        return ""
    root, out = build(source.replace("\x00", "\ufffd")), _Out()
    if not root.hidden:
        _flow(root.children, root, out)
    out.line()
    while out.lines and not out.lines[-1].strip():
        out.lines.pop()
    return "\n".join(out.lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines (of text; none: 0): one row for each row of pages, repeated rows and null page_ids included. Other columns are ignored."""

    def run(batches):
        for batch in batches:
            pages_ = batch.column("html").to_pylist()
            for a, b in groups(pages_):
                texts = [visible_text(x) for x in pages_[a:b]]
                lines = [x.count("\n") + 1 if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_lines long")


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
