"""Layout-aware text of HTML pages.

A small tree builder closes tags that HTML lets authors leave open (paragraphs,
list items, table parts, options; the head, at the first thing that can't stand in
it), ignores end tags that match nothing, and closes what a matching end tag leaves
open. What is not displayed is dropped with all it
holds: head, script, style and the like, comments, `hidden`, and what styles hide: inline
ones and those of the page's style sheets whose selectors are a tag, classes and an id, the
most specific first and of these the last, media rules left aside. What is displayed but
not visible loses its own text, not that of elements in it that are made visible again.
The renderer then writes the visible text: inline text with blanks squeezed,
one line per block, an empty line around paragraphs, headings and the like, list
items behind a dash or their number, indented by depth (as far as INDENTED levels, marks at any depth),
preformatted text as it is, and table cells padded to the width of their columns (lines longer than WIDEST
stand out). A cell keeps its lines, blocks and lists; cells that span columns or rows leave these
free. A table of one column is written as blocks, and so is one inside NESTED others. Cells count as such behind
other elements too; what stands in a table outside its cells comes out before it.

Defined cases: null and empty pages give an empty text; text outside any tag is
kept; a tag without an end is text; a quote that no other one closes is a character like others;
nesting and length are not bounded; unknown tags are inline; repeated rows repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: tags without content, with raw text, not shown, blocks, blocks with space around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math audio video canvas datalist select title noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp table figure ul ol dl hr".split())
BLOCKS = SPACED | frozenset("html body div article section nav aside header footer main address form fieldset details summary figcaption li dt dd tr td th thead tbody tfoot caption legend option".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())
#: A start tag of the key closes an open tag of the values, unless one of the bars stands between.
_TABLE = frozenset(["table"])
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    **{t: (frozenset(["dt", "dd"]), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (frozenset(["td", "th"]), _TABLE) for t in ("td", "th")},
    "tr": (frozenset(["tr", "td", "th", "caption"]), _TABLE),
    **{t: (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption"]), _TABLE) for t in ("thead", "tbody", "tfoot")},
    **{t: (frozenset(["option", "optgroup"]), frozenset(["select"])) for t in ("option", "optgroup")},
    "body": (frozenset(["head"]), frozenset()),
}
ENDS_P = (BLOCKS - frozenset("html body li dt dd tr td th thead tbody tfoot caption option legend summary".split())) | frozenset(["li", "dt", "dd"])
CELLS, SECTIONS = frozenset(["td", "th"]), frozenset(["thead", "tbody", "tfoot"])
#: Longer lines do not widen a table's column; levels of lists that are indented. Fixed values of HTML: most columns and rows that a cell spans.
WIDEST, INDENTED = 80, 40
#: Tables inside so many others are written as blocks, as each level writes its cells' lines anew.
NESTED = 16
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
P, SCOPE = frozenset(["p"]), frozenset("table td th caption button".split())

ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: What ends a tag, or begins a quoted value behind "=".
NEXT = re.compile(r">|=\s*+([\"'])")
#: Style sheets: comments and blocks of media rules go, then selectors and declarations are read.
NO_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|@[^{};]*+(?:;|\{(?:[^{}]++|\{[^{}]*+\})*+\}?)", re.S)
SIMPLE = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
#: The properties that count, and the values that hide.
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)
HIDING = {"display": ("none",), "visibility": ("hidden", "collapse")}
INHERITED = ("inherit", "unset")


class Node:
    """An element: whether it is displayed, and whether text of its own is visible."""

    __slots__ = ("children", "dark", "found", "seen", "start", "tag")

    def __init__(self, tag: str, seen: bool = True, found: dict[str, str] | None = None):
        self.tag, self.seen, self.dark, self.children = tag, seen, False, []
        self.found = found or {}
        start = self.found.get("start", "1")
        self.start = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1

    def span(self, name: str, most: int) -> int:
        told = self.found.get(name, "1").strip()
        return min(max(int(told), 1), most) if re.fullmatch(r"\d{1,9}", told) else 1


def _element(tag: str, attributes: str) -> Node:
    found: dict[str, str] = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return Node(tag, tag not in UNSEEN and not (tag == "input" and found.get("type") == "hidden"), found)


def declared(style: str) -> dict[str, tuple[bool, bool | None]]:
    """property: (important, whether it hides; None if it is taken from the parent), the last of each."""
    out: dict[str, tuple[bool, bool | None]] = {}
    for name, value, important in DECLARED.findall(style):
        name, value = name.lower(), value.lower()
        new = bool(important), None if value in INHERITED else value in HIDING[name]
        if name not in out or new[0] >= out[name][0]:
            out[name] = new
    return out


#: A selector's tag or "", its id and classes, its rank among selectors, and what it declares.
Rule = tuple[str, frozenset[str], tuple[int, int, int, int], dict]


def rules_of(sheets: list[str]) -> dict[str, list[Rule]]:
    """The rules of simple selectors, by one of the names that an element must have: an id, a class, its tag or "*"."""
    out: dict[str, list[Rule]] = {}
    for n, rule in enumerate(NO_RULE.sub(" ", "\n".join(sheets)).split("}")):
        selectors, _, body = rule.partition("{")
        told = declared(body)
        for selector in selectors.split(",") if told else ():
            m = SIMPLE.fullmatch(selector.strip())
            if m and m[0]:
                tag, names = (m[1] or "").lower().strip("*"), re.findall(r"[.#][\w-]+", m[2])
                ids = sum(x[0] == "#" for x in names)
                key = max(names, key=lambda x: (x[0] == "#", x), default=tag or "*")
                out.setdefault(key, []).append((tag, frozenset(names), (ids, len(names) - ids, int(bool(tag)), n), told))
    return out


def _style(root: Node, rules: dict[str, list[Rule]]) -> None:
    """Decides for every element whether it is displayed and whether its text is visible."""
    todo = [(root, False)]
    while todo:
        x, dark = todo.pop()
        if not x.seen:
            continue
        x.dark = dark
        if x.found or rules:
            best: dict[str, tuple] = {"display": ((False, (-1, 0, 0, 0)), "hidden" in x.found)}
            names = {f".{c}" for c in x.found.get("class", "").split()} | ({f"#{x.found['id']}"} if x.found.get("id") else set())
            told = [(rank, own) for key in (x.tag, "*", *names) for tag, need, rank, own in rules.get(key, ()) if tag in ("", x.tag) and need <= names] if rules else []
            if x.found.get("style"):
                told.append(((1 << 30, 0, 0, 0), declared(x.found["style"])))
            for rank, own in told:
                for name, (important, hides) in own.items():
                    if name not in best or (important, rank) > best[name][0]:
                        best[name] = (important, rank), hides
            x.seen = not best["display"][1]
            hides = best.get("visibility", (None, None))[1]
            x.dark = dark if hides is None else hides
        if x.seen:
            todo += [(c, x.dark) for c in x.children if not isinstance(c, str)]


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the last open one of tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: frozenset[str], bars: frozenset[str]) -> None:
        """Closes the open ones of tags behind the last open one of bars."""
        bar = self.last(bars)
        while (k := self.last(tags)) > bar:
            self.pop_to(k)

    def end(self, tag: str) -> None:
        """An end tag; it does nothing if it matches nothing in the table that it stands in."""
        k = self.last((tag,))
        if k and (tag in ("body", "html", "table") or k > self.last(_TABLE)):
            self.pop_to(k)


def build(page: str) -> Node:
    """The tree of a page; text stands in it as str. Each character is looked at a bounded number of times."""
    root = Node("html")
    open_ = Open(root)
    sheets: list[str] = []

    def add(text: str) -> None:
        if open_.stack[-1].tag == "head" and BLANKS.sub("", text):
            open_.pop_to(len(open_.stack) - 1)
        open_.stack[-1].children.append(text)

    at, n, last = 0, len(page), page.rfind(">")
    quoted = {q: page.rfind(q) for q in "\"'"}
    endless: set[int] = set()  # places in tags behind which all ">" are quoted

    def tag_end(at: int) -> int:
        """Behind the ">" that ends a tag; one in a quoted value does not, unless the quote is never closed."""
        here, seen = at, []
        while here not in endless and (m := NEXT.search(page, here)):
            if not m[1]:
                return m.end()
            if quoted[m[1]] < m.end():
                break
            seen.append(here)
            here = page.find(m[1], m.end()) + 1
        else:
            endless.update(seen, [here])
        return page.find(">", at) + 1

    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            text = page[at:end]
            add(html.unescape(text) if "&" in text else text)
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            add(page[at + 9 : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, at + 1)
        if at > last or not (name or page.startswith(("<!", "<?"), at)):
            add("<")
            at += 1
            continue
        if not name:
            at = page.find(">", at) + 1
            continue
        end = tag_end(name.end())
        if not end:
            add("<")
            at += 1
            continue
        attributes, at, tag = page[name.end() : end - 1], end, name[0].lower()
        if tag[0] == "/":
            open_.end(tag[1:])
            continue
        if open_.stack[-1].tag == "head" and tag not in IN_HEAD:
            open_.pop_to(len(open_.stack) - 1)
        if tag in ENDS_P:
            open_.close(P, SCOPE)
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        node = _element(tag, attributes)
        open_.stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            held = page[at : close.start() if close else n]
            if tag in ("textarea", "xmp"):
                node.children.append(held)
            elif tag == "style":
                sheets.append(held)
            at = close.end() if close else n
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(node)
    _style(root, rules_of(sheets))
    return root


#: Work that yields further work, gets the result of that, and returns its own.
Steps = Generator["Steps", Any, Any]


class Lines:
    """Rendered lines. Blank lines are asked for and come at most one at a time; list items stand behind their marks."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.inline: list[str] = []
        self.frames: list[list] = [["", "", False, 0]]  # of open items: mark, indentation of what follows, blank line asked for, lines
        self.pending = 0  # innermost items without a line so far

    @property
    def depth(self) -> int:
        return len(self.frames) - 1

    def space(self) -> None:
        self.frames[-1][2] = True

    def enter(self, mark: str) -> None:
        self.frames.append([mark, self.frames[-1][1] + " " * len(mark) * (self.depth < INDENTED), False, 0])
        self.pending += 1

    def leave(self) -> None:
        if not self.frames.pop()[3]:
            self.pending -= 1

    def end(self) -> None:
        """Closes the line."""
        text = BLANKS.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if text:
            self.add(text)

    def add(self, line: str) -> None:
        first = len(self.frames) - self.pending  # the frames from here on get their first line
        outer = self.frames[first - 1]
        if outer[2] and outer[3]:
            self.out.append("")
        marks = "".join(f[0] for f in self.frames[first:])
        self.out.append(outer[1] + marks + line if line or marks else "")
        for frame in self.frames[first - 1 :]:
            frame[2], frame[3] = False, 1
        self.pending = 0


def _cells(table: Node) -> tuple[list[list[Node]], list[Node | str]]:
    """The cells of each row, and what else of the table is to be shown, outside its cells. Cells count behind other elements too."""
    below: list[tuple[Node, Node]] = []
    todo: list[Node] = [table]
    while todo:
        x = todo.pop()
        inner = [c for c in x.children if not isinstance(c, str) and c.seen and c.tag != "table"]
        below += [(c, x) for c in inner]
        todo += [c for c in inner if c.tag not in CELLS]
    around: set[int] = set()
    for c, x in reversed(below):
        if c.tag == "tr" or c.tag in CELLS or id(c) in around:
            around.add(id(x))
    rows: list[list[Node]] = []
    others: list[Node | str] = []
    items: list[tuple[Node | str, list[Node] | None, bool]] = [(c, None, table.dark) for c in reversed(table.children)]
    while items:
        c, row, dark = items.pop()
        if isinstance(c, str):
            if not dark and c.strip():
                others.append(c)
        elif not c.seen:
            continue
        elif c.tag in CELLS:
            if row is None:
                rows.append(row := [])
            row.append(c)
        elif c.tag == "tr" or c.tag in SECTIONS or id(c) in around:
            if c.tag == "tr":
                rows.append(row := [])
            items += [(k, row, c.dark) for k in reversed(c.children)]
        else:
            others.append(c)
    return rows, others


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """First and last column of each row's cells: the next that no cell from above spans."""
    out, spanning = [], []  # spanning: first column, column behind, row behind
    for n, cells in enumerate(rows):
        spanning = sorted(s for s in spanning if s[2] > n) if cells else spanning
        line, column, k = [], 0, 0
        for cell in cells:
            while k < len(spanning) and spanning[k][0] <= column:
                column, k = max(column, spanning[k][1]), k + 1
            wide = cell.span("colspan", MOST_COLUMNS)
            if k < len(spanning):
                wide = min(wide, spanning[k][0] - column)
            line.append((column, column + wide - 1, cell))
            column += wide
        spanning += [(a, b + 1, n + high) for a, b, cell in line if (high := cell.span("rowspan", MOST_ROWS)) > 1]
        out.append(line)
    return out


def _table(rows: list[list[Node]], others: list[Node | str], level: int) -> Steps:
    """Rows of a table with cells in columns of even width, behind what stands outside its cells."""
    titles = []
    for c in others:
        titles.append(" ".join((c if isinstance(c, str) else (yield _text(c, level + 1))).split()))
    grid = []
    for line in _placed(rows):
        told = []
        for a, b, cell in line:
            told.append((a, b, (yield _text(cell, level + 1)).split("\n")))
        grid.append(told)
    # Only columns at which a cell begins take room.
    used = sorted({a for line in grid for a, *_ in line})
    place = {a: n for n, a in enumerate(used)}
    behind = [[(place[a], bisect_right(used, b), texts) for a, b, texts in line] for line in grid]
    widths = [0] * len(used)
    for span in sorted({z - a for line in behind for a, z, _ in line}):
        for line in behind:
            for a, z, texts in line:
                if z - a == span:
                    longest = max((len(t) for t in texts if len(t) <= WIDEST), default=0)
                    widths[z - 1] += max(0, longest - sum(widths[a:z]) - 3 * (span - 1))
    out = [t for t in titles if t]
    for line in behind:
        if not any(any(texts) for *_, texts in line):
            continue
        for k in range(max(len(texts) for *_, texts in line)):
            parts, column = [], 0
            for a, z, texts in line:
                parts += [" " * w for w in widths[column:a]]
                parts.append((texts[k] if k < len(texts) else "").ljust(sum(widths[a:z]) + 3 * (z - a - 1)))
                column = z
            out.append(" | ".join(parts).rstrip(" |") if not any(k < len(t) and t[k] for *_, t in line) else " | ".join(parts).rstrip())
    return out


def _into(node: Node, lines: Lines, level: int) -> Steps:
    # A stack of steps instead of recursion, as trees may be deep; tables of several columns are steps of their own.
    todo: list[tuple[Node, int, int]] = [(node, 0, node.start)]

    def edge(x: Node) -> None:
        if x.tag in BLOCKS and x is not node:
            lines.end()
            if x.tag in SPACED and not (lines.depth and x.tag in ("ul", "ol")):
                lines.space()

    while todo:
        x, k, number = todo.pop()
        if k == 0:
            edge(x)
        if k < len(x.children):
            c = x.children[k]
            if isinstance(c, str):
                if not x.dark:
                    lines.inline.append(c)
            elif c.seen and c.tag == "br":
                lines.end()
            elif c.seen and c.tag == "hr":
                lines.end()
                lines.space()
            elif c.seen and c.tag in ("pre", "xmp"):
                lines.end()
                lines.space()
                for line in plain(c).strip("\n").split("\n"):
                    lines.add(line.rstrip())
                lines.space()
            elif c.seen and c.tag == "table" and level < NESTED and (len((table := _cells(c))[1]) or max(map(len, table[0]), default=0) > 1):
                lines.end()
                lines.space()
                for line in (yield _table(*table, level)):
                    lines.add(line)
                lines.space()
            elif c.seen:
                todo.append((x, k + 1, number + (c.tag == "li")))
                if c.tag == "li":
                    lines.end()
                    lines.enter(f"{number}. " if x.tag == "ol" else "- ")
                todo.append((c, 0, c.start))
                continue
            todo.append((x, k + 1, number))
        else:
            edge(x)
            if x.tag == "li" and x is not node:
                lines.leave()


def plain(node: Node) -> str:
    """All visible text below node as it stands."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.seen:
            out += ["\n"] * (x.tag == "br")
            todo += [c for c in reversed(x.children) if not (x.dark and isinstance(c, str))]
    return "".join(out)


def _text(node: Node, level: int = 0) -> Steps:
    """The text below node; level: in how many tables it stands."""
    lines = Lines()
    yield _into(node, lines, level)
    lines.end()
    return "\n".join(lines.out)


def render(node: Node) -> str:
    """The text of a tree. Steps that ask for others' results wait on a stack, so nesting is not bounded."""
    waiting, result = [_text(node)], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as done:
            waiting.pop()
            result = done.value
    return result


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars for every row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [page_text(x) for x in batch["html"]]})

    found = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInPandas(run, f"page_id {dict(pages.dtypes)[id_col]}, text string")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
