"""HTML extraction by layout-aware rendering.

A tree of boxes is built from the tags, with the usual implied end tags; hidden boxes open and close like
others, but are left out with all they hold; in boxes that are only invisible, what is visible again stays. Rendering emits
all visible text: white space collapses, blocks stand on their own lines with a blank line around paragraphs, headings and
tables, list items carry a bullet or their number and an indent, preformatted text keeps its form, and the cells of a table
are padded to columns, with cells over several columns or rows in their places.

Building and rendering take time in proportion to the page and what it renders to, and use no recursion, so very long and
deeply nested pages come out like others.

Null and empty pages give empty text; a tag without an end is text, and from one whose quotes never close quotes mean nothing;
repeated rows are rendered each; a null page_id is carried along; an empty table gives no rows. Only page_id and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)")
REST = re.compile(r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*+>")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

# --- fixed values: element kinds of the HTML standard ------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript xmp".split())
UNSEEN = set("head script style title template noscript iframe noembed noframes datalist meta link param source "
             "track audio video canvas".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
            "option p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure article section".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag ends open elements of these kinds, up to the nearest of the boundaries.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
#: A start tag of any other kind ends an open head.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that a slash closes in their start tag.
FOREIGN = {"svg", "math"}
CELLS = {"td", "th"}
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SCOPE = {"table", "td", "th", "caption", "template"}
# ------------------------------------------------------------------------------------------------

BLOCKS_END_P = BLOCK - {"body", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend"}
for _name in BLOCKS_END_P:
    kinds, stop = IMPLIED.get(_name, (set(), set()))
    IMPLIED[_name] = (kinds | {"p"}, stop | SCOPE)


@dataclass
class Box:
    name: str
    start: int = 1
    inside: list = field(default_factory=list)
    hidden: bool = False
    shown: bool = True
    span: tuple[int, int] = (1, 1)


def attributes(rest: str) -> dict[str, str]:
    found = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), next(filter(None, values), ""))
    return found


def hides(name: str, rest: str) -> bool:
    """Whether a box is left out with all it holds."""
    if name in UNSEEN:
        return True
    if not rest or ("hidden" not in rest.lower() and "none" not in rest.lower()):
        return False
    given = attributes(rest)
    return (
        "hidden" in given
        or bool(NO_DISPLAY.search(html.unescape(given.get("style", ""))))
        or (name == "input" and given.get("type", "").lower() == "hidden")
    )


def shows(rest: str, around: bool) -> bool:
    """Whether a box's own text is visible, given that of the box around."""
    if "visibility" not in rest.lower():
        return around
    found = VISIBILITY.findall(html.unescape(attributes(rest).get("style", "")))
    return found[-1].lower() == "visible" if found else around


def whole_number(text: str, least: int, most: int, otherwise: int) -> int:
    return min(max(int(text), least), most) if re.fullmatch(r"-?\d{1,9}", text) else otherwise


def tags(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(end mark, name, rest, start, stop) of comments (no name) and tags; sent a place, goes on from there."""
    at, last, quotes = 0, page.rfind(">"), True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            stop = len(page) if stop < 0 else stop + 3
            found = ("", "", "")
        elif start > last:
            # nothing closes a tag from here on; only an open comment may follow
            start = page.find("<!--", start)
            if start >= 0:
                yield "", "", "", start, len(page)
            return
        else:
            name = NAME.match(page, start)
            if name:
                rest = REST.match(page, name.end()) if quotes else None
                if quotes and rest is None:
                    # read on without quotes: their end was looked for up to the end of the page, once
                    quotes = False
                stop = rest.end() if rest else page.find(">", name.end()) + 1
                found = (name["end"], name["name"].lower(), page[name.end() : stop - 1])
            elif page[start + 1 : start + 2] in {"!", "?", "/"}:
                stop = page.find(">", start) + 1
                found = ("", "", "")
            else:
                at = start + 1
                continue
        sent = yield *found, start, stop
        at = stop if sent is None else sent


class Stack:
    """Open boxes, with the depths at which each kind is open."""

    def __init__(self, root: Box):
        self.boxes, self.depths = [root], {root.name: [0]}

    @property
    def top(self) -> Box:
        return self.boxes[-1]

    def push(self, box: Box) -> None:
        self.depths.setdefault(box.name, []).append(len(self.boxes))
        self.boxes.append(box)

    def cut(self, depth: int) -> None:
        """Close all boxes from a depth on; the root stays."""
        while len(self.boxes) > max(depth, 1):
            self.depths[self.boxes.pop().name].pop()

    def nearest(self, kinds: Iterable[str]) -> int:
        """Depth of the innermost open box of some kinds, or 0."""
        return max((self.depths[k][-1] for k in kinds if self.depths.get(k)), default=0)


def build(page: str) -> Box:
    """Tree of boxes; text pieces are strings. Hidden boxes take part in it, but nothing is put into them."""
    root = Box("html")
    stack, at = Stack(root), 0

    def text(piece: str) -> None:
        if not piece:
            return
        if stack.top.name == "head" and piece.strip():
            stack.cut(len(stack.boxes) - 1)
        if not stack.top.hidden and stack.top.shown:
            stack.top.inside.append(html.unescape(piece) if "&" in piece else piece)

    found, resume = tags(page), None
    while True:
        try:
            end, name, rest, start, stop = found.send(resume)
        except StopIteration:
            text(page[at:])
            return root
        resume = None
        text(page[at:start])
        at = stop
        if not name:
            continue
        if end:
            if name in {"body", "html"} and stack.top.name == "head":
                stack.cut(len(stack.boxes) - 1)
            depth = stack.nearest((name,))
            free = name in SCOPE | {"tr", "tbody", "thead", "tfoot"}
            if depth and (free or stack.nearest(SCOPE) <= depth):
                stack.cut(depth)
            continue
        if name not in IN_HEAD and stack.top.name == "head":
            stack.cut(len(stack.boxes) - 1)
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = close.start() if close else len(page)
            inner, at = page[at:stop], close.end() if close else len(page)
            resume = at
            shown = not (hides(name, rest) or stack.top.hidden) and shows(rest, stack.top.shown)
            if name == "textarea" and shown:
                stack.top.inside.append(html.unescape(inner))
            elif name == "xmp" and shown:
                stack.top.inside.append(Box("pre", inside=[inner]))  # xmp knows no entities
            continue
        ends, stops = IMPLIED.get(name, ((), ()))
        while ends:
            depth = stack.nearest(ends)
            if not depth or depth < stack.nearest(stops):
                break
            kind = stack.boxes[depth].name
            stack.cut(depth)
            if kind == "p" or name in {"li", "dt", "dd", "td", "th", "option"}:
                break
        around = stack.top
        box = Box(name, hidden=around.hidden or hides(name, rest), shown=shows(rest, around.shown))
        if name == "ol":
            box.start = whole_number(attributes(rest).get("start", "1"), -(10**9), 10**9, 1)
        elif name == "img" and box.shown:
            box.inside.append(html.unescape(attributes(rest).get("alt", "")))
        elif name in CELLS and "span" in rest.lower():
            given = attributes(rest)
            rows = whole_number(given.get("rowspan", "1"), 0, MOST_ROWS, 1)
            box.span = (whole_number(given.get("colspan", "1"), 1, MOST_COLUMNS, 1), rows or MOST_ROWS)
        if not box.hidden:
            around.inside.append(box)
        if name not in VOID and not (name in FOREIGN and rest.endswith("/")):
            stack.push(box)


#: A rendered line: a string, or a pair of a string ahead and a line, so that deep indents are not copied level by level.
Line = str | tuple


def flat(line: Line) -> str:
    parts = []
    while isinstance(line, tuple):
        ahead, line = line
        parts.append(ahead)
    return "".join([*parts, line])


class Page:
    """Lines of rendered text; a request for a blank line is met once text follows."""

    def __init__(self):
        self.lines: list[Line] = []
        self.line: list[str] = []
        self.gap, self.blank = False, False

    def word(self, piece: str) -> None:
        piece = SPACE.sub(" ", piece)
        self.gap |= piece[:1] == " "
        bare = piece.strip(" ")
        if bare:
            self.line.append((" " if self.gap and self.line else "") + bare)
            self.gap = piece[-1:] == " "

    def end(self, blank: bool = False) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.line))
            self.line, self.blank = [], False
        self.blank |= blank
        self.gap = False

    def put(self, lines: list[Line]) -> None:
        self.end()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False

    def done(self) -> list[Line]:
        self.end()
        return self.lines


def raw_text(box: Box) -> str:
    """Text of preformatted boxes."""
    out, left = [], [box]
    while left:
        item = left.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name == "br":
            out.append("\n")
        else:
            left += reversed(item.inside)
    return "".join(out)


#: A step of rendering asks for the lines of a box by one of the functions below, and gives lines in the end.
Steps = Generator[tuple, list, list]


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of rows of cells (text, columns, rows), padded to the columns they stand in."""
    taken: list[list[int]] = []  # [first column, end, rows left] of cells from rows above, by column
    placed, wide = [], {}
    for row in rows:
        at, above, line, below = 0, iter(taken), [], []
        held = next(above, None)
        for text, columns, lasting in [*row, (None, 0, 0)]:
            while held and held[0] <= at or held and text is None:
                line += [("", max(at, held[0]), held[1])] if held[1] > at else []
                at = max(at, held[1])
                below.append(held)
                held = next(above, None)
            if text is None:
                break
            end = at + columns
            if held:
                end = max(at + 1, min(end, held[0]))
            line.append((text, at, end))
            below.append([at, end, lasting])
            at = end
        taken = [[first, end, left - 1] for first, end, left in sorted(below) if left > 1]
        placed.append(line)
        for text, first, end in line:
            if end == first + 1:
                wide[first] = max(wide.get(first, 0), len(text))
    # a cell over several columns widens the last of them where it does not fit
    def width(first: int, end: int) -> int:
        used = [wide[c] for c in range(first, end) if c in wide]
        return sum(used) + 3 * (len(used) - 1 if used else 0)

    for text, first, end in sorted({cell for line in placed for cell in line if cell[2] > cell[1] + 1 and cell[0]}):
        if len(text) > width(first, end):
            last = max((c for c in range(first, end) if c in wide), default=first)
            wide[last] = wide.get(last, 0) + len(text) - width(first, end)
    lines = []
    for line in placed:
        cells = [text.ljust(max(width(first, end), 0)) for text, first, end in line]
        lines.append(" | ".join(cells).rstrip())
    return lines


def table_steps(box: Box) -> Steps:
    """Caption, then rows whose cells are padded to their columns."""
    rows, captions, left = [], [], list(reversed(box.inside))
    while left:
        item = left.pop()
        if isinstance(item, str):
            captions += [item.strip()] if item.strip() else []
        elif item.name == "tr":
            cells = []
            for cell in item.inside:
                if isinstance(cell, Box):
                    lines = yield box_steps, cell
                    cells.append((" ".join(map(flat, lines)), *cell.span))
                elif cell.strip():
                    cells.append((cell.strip(), 1, 1))
            rows.append(cells)
        elif item.name in {"tbody", "thead", "tfoot"}:
            left += reversed(item.inside)
        else:
            captions += yield box_steps, item
    return captions + [line for line in aligned(rows) if line.strip(" |")]


def box_steps(box: Box) -> Steps:
    """Lines of a box: inline and plain block boxes, with lists and tables inside asked for."""
    page = Page()
    left: list = [(box.inside, 0, None)]
    while left:
        inside, at, closing = left.pop()
        if at == len(inside):
            if closing:
                page.end(closing in SPACED)
            continue
        item = inside[at]
        left.append((inside, at + 1, closing))
        if isinstance(item, str):
            page.word(item)
        elif item.name == "br":
            if page.line:
                page.end()
            else:
                page.blank = True
        elif item.name == "table":
            page.end(True)
            page.put((yield table_steps, item))
            page.blank = True
        elif item.name == "pre":
            page.end(True)
            page.put(raw_text(item).strip("\n").split("\n"))
            page.blank = True
        elif item.name in {"ul", "ol", "menu", "dir"}:
            page.end(True)
            page.put((yield list_steps, item))
            page.blank = True
        elif item.name in BLOCK:
            page.end(item.name in SPACED)
            left.append((item.inside, 0, item.name))
        else:
            left.append((item.inside, 0, None))
    return page.done()


def list_steps(box: Box) -> Steps:
    """Items with a bullet or their number, further lines indented."""
    lines, number = [], box.start
    for item in box.inside:
        if isinstance(item, str):
            lines += [SPACE.sub(" ", item.strip())] if item.strip() else []
            continue
        inner = yield box_steps, item if item.name == "li" else Box("div", 1, [item])
        if item.name != "li":
            lines += [("  ", x) for x in inner]
            continue
        mark = f"{number}. " if box.name == "ol" else "- "
        number += 1
        for i, line in enumerate(inner):
            lines.append((mark if i == 0 else " " * len(mark), line) if line else "")
    return lines


def render(box: Box) -> list[str]:
    """Lines of a box. Steps that wait for the lines of a box inside them stand on a list, not on Python's stack."""
    waiting, lines = [box_steps(box)], None
    while waiting:
        try:
            steps, inner = waiting[-1].send(lines)
        except StopIteration as end:
            waiting.pop()
            lines = end.value
        else:
            waiting.append(steps(inner))
            lines = None
    return [flat(line) for line in lines]


def visible_text(page: str | None) -> str:
    """All visible text of a page."""
    return "\n".join(render(build(page))) if page else ""


def extracted(pages: Column) -> Column:
    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        return batch.map(visible_text, na_action=None)

    return text(pages)


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every page."""
    return pages.select("page_id", extracted(F.col("html").cast("string")).alias("text"))
