"""A block parser for Markdown that keeps offsets: headings, paragraphs, quotes, lists, tables, code, HTML, definitions.

Containers are taken line by line: the lines of a quote or a list item are gathered with their markers off and parsed
in turn. A line knows its offset in the file, so every block knows its own. Inlines are scanned only as far as the
question goes whether there is any text to translate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from dataclasses import replace as with_

from tessella.locators.spans import JS_SPACE

ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
BULLET = re.compile(r"[-+*](?=[ \t]|$)|(\d{1,9})[.)](?=[ \t]|$)")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
FOOTNOTE = re.compile(r"\[\^((?:[^\[\]\s\\]|\\.)+)\]:")
DELIMITER_CELL = re.compile(r":?-+:?")
# The element names that open an HTML block.
BLOCK_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|"
    "param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
ATTRIBUTE = r"\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
TAG = rf"<(?:[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>"
HTML: list[tuple[re.Pattern, re.Pattern | None]] = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{BLOCK_TAGS})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?!<(?:script|pre|style|textarea)\b){TAG}\s*$", re.I), None),
]
INLINE_HTML = re.compile(rf"<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z].*?>|<!\[CDATA\[.*?\]\]>|{TAG}", re.DOTALL)
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")
LINK_END = re.compile(r"\]\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\]\[[^\[\]]*\]")


@dataclass(frozen=True)
class Line:
    """``text`` begins at ``at`` in the file and in column ``column``; ``pad`` columns of a split tab stand before it."""

    at: int
    text: str
    column: int = 0
    pad: int = 0
    lazy: bool = False

    @property
    def blank(self) -> bool:
        return not self.text.strip(" \t")

    def indent(self) -> int:
        column = self.column + self.pad
        for c in self.text:
            if c == " ":
                column += 1
            elif c == "\t":
                column += 4 - column % 4
            else:
                break
        return column - self.column

    def drop(self, columns: int) -> "Line":
        """Without so many columns of indentation; what a tab has left over becomes padding."""
        left, at, column = columns - self.pad, 0, self.column + self.pad
        if left < 0:
            return with_(self, pad=-left, column=self.column + columns)
        while left > 0 and at < len(self.text) and self.text[at] in " \t":
            width = 1 if self.text[at] == " " else 4 - column % 4
            at, left, column = at + 1, left - width, column + width
        return Line(self.at + at, self.text[at:], column - max(0, -left), max(0, -left), self.lazy)

    def bare(self) -> "Line":
        """Without indentation."""
        return self.drop(self.indent())

    def after(self, count: int) -> "Line":
        """Without ``count`` characters, none of them a tab."""
        return Line(self.at + count, self.text[count:], self.column + self.pad + count, 0, self.lazy)


@dataclass
class Block:
    kind: str
    start: int = 0
    end: int = 0
    level: int = 0
    name: str = ""
    inline: str = ""
    children: list["Block"] = field(default_factory=list)


def _fence(line: Line) -> re.Match | None:
    return FENCE.match(line.bare().text) if line.indent() < 4 else None


def _html_kind(line: Line, in_paragraph: bool) -> int | None:
    if line.indent() > 3:
        return None
    text = line.bare().text
    if not text.startswith("<"):
        return None
    return next((n for n, (opens, _) in enumerate(HTML) if opens.match(text) and not (n == 6 and in_paragraph)), None)


def _bullet(line: Line, in_paragraph: bool) -> re.Match | None:
    if line.indent() > 3:
        return None
    text = line.bare().text
    found = BULLET.match(text)
    if not found or RULE.match(text):
        return None
    if in_paragraph and (not text[found.end() :].strip(" \t") or (found[1] is not None and int(found[1]) != 1)):
        return None
    return found


def _cells(line: Line) -> list[tuple[int, str]]:
    """(offset, text) of a row's cells, trimmed."""
    text, out = line.text, []
    bounds = [m.start(1) for m in re.finditer(r"(?:[^\\|]|\\.|\\$)*?(\|)", text)]
    edges = [-1, *bounds, len(text)]
    for a, b in zip(edges, edges[1:], strict=False):
        out.append((a + 1, text[a + 1 : b]))
    if out and not out[0][1].strip(" \t"):
        out = out[1:]
    if out and bounds and not out[-1][1].strip(" \t"):
        out = out[:-1]
    return [(line.at + o + len(t) - len(t.lstrip(" \t")), t.strip(" \t")) for o, t in out]


class Parser:
    """``footnotes``: definitions of footnotes are containers."""

    def __init__(self, footnotes: bool = False) -> None:
        self.footnotes = footnotes

    def starts_block(self, line: Line, outside: bool = False) -> bool:
        """A line that ends a paragraph. ``outside``: the line is beyond the paragraph's container, where any list begins."""
        if line.indent() > 3:
            return False
        text = line.bare().text
        return bool(
            text.startswith(">") or ATX.match(text) or RULE.match(text) or _fence(line) or _bullet(line, not outside) or _html_kind(line, True) is not None
            or (self.footnotes and FOOTNOTE.match(text))
        )

    def parse(self, lines: list[Line]) -> list[Block]:
        out: list[Block] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if line.blank:
                i += 1
                continue
            text = line.bare().text
            if line.indent() > 3:
                i = self._indented(lines, i)
            elif found := ATX.match(text):
                out.append(self._atx(line.bare(), found))
                i += 1
            elif _fence(line):
                i = self._fenced(lines, i)
            elif RULE.match(text):
                i += 1
            elif text.startswith(">"):
                i = self._quote(lines, i, out)
            elif _bullet(line, False):
                i = self._list(lines, i, out)
            elif self.footnotes and FOOTNOTE.match(text):
                i = self._footnote(lines, i, out)
            elif (kind := _html_kind(line, False)) is not None:
                i = self._html(lines, i, kind, out)
            else:
                i = self._paragraph(lines, i, out)
        return out

    @staticmethod
    def _indented(lines: list[Line], i: int) -> int:
        while i < len(lines) and not lines[i].lazy and (lines[i].blank or lines[i].indent() > 3):
            i += 1
        return i

    @staticmethod
    def _atx(line: Line, found: re.Match) -> Block:
        inner = line.text[found.end() :].rstrip(" \t")
        shut = len(inner) - len(inner.rstrip("#"))
        if shut and (shut == len(inner) or inner[-shut - 1] in " \t"):
            inner = inner[:-shut].rstrip(" \t")
        at = line.at + found.end()
        return Block("heading", at, at + len(inner), level=len(found[1]), inline=inner)

    @staticmethod
    def _fenced(lines: list[Line], i: int) -> int:
        opened = _fence(lines[i])
        mark = opened[1] or opened[3]
        closes = re.compile(re.escape(mark[0]) + "{" + str(len(mark)) + r",}[ \t]*$")
        i += 1
        while i < len(lines):
            if lines[i].lazy:
                return i
            if lines[i].indent() < 4 and closes.match(lines[i].bare().text):
                return i + 1
            i += 1
        return i

    @staticmethod
    def _html(lines: list[Line], i: int, kind: int, out: list[Block]) -> int:
        start, shut = lines[i].bare().at, HTML[kind][1]
        while True:
            end = lines[i].at + len(lines[i].text)
            i += 1
            if shut is not None and shut.search(lines[i - 1].text):
                break
            if i == len(lines) or lines[i].lazy or (shut is None and lines[i].blank):
                break
        out.append(Block("html", start, end))
        return i

    def _tail_is_paragraph(self, lines: list[Line]) -> bool:
        """Whether the last of the gathered lines leaves a paragraph open."""
        if not lines or lines[-1].blank:
            return False
        if lines[-1].lazy:
            return True
        seen: list[bool] = []
        inner = Parser(self.footnotes)
        inner._on_end = seen.append  # type: ignore[attr-defined]
        inner.parse(lines)
        return bool(seen and seen[-1])

    def _gather(self, lines: list[Line], i: int, own: list[Line], take: Callable[[Line], Line | None]) -> int:
        """Adds the following lines of a container: those that ``take`` gives, and lazy ones of an open paragraph."""
        while i < len(lines):
            mine = take(lines[i]) if not lines[i].lazy else None
            if mine is None:
                if lines[i].blank or self.starts_block(lines[i], outside=True) or not self._tail_is_paragraph(own):
                    break
                mine = with_(lines[i], lazy=True)
            own.append(mine)
            i += 1
        return i

    def _quote(self, lines: list[Line], i: int, out: list[Block]) -> int:
        def take(line: Line) -> Line | None:
            if line.indent() > 3 or not line.bare().text.startswith(">"):
                return None
            inner = line.bare().after(1)
            return inner.drop(1) if inner.indent() else inner

        own: list[Line] = []
        i = self._gather(lines, i, own, take)
        out.append(Block("blockquote", children=self.parse(own)))
        return i

    def _list(self, lines: list[Line], i: int, out: list[Block]) -> int:
        found = _bullet(lines[i], False)
        mark, items = found[0][-1], []
        while i < len(lines):
            found = _bullet(lines[i], False) if not lines[i].lazy else None
            if not found or found[0][-1] != mark:
                break
            line = lines[i]
            outer = line.indent()
            inner = line.bare().after(found.end())
            gap = inner.indent()
            width = 1 if inner.blank or gap > 4 else gap
            offset = outer + found.end() + width
            own = [inner.drop(width) if not inner.blank else inner]
            i += 1
            if inner.blank and i < len(lines) and lines[i].blank:
                items.append(Block("item"))
                while i < len(lines) and lines[i].blank:
                    i += 1
                continue

            def take(line: Line, offset: int = offset) -> Line | None:
                if line.blank:
                    return line
                return line.drop(offset) if line.indent() >= offset else None

            i = self._gather(lines, i, own, take)
            while own and own[-1].blank and len(own) > 1:
                own.pop()
            items.append(Block("item", children=self.parse(own)))
        out.append(Block("list", children=items))
        return i

    def _footnote(self, lines: list[Line], i: int, out: list[Block]) -> int:
        found = FOOTNOTE.match(lines[i].bare().text)
        inner = lines[i].bare().after(found.end())
        own = [inner.bare()]

        def take(line: Line) -> Line | None:
            return line if line.blank else line.drop(4) if line.indent() >= 4 else None

        i = self._gather(lines, i + 1, own, take)
        out.append(Block("footnote", name=re.sub(r"\\(.)", r"\1", found[1]).lower(), children=self.parse(own)))
        return i

    def _paragraph(self, lines: list[Line], i: int, out: list[Block]) -> int:
        held: list[Line] = []
        on_end = getattr(self, "_on_end", None)
        while i < len(lines):
            line = lines[i]
            if line.blank:
                break
            if held and not line.lazy and line.indent() < 4 and (under := SETEXT.match(line.bare().text)):
                rest = self._definitions(held, out)
                if rest:
                    out.append(self._inline("heading", rest, 1 if under[1][0] == "=" else 2))
                    if on_end:
                        on_end(False)
                    return i + 1
                held = rest
            if held and not line.lazy and self.starts_block(line):
                break
            if i + 1 < len(lines) and (table := self._table(lines, i)) is not None:
                if held:
                    self._close(held, out)
                end, block = table
                out.append(block)
                if on_end:
                    on_end(False)
                return end
            held.append(line.bare())
            i += 1
        self._close(held, out)
        if on_end:
            on_end(i == len(lines))
        return i

    def _close(self, held: list[Line], out: list[Block]) -> None:
        if rest := self._definitions(held, out):
            out.append(self._inline("paragraph", rest))

    @staticmethod
    def _inline(kind: str, held: list[Line], level: int = 0) -> Block:
        last = held[-1].text.rstrip(" \t")
        return Block(kind, held[0].at, held[-1].at + len(last), level=level, inline="\n".join([*(x.text for x in held[:-1]), last]))

    @staticmethod
    def _definitions(held: list[Line], out: list[Block]) -> list[Line]:
        """Takes link reference definitions off the front of a paragraph."""
        pattern = re.compile(
            r"\[(?!\^)((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)",
            re.DOTALL,
        )
        bare = re.compile(pattern.pattern.replace(r"(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?", "()"), re.DOTALL)
        while held and held[0].text.startswith("["):
            text = "\n".join(x.text for x in held)
            found = pattern.match(text) or bare.match(text)
            if not found or not found[1].strip():
                break
            used = text[: found.end()].count("\n") + (not text[: found.end()].endswith("\n"))
            last = held[used - 1]
            out.append(Block("definition", held[0].at, last.at + len(last.text.rstrip(" \t")), name=(found[3] or "")[1:-1]))
            held = held[used:]
        return held

    def _table(self, lines: list[Line], i: int) -> tuple[int, Block] | None:
        head, rule = lines[i], lines[i + 1]
        if head.lazy or rule.lazy or rule.blank or head.indent() > 3 or rule.indent() > 3 or ("|" not in head.text and "|" not in rule.text):
            return None
        marks = _cells(rule.bare())
        if not marks or not all(DELIMITER_CELL.fullmatch(t) for _, t in marks) or ("|" not in rule.text and ":" not in rule.text and len(marks) == 1 and "|" not in head.text):
            return None
        top = _cells(head.bare())
        if len(top) != len(marks):
            return None
        rows, at = [top], i + 2
        while at < len(lines) and not lines[at].blank and not lines[at].lazy and not self.starts_block(lines[at]) and lines[at].indent() < 4:
            rows.append(_cells(lines[at].bare()))
            at += 1
        return at, Block("table", children=[Block("row", children=[Block("cell", o, o + len(t), inline=t) for o, t in row]) for row in rows])


def blocks(text: str, base: int = 0, footnotes: bool = False) -> list[Block]:
    """The blocks of ``text``, which begins at ``base`` in its file."""
    lines, at = [], base
    for raw in text.split("\n"):
        lines.append(Line(at, raw.removesuffix("\r")))
        at += len(raw) + 1
    return Parser(footnotes).parse(lines)


def has_text(inline: str) -> bool:
    """Whether there is anything but code, images, HTML and footnote marks."""
    if "`" in inline:
        inline = re.sub(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)", "", inline, flags=re.DOTALL)
    if AUTOLINK.search(inline):
        return True
    inline = INLINE_HTML.sub("", inline)
    inline = re.sub(r"!\[(?:[^\[\]]|\[[^\[\]]*\])*" + LINK_END.pattern.replace(r"|\]\[[^\[\]]*\]", r"|\]\[[^\[\]]*\]|\]"), "", inline)
    inline = re.sub(r"\[\^[^\[\]\s]+\]", "", inline)
    inline = LINK_END.sub("]", inline)
    inline = re.sub(r"(?<!\\)[*_~]+|\[\s*\]|\\\n", "", inline)
    inline = re.sub(r"\[\s*\]", "", inline)
    return bool(inline.strip(JS_SPACE + "\\"))
