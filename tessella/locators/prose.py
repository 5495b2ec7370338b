"""Names the prose of Markdown: a key for each heading, paragraph, cell and summary, by headings and containers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tessella.locators.markdown import Block, blocks, has_text
from tessella.locators.spans import JS_SPACE, Located, looks_like_prose, strip_tags, without_prefix

SUMMARY = re.compile(r"<summary(?:\s[^>\n]*)?>([^\n]*?)</summary\s*>")


@dataclass(frozen=True)
class Span:
    key: str
    start: int
    end: int
    text: str
    prefix: str = ""
    cell: bool = False
    inline_html: bool = False


class Scope:
    """Numbers what stands under the headings that are open below ``base``."""

    def __init__(self, base: str) -> None:
        self.base, self.open, self.seen = base, [], Counter()

    @property
    def path(self) -> str:
        return "/".join([self.base, *(name for _, name in self.open)])

    def name(self, role: str) -> str:
        self.seen[self.path, role] += 1
        return f"{role}-{self.seen[self.path, role]}"

    def next(self, role: str) -> str:
        path = self.path
        return f"{path}/{self.name(role)}"

    def heading(self, level: int) -> str:
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        self.open.append((level, self.name(f"h{level}")))
        return f"{self.path}/title"


def shared_prefix(raw: str) -> str:
    """What the continuation lines of a span in a container begin with in common, of blanks and quote marks."""
    found: str | None = None
    for line in raw.split("\n")[1:]:
        own = re.match(r"[ \t>]*", line)[0]
        if found is None:
            found = own
        while not own.startswith(found):
            found = found[:-1]
    return found or ""


class _Walk:
    def __init__(self, located: Located, labs: bool) -> None:
        self.located, self.labs, self.text = located, labs, located.text

    def emit(self, block: Block, key: str, depth: int, cell: bool = False) -> Iterator[Span]:
        raw = self.text[block.start : block.end]
        if block.start < block.end and raw.strip(JS_SPACE) and has_text(block.inline):
            prefix = shared_prefix(raw) if depth else ""
            yield Span(key, block.start, block.end, without_prefix(raw, prefix), prefix, cell)

    def html(self, block: Block, scope: Scope) -> Iterator[Span]:
        raw = left = self.text[block.start : block.end]
        if self.labs:
            path = scope.next("html")
            for n, found in enumerate(SUMMARY.finditer(raw), 1):
                a, b = found.span(1)
                left = left[:a] + " " * (b - a) + left[b:]
                if re.sub(r"&[#\w]+;", " ", strip_tags(found[1]), flags=re.ASCII).strip(JS_SPACE):
                    yield Span(f"{path}/summary-{n}", block.start + a, block.start + b, found[1], inline_html=True)
        if any(looks_like_prose(line) for line in left.split("\n")):
            self.located.say("prose-in-html-block", "prose inside a raw HTML block is not translated; move it out of the block", block.start, block.end, "warning")

    def walk(self, found: list[Block], scope: Scope, depth: int = 0) -> Iterator[Span]:
        for block in found:
            if block.kind == "heading":
                yield from self.emit(block, scope.heading(block.level), depth)
            elif block.kind == "paragraph":
                yield from self.emit(block, scope.next("p"), depth)
            elif block.kind == "blockquote":
                yield from self.walk(block.children, Scope(scope.next("bq")), depth + 1)
            elif block.kind == "list":
                path = scope.next("l")
                for n, item in enumerate(block.children, 1):
                    yield from self.walk(item.children, Scope(f"{path}/li-{n}"), depth + 1)
            elif block.kind == "table":
                path = scope.next("t")
                for r, row in enumerate(block.children, 1):
                    for c, cell in enumerate(row.children, 1):
                        yield from self.emit(cell, f"{path}/r-{r}/c-{c}", depth + 1, cell=True)
            elif block.kind == "footnote":
                yield from self.walk(block.children, Scope(f"{scope.path}/fn-{block.name}"), depth + 1)
            elif block.kind == "definition" and self.labs and block.name.strip(JS_SPACE):
                self.located.say("prose-in-link-definition", "the title of a link reference definition is not extracted; move it into the link", block.start, block.end, "warning")
            elif block.kind == "html":
                yield from self.html(block, scope)


def prose(located: Located, start: int, end: int, root: str, labs: bool = False) -> list[Span]:
    """The spans of ``located.text[start:end]``; what can't be translated is said in ``located``."""
    part = located.text[start:end]
    mark = 1 if labs and part.startswith("﻿") else 0
    return list(_Walk(located, labs).walk(blocks(part[mark:], start + mark, footnotes=labs), Scope(root)))


Locator = Callable[[str], Located]
