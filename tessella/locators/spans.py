"""What locators give: holes, diagnostics, and the checks that holes must pass. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Ids as in functions.identity, for text that is in Python already.
SURFACES = ("slides", "labs", "quiz")
RESERVED = re.compile(r"(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?", re.IGNORECASE | re.DOTALL)
JS_SPACE = "\t\n\x0b\f\r \xa0                　﻿"


@dataclass(frozen=True)
class Diagnostic:
    code: str
    severity: str
    message: str
    start: int
    end: int
    line: int
    column: int


@dataclass(frozen=True)
class Hole:
    """``kind``: markdown, yaml-scalar, html-inline or json-string. ``note`` and ``cell`` say where a markdown hole is."""

    unit_id: str
    start: int
    end: int
    source: str
    kind: str
    prefix: str = ""
    note: bool = False
    cell: bool = False


@dataclass
class Located:
    """A file's holes in order, its containers (ids of slides, labs or questions) and what there is to say about it."""

    text: str
    holes: list[Hole] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def say(self, code: str, message: str, start: int, end: int, severity: str = "error") -> None:
        before = self.text[:start]
        line_start = before.rfind("\n") + 1
        column = 1 + sum(2 if c > "￿" else 1 for c in before[line_start:])  # columns are UTF-16 units
        self.diagnostics.append(Diagnostic(code, severity, message, start, end, before.count("\n") + 1, column))

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.diagnostics if d.severity == "error"]

    def settle(self) -> "Located":
        """Holes by place; raises if two overlap or share an id."""
        self.holes.sort(key=lambda h: (h.start, h.unit_id))
        for before, hole in zip(self.holes, self.holes[1:], strict=False):
            if hole.start < before.end:
                raise ValueError(f"hole {hole.unit_id} at [{hole.start}, {hole.end}) overlaps the previous hole")
        if len({h.unit_id for h in self.holes}) < len(self.holes):
            raise ValueError("duplicate unit identity")
        return self


def is_safe_container(name: object) -> bool:
    return isinstance(name, str) and len(name) <= 128 and ".." not in name and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) is not None and not name.endswith(".") and not RESERVED.fullmatch(name)


def is_safe_key(key: str) -> bool:
    return 0 < len(key) <= 256 and ".." not in key and "//" not in key and not key.endswith("/") and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:/-]*", key) is not None


def strip_tags(text: str) -> str:
    """Without ``<...>``, in one pass."""
    cut = text.rfind(">") + 1
    return re.sub(r"<[^>]*>", "", text[:cut]) + text[cut:]


def looks_like_prose(line: str) -> bool:
    return len(re.sub(r"&[#\w]+;", "", strip_tags(line), flags=re.ASCII).strip(JS_SPACE)) >= 3


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def without_prefix(raw: str, prefix: str) -> str:
    """The text of a span, its container's prefix off the continuation lines, lines joined by a line feed."""
    first, *rest = lines_of(raw)
    return "\n".join([first, *(x.removeprefix(prefix) for x in rest)])
