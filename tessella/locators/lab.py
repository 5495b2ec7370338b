"""Labs: plain Markdown with one marker that names the lab."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessella.locators.prose import prose
from tessella.locators.spans import Hole, Located, is_safe_container, is_safe_key

MARKER = re.compile(r"[ \t]*<!--[ \t]*labId:[ \t]*(.*?)[ \t]*-->[ \t]*")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")


@dataclass(frozen=True)
class Marker:
    lab_id: str
    start: int
    end: int
    line: int

    @property
    def unsafe(self) -> bool:
        return not is_safe_container(self.lab_id)


def markers(text: str) -> list[Marker]:
    """The markers that stand on a line of their own outside fences."""
    out, at, fence = [], 0, ""
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.removesuffix("\r")
        own = line.removeprefix("﻿") if number == 1 else line
        opened = FENCE.match(own)
        if fence:
            if opened and opened[1].startswith(fence) and not own[opened.end() :].strip(" \t"):
                fence = ""
        elif opened:
            fence = opened[1]
        elif found := MARKER.fullmatch(own):
            out.append(Marker(found[1], at, at + len(line), number))
        at += len(raw) + 1
    return out


def locate_lab(text: str) -> Located:
    """The holes of a lab; none without exactly one safe id."""
    located = Located(text)
    found = markers(text)
    if len(found) > 1:
        located.say("duplicate-lab-id", f"this file declares labId on line {found[0].line} and line {found[1].line}", found[1].start, found[1].end)
    elif not found:
        located.say("missing-lab-id", "lab has no labId marker; run init-ids to give it a stable identity", 0, (text.find("\n") + 1) or len(text))
    elif found[0].unsafe:
        located.say("unsafe-lab-id", f'labId "{found[0].lab_id}" is not usable as a container id', found[0].start, found[0].end)
    if located.errors:
        return located
    lab = found[0].lab_id
    located.containers.append(lab)
    for s in prose(located, 0, len(text), "body", labs=True):
        if not is_safe_key(s.key):
            located.say("unsafe-unit-key", f"unit identity labs:{lab}:{s.key} is unsafe", s.start, s.end)
        else:
            located.holes.append(Hole(f"labs:{lab}:{s.key}", s.start, s.end, s.text, "html-inline" if s.inline_html else "markdown", s.prefix))
    return located.settle()
