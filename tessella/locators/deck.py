"""Slide decks: where slides begin, their frontmatter, their notes, and the holes of all three.

Slides are parted by lines of three dashes or more. Fences and comments hide such lines by the rules of the slide
tool, which differ from Markdown's: a backtick fence counts at any indentation and closes at a line that begins like
its opener, a fence of tildes doesn't count, and an unclosed fence hides nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import yaml

from tessella.locators.prose import prose
from tessella.locators.spans import JS_SPACE, Hole, Located, is_safe_container, is_safe_key

# Frontmatter keys whose text is translated, and the key of a slide's id.
TEXT_KEYS = (
    "day", "duration", "env", "heading", "kicker", "leftBadge", "leftHeading", "next", "note", "rightBadge", "rightHeading", "story", "subtitle", "title",
)
SLIDE_ID = "slideId"
TILDES = re.compile(r"\s*(~{3,})")


@dataclass
class Slide:
    """Offsets of a slide; ``front`` is (start, body start, body end, end) of its frontmatter."""

    start: int
    body: int
    end: int
    front: tuple[int, int, int, int] | None = None


class _Deck:
    def __init__(self, located: Located) -> None:
        self.located, self.text = located, located.text
        ends = [m.end() for m in re.finditer("\n", self.text)]
        self.starts = [0, *ends]
        self.lines = [x.removesuffix("\r") for x in self.text.split("\n")]
        self.lines[0] = self.lines[0].removeprefix("﻿")
        self.slides: list[Slide] = []
        self.first = self.content = 0
        self.separator: int | None = None
        self.close: int | None = None

    def at(self, line: int) -> int:
        return self.starts[line] if line < len(self.starts) else len(self.text)

    def slide(self, line: int) -> bool:
        """Ends the slide that is open before ``line``."""
        if self.first == line:
            return False
        start, end = self.at(self.first), self.at(line)
        front = None
        if self.separator is not None and self.close is not None:
            front = (self.at(self.separator), self.at(self.separator + 1), self.at(self.close), self.at(self.close + 1))
        elif re.match(r"---[^\n\r  ]*\r?\n[\s\S]*?---", self.text[start:end]):
            self.located.say("phantom-frontmatter", 'this slide begins with "---" without opening a frontmatter block, and contains a later "---"', start, end)
        self.slides.append(Slide(start if self.separator is None else self.at(self.separator + 1), self.at(self.content), end, front))
        self.first = self.content = line + 1
        self.separator = self.close = None
        return True

    def separated(self, n: int, line: str, in_tildes: bool) -> int:
        """A separator at line ``n``: the line to go on from."""
        say, here = self.located.say, (self.at(n), self.at(n + 1))
        if in_tildes:
            say("separator-in-tilde-fence", 'the slide is split at this "---", because tilde fences are not tracked', *here)
        if line != "---":
            say("ambiguous-separator", "the slide is split at this line because it starts with three or more dashes", *here, "warning")
        self.separator = n if self.slide(n) else None
        follows = self.lines[n + 1] if n + 1 < len(self.lines) else ""
        if line[3:4] == "-" or not follows.strip(JS_SPACE):
            return n + 1
        end = next((i for i in range(n + 1, len(self.lines)) if self.lines[i].rstrip(JS_SPACE) == "---"), len(self.lines))
        runs = next((i for i in range(n + 1, end) if self.lines[i].startswith("---")), None)
        if runs is not None:
            say("malformed-frontmatter", "a column-0 run of dashes inside this frontmatter block does not close it", self.at(runs), self.at(runs + 1))
        if end == len(self.lines):
            say("unclosed-frontmatter", 'frontmatter block is never closed by a "---" line', *here)
        else:
            self.close = end
        self.separator = self.first = n
        self.content = end + 1
        return end + 1

    @staticmethod
    def in_comment(line: str, inside: bool) -> bool:
        """Whether a comment is open after the line."""
        rest = line
        while True:
            mark = "-->" if inside else "<!--"
            _, found, rest = rest.partition(mark)
            if not found:
                return inside
            inside = not inside

    def split(self) -> list[Slide]:
        n, comment, tildes = 0, False, 0
        while n < len(self.lines):
            line = self.lines[n].rstrip(JS_SPACE)
            if comment:
                comment = self.in_comment(self.lines[n], True)
            elif line.startswith("---"):
                n = self.separated(n, line, bool(tildes))
                continue
            elif line.lstrip(JS_SPACE).startswith("```"):
                opener = re.match(r"\s*`+", line)[0]
                end = next((i for i in range(n + 1, len(self.lines)) if self.lines[i].startswith(opener)), None)
                if end is None:
                    self.located.say("unclosed-fence", "this fenced block is never closed", self.at(n), self.at(n + 1), "warning")
                else:
                    n = end
            else:
                if run := TILDES.match(line):
                    size = len(run[1])
                    if tildes:
                        tildes = 0 if size >= tildes else tildes
                    elif any((c := TILDES.match(x.rstrip(JS_SPACE))) and len(c[1]) >= size for x in self.lines[n + 1 :]):
                        tildes = size
                comment = self.in_comment(self.lines[n], False)
            n += 1
        if self.first <= len(self.lines) - 1:
            self.slide(len(self.lines))
        return self.slides


def note_of(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The last comment of a slide, if it ends the slide."""
    part = text[start:end].rstrip()
    last = None
    for last in re.finditer(r"<!--.*?-->", part, re.DOTALL):
        pass
    return (start + last.start(), start + last.end()) if last and last.end() == len(part) else None


class CoreLoader(yaml.SafeLoader):
    """YAML 1.2 core: booleans are true and false, nothing is a date, numbers are plain."""


CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"(?:true|True|TRUE|false|False|FALSE)", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
    ("null", r"(?:~|null|Null|NULL|)", ["~", "n", "N", ""]),
    ("merge", r"<<", "<"),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"(?:{_pattern})\Z"), list(_first))


def _fields(located: Located, front: tuple[int, int, int, int], keys: frozenset[str]) -> tuple[str | None, bool, Iterator[tuple[str, int, int, str]]]:
    """The slide's id, whether an id was refused, and (key, start, end, value) of its text fields."""
    start, inner, inner_end, end = front
    body, say = located.text[inner:inner_end], located.say
    none: Iterator = iter(())
    if "---" in body:
        at = inner + body.index("---")
        say("malformed-frontmatter", 'frontmatter contains "---" before its closing delimiter', at, at + 3)
    try:
        root = yaml.compose(body, Loader=CoreLoader)
    except yaml.YAMLError as error:
        say("malformed-frontmatter", f"frontmatter is not valid YAML: {error}".replace("\n", " "), start, end)
        return None, False, none
    if root is None or root.tag == "tag:yaml.org,2002:null":
        return None, False, none
    if not isinstance(root, yaml.MappingNode):
        say("malformed-frontmatter", "frontmatter must be a mapping of keys to values", start, end)
        return None, False, none
    seen, slide_id, refused, found = set(), None, False, []
    for key, value in root.value:
        if not isinstance(key, yaml.ScalarNode) or key.tag != "tag:yaml.org,2002:str":
            continue
        if key.value in seen:
            say("malformed-frontmatter", f"frontmatter is not valid YAML: the key {key.value!r} is there twice", start, end)
            return None, False, none
        seen.add(key.value)
        text = value.value if isinstance(value, yaml.ScalarNode) and value.tag == "tag:yaml.org,2002:str" else None
        if key.value == SLIDE_ID:
            if is_safe_container(text):
                slide_id = text
            else:
                refused = True
                say("unsafe-slide-id", f"{SLIDE_ID} {json.dumps(text, ensure_ascii=False)} is not a safe container id", start, end)
        elif key.value in keys:
            if text is None:
                say("non-scalar-text-field", f"frontmatter key {key.value!r} is declared as translatable text but holds no string", start, end, "warning")
                continue
            a, b = inner + value.start_mark.index, inner + value.end_mark.index
            b = a + len(located.text[a:b].rstrip())
            if a < b:
                found.append((key.value, a, b, text))
    return slide_id, refused, iter(found)


def locate_deck(text: str, text_keys: tuple[str, ...] = TEXT_KEYS) -> Located:
    """The holes of a deck; a slide without a safe id of its own is left out, and said."""
    located = Located(text)
    seen: dict[str, int] = {}
    slides = _Deck(located).split()
    for slide in slides:
        slide_id, refused, fields = _fields(located, slide.front, frozenset(text_keys)) if slide.front else (None, False, iter(()))
        anchor = slide.front[0] if slide.front else slide.start
        if slide_id is None:
            if not refused:
                located.say("missing-slide-id", "slide has no slideId; run init-ids to give it a stable identity", anchor, slide.end)
            continue
        if slide_id in seen:
            located.say("duplicate-slide-id", f'slideId "{slide_id}" is already used on line {seen[slide_id]}', anchor, slide.end)
            continue
        seen[slide_id] = text.count("\n", 0, anchor) + 1
        located.containers.append(slide_id)

        def add(key: str, start: int, end: int, source: str, slide_id: str = slide_id, **more) -> None:
            if not is_safe_key(key):
                located.say("unsafe-slide-id", f"unit identity slides:{slide_id}:{key} is unsafe", start, end)
            else:
                located.holes.append(Hole(f"slides:{slide_id}:{key}", start, end, source, **more))

        for key, a, b, value in fields:
            add(f"fm/{key}", a, b, value, kind="yaml-scalar")
        note = note_of(text, slide.body, slide.end)
        parts = [(slide.body, note[0] if note else slide.end, "body")] + ([(note[0] + 4, note[1] - 3, "note")] if note else [])
        for a, b, root in parts:
            for s in prose(located, a, b, root):
                add(s.key, s.start, s.end, s.text, kind="markdown", prefix=s.prefix, cell=s.cell, note=root == "note")
    return located.settle()
