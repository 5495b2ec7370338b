"""Composition of one file: replacements are checked where they land, then spliced; all else keeps its bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from tessella.locators.spans import Hole, Located, lines_of

CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
LONE = re.compile("[\ud800-\udfff]")
COMMENT_MARKS = ("<!--", "-->", "--!>")
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})")
EQUALS = re.compile(r" {0,3}=+[ \t]*")
FENCE = re.compile(r" {0,3}(?:`{3,}|~{3,})")
DEFINITION = re.compile(r" {0,3}(\[\^?[^\]]*\]:)")
DETAILS = re.compile(r"</?\s*(?:summary|details)\b", re.IGNORECASE)


@dataclass(frozen=True)
class Issue:
    unit_id: str
    reason: str


class CompositionError(ValueError):
    def __init__(self, issues: list[Issue]) -> None:
        super().__init__("unspliceable translation: " + "; ".join(f"{i.unit_id}: {i.reason}" for i in issues))
        self.issues = issues


def _break(hole: Hole, text: str) -> str:
    """The line break that a hole's lines have; for a lab's single line, that of its own end."""
    raw = text[hole.start : hole.end]
    if "\n" in raw or not hole.unit_id.startswith("labs:"):
        return "\r\n" if "\r\n" in raw else "\n"
    at = text.find("\n", hole.end)
    return "\r\n" if (text[at - 1 : at] == "\r" if at > 0 else "\r\n" in text) else "\n"


def encoded(hole: Hole, text: str, said: str) -> str:
    """What a translation looks like in its place."""
    if hole.kind == "yaml-scalar":
        return json.dumps(said, ensure_ascii=False)
    if hole.kind == "json-string":
        return json.dumps(said, ensure_ascii=False)[1:-1]
    if hole.kind == "html-inline":
        return said
    return (_break(hole, text) + hole.prefix).join(lines_of(said))


def _deck_reason(hole: Hole, new: str, text: str) -> str | None:
    if hole.kind == "yaml-scalar":
        return "slide-separator" if "---" in new else None
    before, after = text[text.rfind("\n", 0, hole.start) + 1 : hole.start], text[hole.end : (text.find("\n", hole.end) + 1 or len(text) + 1) - 1]
    now, then = before + new + after, before + text[hole.start : hole.end] + after
    if any(now.count(m) != then.count(m) for m in COMMENT_MARKS):
        return "comment-terminator"
    bare = lambda s: s.replace("\\|", "").count("|")
    if hole.cell and bare(new) > bare(hole.source):
        return "table-column"
    lines = lines_of(new)
    for n, line in enumerate(lines):
        opens = not before if n == 0 else not hole.prefix and not lines[n - 1].strip()
        if opens and re.match(r" {4,}|\t", line):
            return "indented-code"
    for line in lines_of(now):
        bare_line = line.strip()
        if line.rstrip().startswith("---"):
            return "slide-separator"
        if bare_line.startswith(("```", "~~~")):
            return "fence-opener"
    return None


def _lab_reason(hole: Hole, new: str) -> str | None:
    if any(m in new for m in COMMENT_MARKS):
        return "comment-terminator"
    if hole.kind == "html-inline":
        return "tag-escape" if DETAILS.search(new) or "\n" in new or "\r" in new else None
    had, has = ([m[1] for line in lines_of(t) if (m := DEFINITION.match(line))] for t in (hole.source, new))
    if had != has:
        return "footnote-label" if had else "link-definition"
    for line in lines_of(new):
        for pattern, reason in ((RULE.fullmatch, "thematic-break"), (EQUALS.fullmatch, "setext-underline"), (FENCE.match, "fence-opener")):
            if pattern(line):
                return reason
    return None


def rejection(hole: Hole, new: str, text: str, said: str | None = None) -> str | None:
    """Why a replacement can't stand in its hole; null if it can."""
    surface = hole.unit_id.split(":", 1)[0]
    shown = said if said is not None and surface == "quiz" else new
    if CONTROL.search(shown) or (surface != "labs" and LONE.search(shown)):
        return "control-byte"
    return _deck_reason(hole, new, text) if surface == "slides" else _lab_reason(hole, new) if surface == "labs" else None


BANNER = "generated by {}; do not edit"


def banner(surface: str, text: str, generator: str) -> str:
    """``text`` with a line that says it is generated: in a deck's first frontmatter, after a lab's end, as the first key of a
    JSON object, which are the places where it shows nowhere."""
    said = BANNER.format(generator)
    if surface == "slides":
        head = re.match("\ufeff?---[ \t]*\r?\n", text)
        return f"{head[0]}# {said}\n{text[head.end() :]}" if head else f"---\n# {said}\n---\n{text}"
    if surface == "labs":
        return f"{text}{'' if text.endswith(chr(10)) or not text else chr(10)}\n<!-- {said} -->\n"
    head = re.match("\ufeff?\\s*\\{", text)
    more = "" if head and text[head.end() :].lstrip().startswith("}") else ", "
    return f"{head[0]}{json.dumps('$comment')}: {json.dumps(said)}{more}{text[head.end() :].lstrip(' ')}" if head else text


def compose(located: Located, translations: Mapping[str, str], spans: Iterable[tuple[int, int, str]] = ()) -> str:
    """The file with its translations, and with other text in place of whole ``spans`` (start, end, text).

    A hole without a translation, or with its own source, keeps its bytes; holes inside a span are left out. Raises with
    all issues.
    """
    spans = sorted(spans)
    changes, issues = list(spans), []
    for hole in located.holes:
        said = translations.get(hole.unit_id)
        if said is None or said == hole.source or any(a <= hole.start < b for a, b, _ in spans):
            continue
        new = encoded(hole, located.text, said)
        if reason := rejection(hole, new, located.text, said):
            issues.append(Issue(hole.unit_id, reason))
            continue
        changes.append((hole.start, hole.end, new))
    if issues:
        raise CompositionError(issues)
    parts, at = [], 0
    for start, end, new in sorted(changes):
        parts += [located.text[at:start], new]
        at = end
    return "".join([*parts, located.text[at:]])
