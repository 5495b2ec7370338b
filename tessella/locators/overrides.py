"""Slides that a locale replaces as a whole: what an override file says, and what its slides must keep of the English.

An override of slide ``x`` is ``i18n/<locale>/overrides/x.md``: one or more whole slides. The first one's frontmatter
has ``sourceSlideHash``, the hash of the English slide that it was written for. The first slide keeps the id, the others
get ``x-2``, ``x-3`` and so on unless they declare their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import yaml

from tessella.locators.deck import SLIDE_ID, CoreLoader, _Deck
from tessella.locators.spans import Located, is_safe_container

# Fixed value: the frontmatter key of an override's anchor.
ANCHOR = "sourceSlideHash"
FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??[ \t]*\1[`~]*[ \t]*$", re.MULTILINE | re.DOTALL)


@dataclass(frozen=True)
class SlideText:
    """A slide as it stands: its frontmatter's fields, its text with the frontmatter, its text without, its place."""

    slide_id: str | None
    fields: dict
    text: str
    body: str
    start: int
    end: int


@dataclass
class Override:
    anchor: str | None
    slides: list[SlideText]
    errors: list[str] = field(default_factory=list)


def source_hash(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def fences(text: str) -> list[str]:
    """The fenced blocks of a text, whole, in order."""
    return [m[0] for m in FENCE.finditer(text.replace("\r\n", "\n"))]


def slides_of(text: str) -> list[SlideText]:
    """The slides of a deck; frontmatter that is no mapping counts as none."""
    out = []
    for slide in _Deck(Located(text)).split():
        start = slide.front[0] if slide.front else slide.start
        fields: object = None
        if slide.front:
            try:
                fields = yaml.load(text[slide.front[1] : slide.front[2]], Loader=CoreLoader)
            except yaml.YAMLError:
                fields = None
        fields = fields if isinstance(fields, dict) else {}
        own = fields.get(SLIDE_ID)
        out.append(SlideText(own if is_safe_container(own) else None, fields, text[start : slide.end], text[slide.body : slide.end], start, slide.end))
    return out


def parse_override(text: str) -> Override:
    slides = slides_of(text)
    anchor = slides[0].fields.get(ANCHOR) if slides else None
    errors = [] if slides else ["the override has no slide"]
    if slides and not (isinstance(anchor, str) and re.fullmatch(r"sha256:[0-9a-f]{16}", anchor)):
        errors.append(f"the first slide's frontmatter needs {ANCHOR}, the hash of the English slide")
        anchor = None
    return Override(anchor, slides, errors)


def minted(slide_id: str, override: Override) -> list[str]:
    """The ids of an override's slides."""
    return [slide_id if n == 0 else (s.slide_id or f"{slide_id}-{n + 1}") for n, s in enumerate(override.slides)]


def replacement(slide_id: str, override: Override, ending: str = "\n") -> str:
    """The slides that stand for the English one, each with its id and without the anchor."""
    parts = []
    for name, slide in zip(minted(slide_id, override), override.slides, strict=True):
        kept = {k: v for k, v in slide.fields.items() if k not in (ANCHOR, SLIDE_ID)}
        front = yaml.safe_dump(kept, allow_unicode=True, sort_keys=False, default_flow_style=False) if kept else ""
        body = slide.body if slide.body.endswith("\n") else slide.body + "\n"
        parts.append(f"---\n{SLIDE_ID}: {name}\n{front}---\n{body}")
    return "".join(parts).replace("\r\n", "\n").replace("\n", ending)
