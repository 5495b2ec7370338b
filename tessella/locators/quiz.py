"""Quiz banks: JSON with offsets, the shape of a bank, and its holes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from tessella.locators.spans import Hole, Located, is_safe_container

MAX_DEPTH = 500
# The two schema names (one shape), the keys of a question and of an option, and the form of their ids.
VARIANTS = ("kubernetes-workshop", "opentofu-workshop")
QUESTION_KEYS = ("id", "section", "prompt", "options", "answer", "explanation", "difficulty", "learningObjective", "references")
OPTION_KEYS = ("id", "text", "rationale")
QUESTION_ID = re.compile(r"S[0-9]{2}-Q-[A-Z0-9-]+")
OPTION_ID = re.compile(r"[a-z][a-z0-9-]*")
QUESTION_TEXT, OPTION_TEXT = ("prompt", "explanation"), ("text", "rationale")

TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null)|([\[\]{},:]))')


class JsonError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


@dataclass(frozen=True)
class Node:
    """A value with its place: a dict or list of nodes, or a plain value."""

    value: object
    start: int
    end: int

    def get(self, key: str) -> "Node | None":
        return self.value.get(key) if isinstance(self.value, dict) else None

    def text(self, key: str) -> "Node | None":
        node = self.get(key)
        return node if node is not None and isinstance(node.value, str) else None


def scan(text: str) -> Node:
    """Strict JSON, without repeated keys, without a byte-order mark, to MAX_DEPTH."""
    if text.startswith("﻿"):
        raise JsonError("a byte-order mark is not JSON", 0)
    at = 0

    def token() -> tuple[int, str | None, str | None, str | None, str | None]:
        nonlocal at
        found = TOKEN.match(text, at)
        if not found:
            raise JsonError("unexpected end of input" if not text[at:].strip(" \t\n\r") else "unexpected character", at)
        at = found.end()
        return (found.start(found.lastindex), *found.groups())

    def value(depth: int, start: int, string: str | None, number: str | None, word: str | None, mark: str | None) -> Node:
        if string is not None:
            return Node(json.loads(string), start, at)
        if number is not None:
            return Node(json.loads(number), start, at)
        if word is not None:
            return Node(json.loads(word), start, at)
        if mark not in ("[", "{"):
            raise JsonError(f"unexpected {mark!r}", start)
        if depth >= MAX_DEPTH:
            raise JsonError(f"nested deeper than {MAX_DEPTH}", start)
        shut = "]" if mark == "[" else "}"
        items: list[Node] = []
        members: dict[str, Node] = {}
        nxt = token()
        while nxt[4] != shut:
            if mark == "{":
                if nxt[1] is None:
                    raise JsonError("expected a key", nxt[0])
                key = json.loads(nxt[1])
                if key in members:
                    raise JsonError(f"duplicate key {nxt[1]}", nxt[0])
                if (colon := token())[4] != ":":
                    raise JsonError("expected ':'", colon[0])
                members[key] = value(depth + 1, *token())
            else:
                items.append(value(depth + 1, *nxt))
            nxt = token()
            if nxt[4] == ",":
                nxt = token()
                if nxt[4] == shut:
                    raise JsonError(f"unexpected {shut!r}", nxt[0])
            elif nxt[4] != shut:
                raise JsonError(f"expected ',' or {shut!r}", nxt[0])
        return Node(members if mark == "{" else items, start, at)

    root = value(0, *token())
    if text[at:].strip(" \t\n\r"):
        raise JsonError("unexpected text after the value", at)
    return root


def is_bank(root: Node) -> bool:
    """The shape that both variants have today."""

    def option(node: Node) -> bool:
        return all(node.text(k) for k in OPTION_KEYS)

    def question(node: Node) -> bool:
        options = node.get("options")
        whole = all(node.get(k) is not None for k in QUESTION_KEYS) and all(node.text(k) for k in ("id", "section", *QUESTION_TEXT))
        return whole and isinstance(options.value, list) and bool(options.value) and all(map(option, options.value))

    version, questions = root.get("schemaVersion"), root.get("questions")
    numbered = version is not None and not isinstance(version.value, bool) and version.value == 1 and isinstance(version.value, (int, float))
    return bool(numbered and questions is not None and isinstance(questions.value, list) and questions.value and all(map(question, questions.value)))


def locate_quiz(text: str, schema: str) -> Located:
    """The holes of a bank that has the declared schema."""
    located = Located(text)
    try:
        root = scan(text)
    except (JsonError, RecursionError) as error:
        at = getattr(error, "at", 0)
        located.say("malformed-json", str(error), at, at)
        return located
    if schema not in VARIANTS or not is_bank(root):
        located.say("unknown-quiz-schema", f'the manifest declares "{schema}", but the file matches no known quiz schema', root.start, root.end)
        return located
    seen: dict[str, int] = {}
    for question in root.get("questions").value:
        name = question.text("id")
        if not is_safe_container(name.value) or not QUESTION_ID.fullmatch(name.value):
            located.say("unsafe-question-id", f'question id "{name.value}" is not a usable identity', name.start, name.end)
            continue
        if name.value in seen:
            located.say("duplicate-question-id", f'question id "{name.value}" is already used on line {seen[name.value]}', name.start, name.end)
            continue
        seen[name.value] = text.count("\n", 0, name.start) + 1
        located.containers.append(name.value)
        texts = [(k, question.text(k)) for k in QUESTION_TEXT]
        options: set[str] = set()
        for option in question.get("options").value:
            own = option.text("id")
            if not OPTION_ID.fullmatch(own.value):
                located.say("unsafe-option-id", f'option id "{own.value}" in question "{name.value}" is not usable', own.start, own.end)
            elif own.value in options:
                located.say("duplicate-option-id", f'question "{name.value}" declares option id "{own.value}" more than once', own.start, own.end)
            else:
                options.add(own.value)
                texts += [(f"option/{own.value}/{k}", option.text(k)) for k in OPTION_TEXT]
        located.holes += [Hole(f"quiz:{name.value}:{k}", n.start + 1, n.end - 1, n.value, "json-string") for k, n in texts]
    return located.settle()
