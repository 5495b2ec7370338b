"""Text functions as column expressions; Python only where Spark has none."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as trimming knows it: the space separators, tab to carriage return, the two separators, the byte-order mark.
TRIMMED = "\\t\\n\\x0B\\f\\r\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: Characters that are not seen and can turn a message round: zero-width ones, marks of direction, the byte-order mark.
INVISIBLE_CODES = (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF)
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]"
UNSAFE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{TRIMMED}]+|[{TRIMMED}]+\\z", "")


def strip_tags(html: Column) -> Column:
    """Without ``<...>``; a ``<`` that nothing closes stays.

    Possessive, and one ``<`` starts a tag only if a ``>`` follows: linear but for a tail of unclosed ``<``, of which
    the text up to the last ``>`` is cut off first.
    """
    closed = F.length(html) - F.instr(F.concat(F.reverse(html), F.lit(">")), ">") + 1
    return F.concat(F.regexp_replace(F.substring(html, F.lit(1), closed), "<[^>]*+>", ""), F.substring(html, closed + 1, F.length(html)))


def looks_like_prose(html: Column) -> Column:
    """Three characters or more are left without tags and entities."""
    return F.length(trimmed(F.regexp_replace(strip_tags(html), "&[#A-Za-z0-9_]+;", ""))) >= 3


def has_unsafe_character(text: Column) -> Column:
    """Control characters other than tab, line feed and carriage return."""
    return text.rlike(UNSAFE)


def neutralised(text: Column) -> Column:
    """Characters that are not seen spelled as escapes, so that a message reads as it is written."""
    out = text
    for code in INVISIBLE_CODES:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(text.rlike(INVISIBLE), out).otherwise(text)


def shown_name(text: str) -> str:
    """A name from outside as a message shows it: control and unseen characters spelled as escapes."""
    return re.sub(rf"{INVISIBLE}|[\x00-\x1f\x7f]", lambda m: f"\\u{ord(m[0]):04x}", text)


def described(value: object) -> str:
    """Any value as a message shows it: as JSON, or by its type's name where JSON has no form for it."""
    try:
        return shown_name(json.dumps(value, ensure_ascii=False))
    except (TypeError, ValueError, RecursionError):
        return type(value).__name__


def position_at(text: Column, offset: Column) -> Column:
    """struct(line, column), both from 1, of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.struct(line.cast("long").alias("line"), column.cast("long").alias("column"))


def count_occurrences(text: Column, token: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token)))) / len(token)).cast("long")


def po_escaped(text: Column) -> Column:
    """Backslash, quote and control characters as a PO string has them; other characters as they are."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}
    has = out.rlike("[\\x00-\\x1F\\x7F]")
    escaped = out
    for code in (*range(32), 127):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\" + named.get(code, f"{code:03o}")))
    return F.when(has, escaped).otherwise(out)


def po_field(keyword: str | Column, text: Column, prefix: Column) -> Column:
    """The lines of a field: one, or an empty string and a line for each part after a line feed."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    parts = F.split(text, "\n")
    ended = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("\n"))).otherwise(p))
    shown = F.when((F.size(ended) > 1) & (F.element_at(ended, -1) == ""), F.slice(ended, 1, F.size(ended) - 1)).otherwise(ended)
    one = F.concat(prefix, word, F.lit(' "'), po_escaped(text), F.lit('"'))
    many = F.concat(prefix, word, F.lit(' ""\n'), F.array_join(F.transform(shown, lambda p: F.concat(prefix, F.lit('"'), po_escaped(p), F.lit('"'))), "\n"))
    return F.when(F.size(shown) <= 1, one).otherwise(many)


def slug(text: str) -> str:
    """Lower-case letters and digits of the compatibility decomposition, other runs as one dash."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", text).lower():
        if "a" <= c <= "z" or "0" <= c <= "9":
            out.append(c)
        elif not 0x300 <= ord(c) <= 0x36F and out and out[-1] != "-":
            out.append("-")
    return "".join(out).strip("-")


@F.pandas_udf(T.StringType())
def slugs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else slug(t))
