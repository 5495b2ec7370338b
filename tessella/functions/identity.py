"""Unit ids, locale tags and file names as column expressions. Every rule is a CASE whose first hit wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The contract of ids, in the order in which they are listed and tested.
SURFACES = ("slides", "labs", "quiz")
UNIT_STATES = ("missing", "fuzzy", "needs-review", "reviewed")
MAX_CONTAINER_ID = 128
MAX_UNIT_KEY = 256
MAX_LOCALE_TAG = 35
CONTAINER_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
UNIT_KEY = r"^[A-Za-z0-9][A-Za-z0-9._:/-]*\z"
LOCALE_TAG = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8}){0,8}\z"
SOURCE_HASH = r"^sha256:[0-9a-f]{16}\z"
DEVICE_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def unit_id(surface: Column, container: Column, key: Column) -> Column:
    """``surface:container:key``; null if a part is."""
    return F.concat(surface, F.lit(":"), container, F.lit(":"), key)


def parsed_unit_id(text: Column) -> Column:
    """struct(surface, container_id, unit_key), null where the text is no unit id. The key keeps further colons."""
    part = F.split(text, ":", 3)
    surface, container, key = (F.get(part, i) for i in range(3))
    fine = (F.size(part) == 3) & surface.isin(*SURFACES) & (container != "") & (key != "")
    return F.when(fine, F.struct(surface.alias("surface"), container.alias("container_id"), key.alias("unit_key")))


def container_of(text: Column) -> Column:
    """``surface:container`` of a unit id."""
    return F.substring_index(text, ":", 2)


def is_reserved_file_name(name: Column) -> Column:
    """A name that no file can have on Windows."""
    return name.endswith(".") | F.lower(F.get(F.split(name, "[.]", 2), 0)).isin(*DEVICE_NAMES)


def _utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which the bounds are given."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def container_rejection(value: Column) -> Column:
    """Why ``value`` is no container id; null if it is one."""
    return (
        F.when(value.isNull(), "not-a-string")
        .when(value == "", "empty")
        .when(_utf16_length(value) > MAX_CONTAINER_ID, "too-long")
        .when(value.contains("..") | value.contains("/") | value.contains("\\"), "path-traversal")
        .when(~value.rlike(CONTAINER_ID), "illegal-character")
        .when(is_reserved_file_name(value), "reserved-name")
    )


def unit_key_rejection(value: Column) -> Column:
    """Why ``value`` is no unit key; null if it is one."""
    return (
        F.when(value.isNull(), "not-a-string")
        .when(value == "", "empty")
        .when(_utf16_length(value) > MAX_UNIT_KEY, "too-long")
        .when(value.contains("..") | value.contains("\\"), "path-traversal")
        .when(~value.rlike(UNIT_KEY), "illegal-character")
        .when(value.contains("//") | value.endswith("/"), "malformed-separator")
    )


def unit_id_issues(surface: Column, container: Column, key: Column) -> Column:
    """Array of ``field: reason`` for the parts that break a rule, in the order of the parts."""
    unknown = F.when(~F.coalesce(surface.isin(*SURFACES), F.lit(False)), F.lit("surface: unknown-surface"))
    return F.array_compact(
        F.array(unknown, F.concat(F.lit("containerId: "), container_rejection(container)), F.concat(F.lit("unitKey: "), unit_key_rejection(key)))
    )


def locale_rejection(value: Column) -> Column:
    """Why ``value`` is no locale tag; null if it is one."""
    return (
        F.when(value.isNull(), "not-a-string")
        .when(value == "", "empty")
        .when(_utf16_length(value) > MAX_LOCALE_TAG, "too-long")
        .when(~value.rlike(LOCALE_TAG), "illegal-character")
        .when(is_reserved_file_name(value), "reserved-name")
    )


def is_source_hash(value: Column) -> Column:
    return value.rlike(SOURCE_HASH)


def source_hash(text: Column) -> Column:
    """The anchor of an English text: no normalisation, 16 hex digits of its SHA-256."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def code_unit_key(text: Column) -> Column:
    """Sorts as UTF-16 units do; Spark's own order is that of code points."""
    return F.encode(text, "UTF-16BE")


def state_rank(state: Column) -> Column:
    """0 for the worst state; null for what is none."""
    at = F.array_position(F.array(*map(F.lit, UNIT_STATES)), state)
    return F.when(at > 0, at - 1)
