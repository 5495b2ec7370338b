"""The package's functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import slugs
from tessella.operators.extraction import locate

#: Name to parameters, result and the expression that it stands for: these stay inside Catalyst's sight.
SQL_FUNCTIONS = {
    "source_hash": ("t string", "string", "concat('sha256:', substring(sha2(t, 256), 1, 16))"),
    "unit_id": ("s string, c string, k string", "string", "concat(s, ':', c, ':', k)"),
    "container_of": ("id string", "string", "substring_index(id, ':', 2)"),
    "unit_state": (
        "msgstr array<string>, flags array<string>",
        "string",
        "case when size(msgstr) = 0 or exists(msgstr, x -> x = '') then 'missing' when array_contains(flags, 'fuzzy') then 'fuzzy' when array_contains(flags, 'needs-review') then 'needs-review' else 'reviewed' end",
    ),
    # As in functions.text: what follows the last ``>`` is cut off first, so that unclosed tags cost nothing.
    "strip_tags": (
        "t string",
        "string",
        "concat(regexp_replace(substring(t, 1, length(t) - instr(concat(reverse(t), '>'), '>') + 1), '<[^>]*+>', ''), substring(t, length(t) - instr(concat(reverse(t), '>'), '>') + 2))",
    ),
}


@F.udtf(returnType="unit_id string, `start` bigint, `end` bigint, source string, kind string, severity string, code string, line int")
class LocateUnits:
    """``locate_units(surface, text, quiz_schema)``: the units of a text, and what is to be said of it."""

    def eval(self, surface: str, text: str, quiz_schema: str):
        found = locate(surface, text or "", quiz_schema)
        for h in found.holes:
            yield h.unit_id, h.start, h.end, h.source, h.kind, None, None, None
        for d in found.diagnostics:
            yield None, d.start, d.end, d.message, None, d.severity, d.code, d.line


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark``'s SQL: those above, ``slugify`` and the table function ``locate_units``."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    spark.udf.register("slugify", slugs)
    spark.udtf.register("locate_units", LocateUnits)


__all__ = ["SQL_FUNCTIONS", "LocateUnits", "register"]
