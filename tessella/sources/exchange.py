"""Exchange with translation systems: XLIFF 2.1 documents, and the port that an adapter implements.

An adapter only carries drafts and their sources. What comes back enters catalogs through ``merge.with_drafts``, which
never lets a draft stand for a person's work.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespace, and the states of a segment for the states of a unit.
XLIFF = "urn:oasis:names:tc:xliff:document:2.0"
SEGMENT_STATES = {"missing": "initial", "fuzzy": "translated", "needs-review": "translated", "reviewed": "reviewed"}


def escaped(text: Column) -> Column:
    """Text as XML has it; control characters that XML can't have become U+FFFD."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "�")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def xliff(entries: DataFrame, source_locale: str) -> DataFrame:
    """(locale, path, text): an XLIFF 2.1 document for each catalog. ``entries`` are merged entries; obsolete ones stay out."""
    states = F.create_map(*[F.lit(x) for pair in SEGMENT_STATES.items() for x in pair])
    target = F.coalesce(F.get("msgstr", 0), F.lit(""))
    unit = F.concat(
        F.lit('    <unit id="u'), F.xxhash64("unit_id").cast("string"), F.lit('" name="'), escaped(F.col("unit_id")), F.lit('">\n      <segment state="'), states[F.col("state")], F.lit('">\n        <source xml:space="preserve">'),
        escaped(F.col("msgid")), F.lit("</source>\n"), F.when(target == "", "").otherwise(F.concat(F.lit('        <target xml:space="preserve">'), escaped(target), F.lit("</target>\n"))), F.lit("      </segment>\n    </unit>\n"),
    )
    bodies = entries.filter(~F.col("obsolete")).groupBy("locale", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", unit.alias("t")))), lambda x: x["t"]), "").alias("units"))
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff xmlns="{XLIFF}" version="2.1" srcLang="{source_locale}" trgLang="'), F.col("locale"), F.lit('">\n  <file id="f1" original="'), escaped(F.col("path")), F.lit('">\n')
    )
    return bodies.select("locale", "path", F.concat(head, F.col("units"), F.lit("  </file>\n</xliff>\n")).alias("text"))


class TranslationPort(ABC):
    """What a translation system must do. Frames: units (locale, unit_id, source, source_hash), drafts (locale, unit_id, text)."""

    @abstractmethod
    def push(self, units: DataFrame) -> None:
        """Offers units for translation; the same unit again replaces its source and keeps its draft only if the hash is the same."""

    @abstractmethod
    def pull(self, locale: str) -> DataFrame:
        """The drafts there are for what was pushed last, none empty."""


class MemoryPort(TranslationPort):
    """A port for tests: holds what is pushed, drafts by a rule."""

    def __init__(self, draft) -> None:
        self.draft, self.units = draft, None

    def push(self, units: DataFrame) -> None:
        fresh = units.select("locale", "unit_id", "source", "source_hash")
        if self.units is not None:
            fresh = fresh.unionByName(self.units.join(fresh.select("locale", "unit_id"), ["locale", "unit_id"], "left_anti"))
        self.units = fresh

    def pull(self, locale: str) -> DataFrame:
        rows = self.units.filter(F.col("locale") == locale).select("locale", "unit_id", self.draft(F.col("source")).alias("text"))
        return rows.filter(F.col("text") != "")
