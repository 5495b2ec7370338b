"""What an entry of a catalog says: its state, whether its source moved, whether a draft may replace it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.identity import is_source_hash, source_hash
from tessella.functions.text import trimmed

# The two flags that bear on a state.
FUZZY = "fuzzy"
NEEDS_REVIEW = "needs-review"


def is_header(msgctxt: Column, msgid: Column, obsolete: Column) -> Column:
    return msgctxt.isNull() & (msgid == "") & ~obsolete


def is_translated(msgstr: Column) -> Column:
    """Every plural form is there."""
    return (F.size(msgstr) > 0) & ~F.exists(msgstr, lambda form: form == "")


def unit_state(msgstr: Column, flags: Column) -> Column:
    """Without a translation an entry is missing, whatever its flags."""
    return (
        F.when(~is_translated(msgstr), "missing")
        .when(F.array_contains(flags, FUZZY), "fuzzy")
        .when(F.array_contains(flags, NEEDS_REVIEW), "needs-review")
        .otherwise("reviewed")
    )


def is_draftable(state: Column, flags: Column) -> Column:
    """Nobody's work is lost if a draft replaces the translation."""
    return state.isin("missing", NEEDS_REVIEW) | ((state == FUZZY) & F.array_contains(flags, NEEDS_REVIEW))


def source_moved(msgid: Column, recorded_hash: Column, source: Column) -> Column:
    return (msgid != source) | F.coalesce(recorded_hash != source_hash(msgid), F.lit(False))


def _pairs(comments: Column) -> Column:
    """(key, value) of the extracted comments of the form ``key: value``."""
    own = F.filter(comments, lambda c: (c["marker"] == ".") & c["text"].contains(":"))
    return F.transform(
        own, lambda c: F.struct(trimmed(F.substring_index(c["text"], ":", 1)).alias("key"), trimmed(F.regexp_replace(c["text"], "^[^:]*:", "")).alias("value"))
    )


def provenance(comments: Column, source_key: str, hash_key: str) -> Column:
    """struct(reference, recorded_hash): the first source comment, and the first hash comment that is well formed."""
    pairs = _pairs(comments)
    reference = F.get(F.filter(pairs, lambda p: p["key"] == source_key), 0)["value"]
    recorded = F.get(F.filter(pairs, lambda p: (p["key"] == hash_key) & is_source_hash(p["value"])), 0)["value"]
    return F.struct(reference.alias("reference"), recorded.alias("recorded_hash"))


def with_provenance(comments: Column, reference: Column, digest: Column, source_key: str, hash_key: str) -> Column:
    """The comments with fresh provenance where the first old one stood, else in front."""

    def owned(c: Column) -> Column:
        return (c["marker"] == ".") & c["text"].contains(":") & trimmed(F.substring_index(c["text"], ":", 1)).isin(source_key, hash_key)

    ours = F.transform(comments, owned)
    first = F.greatest(F.array_position(ours, F.lit(True)).cast("int") - 1, F.lit(0))
    kept = F.filter(comments, lambda c: ~owned(c))
    before = F.filter(comments, lambda c, i: ~owned(c) & (i < first))
    after = F.slice(kept, F.size(before) + 1, F.greatest(F.size(kept) - F.size(before), F.lit(0)))

    def comment(key: str, value: Column) -> Column:
        return F.struct(F.lit(".").alias("marker"), F.concat(F.lit(f" {key}: "), value).alias("text"))

    hashed = F.array(comment(hash_key, digest))
    fresh = F.when(reference.isNull(), hashed).otherwise(F.concat(F.array(comment(source_key, reference)), hashed))
    return F.concat(before, fresh, after)
