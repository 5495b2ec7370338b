"""Translation states counted and gated.

Frames: ``units`` (unit_id, section[, required]), ``known`` (unit_id, locale, state[, section]) and statuses (locale,
unit_id, section, state[, required]). Counting is one pass with map-side sums; nothing but counts and offenders moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.identity import UNIT_STATES, code_unit_key, state_rank

#: Units that are optional are exempt from these states only.
OPTIONAL_EXEMPT = ("missing", "fuzzy")


class DuplicateUnitError(ValueError):
    """A unit twice in one locale; ``rows`` has (unit_id, locale, previous_section, section)."""

    def __init__(self, rows: list) -> None:
        super().__init__("; ".join(f"duplicate unit id {r.unit_id!r} in locale {r.locale!r}: sections {r.previous_section!r} and {r.section!r}" for r in rows))
        self.rows = rows


class UnknownUnitStateError(ValueError):
    """A state that is none; ``rows`` has (unit_id, locale, state)."""

    def __init__(self, rows: list) -> None:
        super().__init__("; ".join(f"unit {r.unit_id!r} in locale {r.locale!r} has unknown state {r.state!r}; known are {', '.join(UNIT_STATES)}" for r in rows))
        self.rows = rows


@dataclass(frozen=True)
class Policy:
    """Ceilings by state; a state without one isn't gated."""

    name: str
    max_required: dict[str, int] = field(default_factory=dict)
    gate_optional_units: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise ValueError(f"a policy's name must be a non-empty string, got {self.name!r}")
        if not isinstance(self.max_required, dict):
            raise ValueError(f"policy {self.name!r}: max_required must map states to ceilings")
        for state, limit in self.max_required.items():
            if state not in UNIT_STATES:
                raise ValueError(f"policy {self.name!r}: {state!r} is no state; known are {', '.join(UNIT_STATES)}")
            if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
                raise ValueError(f"policy {self.name!r}: the ceiling of {state} must be a non-negative integer, got {limit!r}")

    @property
    def gates_states(self) -> bool:
        return bool(self.max_required)


POLICIES = {"release": Policy("release", {"missing": 0, "fuzzy": 0, "needs-review": 0}), "preview": Policy("preview")}


def resolve_policy(policy: Policy | str) -> Policy:
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}: known policies are {', '.join(sorted(POLICIES))}")
        return POLICIES[policy]
    if not isinstance(policy, Policy):
        raise ValueError(f"a policy or its name is expected, got {type(policy).__name__}")
    if policy.name in POLICIES and policy is not POLICIES[policy.name]:
        raise ValueError(f"the name {policy.name!r} is reserved for the built-in policy")
    return policy


def with_required(statuses: DataFrame) -> DataFrame:
    return statuses if "required" in statuses.columns else statuses.withColumn("required", F.lit(True))


def in_locales(units: DataFrame, locales: list[str]) -> DataFrame:
    """``units`` once for each declared locale: a narrow step, as the manifest lists them."""
    return units.withColumn("locale", F.explode(F.array(*map(F.lit, locales)).cast("array<string>")))


def statuses_for_locales(units: DataFrame, known: DataFrame, locales: list[str]) -> DataFrame:
    """Every source unit in every locale with its known state, or missing. Known units without a source are dropped."""
    states = known.filter(F.col("locale").isin(*locales)).select("locale", "unit_id", "state") if locales else known.limit(0).select("locale", "unit_id", "state")
    rows = in_locales(units, locales).join(states, ["locale", "unit_id"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    return rows.select("locale", "unit_id", "section", "state", *(["required"] if "required" in units.columns else []))


def state_counts() -> list[Column]:
    return [F.count(F.when(F.col("state") == s, 1)).alias(s.replace("-", "_")) for s in UNIT_STATES]


def tally(statuses: DataFrame) -> DataFrame:
    """(level, locale, section, total, one count per state) for sections, locales and all. The total is there even for
    no rows: it is a global aggregate of its own, over the sections' counts."""
    sections = statuses.groupBy("locale", "section").agg(F.count("*").alias("total"), *state_counts())
    counts = ["total", *(s.replace("-", "_") for s in UNIT_STATES)]

    def rolled(frame: DataFrame, level: str, locale: Column, section: Column) -> DataFrame:
        return frame.select(F.lit(level).alias("level"), locale.alias("locale"), section.alias("section"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])

    none = F.lit(None).cast("string")
    by_locale = sections.groupBy("locale").agg(*[F.sum(c).alias(c) for c in counts])
    total = by_locale.agg(*[F.sum(c).alias(c) for c in counts])
    return rolled(sections, "section", F.col("locale"), F.col("section")).unionAll(rolled(by_locale, "locale", F.col("locale"), none)).unionAll(rolled(total, "total", none, none))


def duplicate_units(rows: DataFrame, order: str = "section") -> DataFrame:
    """(locale, unit_id, previous_section, section) of each unit that comes again in its locale."""
    w = W.partitionBy("locale", "unit_id").orderBy(order)
    marked = rows.withColumn("previous_section", F.lag("section").over(w)).withColumn("again", F.row_number().over(w) > 1)
    return marked.filter("again").select("locale", "unit_id", "previous_section", "section")


def unknown_states(rows: DataFrame) -> DataFrame:
    return rows.filter(state_rank(F.col("state")).isNull()).select("locale", "unit_id", "state")


def assert_statuses(rows: DataFrame) -> None:
    """Raises for duplicates and unknown states, naming up to ten of each; a count tells the rest apart."""
    if bad := duplicate_units(rows).orderBy("locale", "unit_id").take(10):
        raise DuplicateUnitError(bad)
    if bad := unknown_states(rows).orderBy("locale", "unit_id").take(10):
        raise UnknownUnitStateError(bad)


def is_gated(policy: Policy, required: Column, state: Column) -> Column:
    return F.coalesce(required, F.lit(True)) | F.lit(policy.gate_optional_units) | ~state.isin(*OPTIONAL_EXEMPT)


def gated_units(statuses: DataFrame, policy: Policy | str) -> DataFrame:
    return with_required(statuses).filter(is_gated(resolve_policy(policy), F.col("required"), F.col("state")))


def violations(statuses: DataFrame, policy: Policy | str) -> DataFrame:
    """(locale, state, limit, count) where more units than the ceiling are in a state."""
    policy = resolve_policy(policy)
    limits = statuses.sparkSession.createDataFrame(sorted(policy.max_required.items()), "state string, limit long")
    counts = gated_units(statuses, policy).groupBy("locale", "state").agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(limits), "state").filter(F.col("count") > F.col("limit")).select("locale", "state", "limit", "count")  # four rows


def offenders(statuses: DataFrame, policy: Policy | str) -> DataFrame:
    """(locale, state, limit, count, unit_id, section): a row for each unit in a state that ``violations`` has. The units of
    a locale may be any number; they are never gathered into one row."""
    over = F.broadcast(violations(statuses, policy))  # four rows a locale at most
    return gated_units(statuses, policy).join(over, ["locale", "state"]).select("locale", "state", "limit", "count", "unit_id", "section")


def report(statuses: DataFrame, policy: Policy | str | None = None) -> dict:
    """The tally, and what a policy says of it, as plain values for the driver's reports."""
    rows = tally(statuses).collect()

    def counts(r) -> dict[str, int]:
        return {s: r[s.replace("-", "_")] for s in UNIT_STATES}

    utf16 = lambda s: s.encode("utf-16-be", "surrogatepass")
    sections: dict[str, list] = {}
    for r in sorted((r for r in rows if r.level == "section"), key=lambda r: utf16(r.section)):
        sections.setdefault(r.locale, []).append({"section": r.section, "total": r.total, "counts": counts(r)})
    total = next(r for r in rows if r.level == "total")
    out = {
        "total": total.total,
        "totals": counts(total),
        "locales": [
            {"locale": r.locale, "total": r.total, "counts": counts(r), "sections": sections.get(r.locale, [])}
            for r in sorted((r for r in rows if r.level == "locale"), key=lambda r: utf16(r.locale))
        ],
    }
    if policy is not None:
        policy = resolve_policy(policy)
        found: dict[tuple, dict] = {}
        for r in sorted(offenders(statuses, policy).collect(), key=lambda r: (utf16(r.locale), UNIT_STATES.index(r.state), r.unit_id)):  # the report names them all
            own = found.setdefault((r.locale, r.state), {"locale": r.locale, "state": r.state, "limit": r.limit, "count": r["count"], "units": []})
            own["units"].append({"id": r.unit_id, "section": r.section})
        out["policy"] = {"name": policy.name, "satisfied": not found, "violations": list(found.values())}
    return out


def ordered_by_code_units(frame: DataFrame, column: str) -> DataFrame:
    return frame.orderBy(code_unit_key(F.col(column)))
