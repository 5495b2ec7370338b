"""The registered queries over the reference's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import identity as ids
from tessella.functions import text as tx
from tessella.operators import composition, extraction, gates, merge, policy, splice, states
from tessella.plans import relations as rel
from tessella.plans.relations import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Comment keys of the provenance in these queries; a workspace takes them from its manifest.
SOURCE_KEY, HASH_KEY = "l10n-source", "l10n-hash"
SPACE_ONLY = r"[\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# Identity


@query("source_hash_units", sql("select unit_id, 'sha256:' || substr(sha256(source), 1, 16) as source_hash from src", "src"))
def source_hash_units(spark, d):
    return rel.source_units(spark, d).select("unit_id", ids.source_hash(F.col("source")).alias("source_hash"))


def _candidate_ids(spark, d):
    """Ids good and bad, from the conversations: of each turn the whole text (``n`` 0) and every word."""
    c = rel.table(spark, d, "conversations")
    keys = F.concat(F.array(F.replace("text", F.lit(" "), F.lit("/"))), F.split("text", " "))
    container = F.concat(F.when(F.col("turn") % 5 == 4, "co n-").when(F.col("turn") % 7 == 6, "").otherwise("conv-"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 6 == 5, "..").otherwise(""))
    surface = F.when(F.col("role") == "user", "slides").when(F.col("role") == "assistant", "quiz").otherwise(F.col("role"))
    return c.select("conv_id", "turn", surface.alias("surface"), container.alias("container_id"), F.posexplode(keys).alias("n", "unit_key"))


_CAND = """turns as (select conv_id, turn, case when role = 'user' then 'slides' when role = 'assistant' then 'quiz' else role end as surface,
  (case when turn % 5 = 4 then 'co n-' when turn % 7 = 6 then '' else 'conv-' end) || conv_id || (case when turn % 6 = 5 then '..' else '' end) as container_id,
  list_prepend(replace(text, ' ', '/'), string_split(text, ' ')) as k from conversations where text is not null),
cand as (select conv_id, turn, surface, container_id, i as n, k[i + 1] as unit_key from (select *, unnest(range(len(k))) as i from turns))"""
_RESERVED = "(ends_with({0}, '.') or lower(string_split({0}, '.')[1]) in ('con','prn','aux','nul','com1','com2','com3','com4','com5','com6','com7','com8','com9','lpt1','lpt2','lpt3','lpt4','lpt5','lpt6','lpt7','lpt8','lpt9'))"
_CONTAINER = (
    "case when {0} is null then 'not-a-string' when {0} = '' then 'empty' when length({0}) > 128 then 'too-long' when contains({0}, '..') or contains({0}, '/') or contains({0}, '\\') then 'path-traversal' "
    "when not regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9._-]*') then 'illegal-character' when " + _RESERVED + " then 'reserved-name' end"
)
_KEY = (
    "case when {0} is null then 'not-a-string' when {0} = '' then 'empty' when length({0}) > 256 then 'too-long' when contains({0}, '..') or contains({0}, '\\') then 'path-traversal' "
    "when not regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9._:/-]*') then 'illegal-character' when contains({0}, '//') or ends_with({0}, '/') then 'malformed-separator' end"
)


@query(
    "unit_id_parse_validate",
    f"""with {_CAND}, x as (select *, surface || ':' || container_id || ':' || unit_key as raw, {_CONTAINER.format("container_id")} as c, {_KEY.format("unit_key")} as k, surface not in ('slides', 'labs', 'quiz') as s from cand)
    select conv_id, turn, n, raw as unit_id, not s and container_id <> '' and unit_key <> '' as parses, concat_ws(', ', case when s then 'surface: unknown-surface' end, 'containerId: ' || c, 'unitKey: ' || k) as issues from x""",
)
def unit_id_parse_validate(spark, d):
    s, c, k = F.col("surface"), F.col("container_id"), F.col("unit_key")
    raw = ids.unit_id(s, c, k)
    rows = _candidate_ids(spark, d)
    return rows.select("conv_id", "turn", "n", raw.alias("unit_id"), ids.parsed_unit_id(raw).isNotNull().alias("parses"), F.array_join(ids.unit_id_issues(s, c, k), ", ").alias("issues"))


@query("container_id_rejections", f"with {_CAND} select coalesce({_CONTAINER.format('container_id')}, 'safe') as reason, count(*) as n from cand group by 1")
def container_id_rejections(spark, d):
    return _candidate_ids(spark, d).groupBy(F.coalesce(ids.container_rejection(F.col("container_id")), F.lit("safe")).alias("reason")).agg(F.count("*").alias("n"))


@query("unit_key_rejections", f"with {_CAND} select unit_key, {_KEY.format('unit_key')} as reason, count(*) as n from cand group by all")
def unit_key_rejections(spark, d):
    return _candidate_ids(spark, d).groupBy("unit_key", ids.unit_key_rejection(F.col("unit_key")).alias("reason")).agg(F.count("*").alias("n"))


_TAG = "case when p_partkey % 11 = 0 then 'aux' when p_partkey % 13 = 0 then '' else lower(substr(p_type, 1, 2)) || '-' || p_brand || case when p_size > 40 then '-abcdefghi' when p_size > 30 then '-abcdefgh-abcdefgh-abcdefgh' else '' end end"


@query(
    "locale_rejections",
    f"with x as (select p_partkey, replace({_TAG}, '#', '') as tag from part) select p_partkey, tag, case when tag = '' then 'empty' when length(tag) > 35 then 'too-long' when not regexp_full_match(tag, '[A-Za-z]{{2,8}}(-[A-Za-z0-9]{{1,8}}){{0,8}}') then 'illegal-character' when {_RESERVED.format('tag')} then 'reserved-name' end as reason from x",
)
def locale_rejections(spark, d):
    rows = rel.table(spark, d, "part").select("p_partkey", F.expr(f"replace({_TAG}, '#', '')").alias("tag"))
    return rows.select("p_partkey", "tag", ids.locale_rejection(F.col("tag")).alias("reason"))


@query("reserved_names", f"with x as (select o_orderkey, case when o_orderkey % 4 = 0 then 'NUL.' || o_orderstatus when o_orderkey % 4 = 1 then 'com' || (o_orderkey % 12) when o_orderkey % 4 = 2 then o_orderpriority || '.' else o_orderpriority end as name from orders) select o_orderkey, name, {_RESERVED.format('name')} as reserved from x")
def reserved_names(spark, d):
    name = "case when o_orderkey % 4 = 0 then 'NUL.' || o_orderstatus when o_orderkey % 4 = 1 then 'com' || (o_orderkey % 12) when o_orderkey % 4 = 2 then o_orderpriority || '.' else o_orderpriority end"
    return rel.table(spark, d, "orders").select("o_orderkey", F.expr(name).alias("name")).withColumn("reserved", ids.is_reserved_file_name(F.col("name")))


@query("source_hash_shape", sql("select n % 3 as kind, count(*) as n, count(*) filter (regexp_full_match(case n % 3 when 0 then h when 1 then upper(h) else h || chr(10) end, 'sha256:[0-9a-f]{16}')) as good from (select n, 'sha256:' || substr(sha256(source), 1, 16) as h from src) group by 1", "src"))
def source_hash_shape(spark, d):
    rows = rel.source_units(spark, d).select("n", ids.source_hash(F.col("source")).alias("h"))
    seen = F.when(F.col("n") % 3 == 0, F.col("h")).when(F.col("n") % 3 == 1, F.upper("h")).otherwise(F.concat("h", F.lit("\n")))
    return rows.groupBy((F.col("n") % 3).alias("kind")).agg(F.count("*").alias("n"), F.count(F.when(ids.is_source_hash(seen), 1)).alias("good"))


@query("code_unit_order")
def code_unit_order(spark, d):
    """The documents' texts in UTF-16 order; SQL has no such order."""
    rows = rel.table(spark, d, "documents").select(F.col("text").alias("head")).distinct()
    return policy.ordered_by_code_units(rows.withColumn("key", F.hex(ids.code_unit_key(F.col("head")))), "head")


# States and policy


@query("unit_state_mapping", sql("select state, flag, count(*) as n from (select flag, case when msgstr = '' then 'missing' when flag = 'fuzzy' then 'fuzzy' when flag = 'needs-review' then 'needs-review' else 'reviewed' end as state from e) group by all", "e"))
def unit_state_mapping(spark, d):
    rows = rel.old_entries(spark, d).select(F.array_join("flags", ",").alias("flag"), states.unit_state(F.col("msgstr"), F.col("flags")).alias("state"))
    return rows.groupBy("state", "flag").agg(F.count("*").alias("n"))


def _statuses(spark, d, *more):
    units = rel.source_units(spark, d)
    return policy.statuses_for_locales(units.select("unit_id", "section", *more), rel.known_states(spark, d), rel.LOCALES)


@query("statuses_left_join", sql("select locale, unit_id, section, state from st", "st"))
def statuses_left_join(spark, d):
    return _statuses(spark, d)


_COUNTS = "count(*) as total, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'fuzzy') as fuzzy, count(*) filter (state = 'needs-review') as needs_review, count(*) filter (state = 'reviewed') as reviewed"


@query(
    "tally_grouping_sets",
    sql(f"select case when grouping(locale) = 1 then 'total' when grouping(section) = 1 then 'locale' else 'section' end as level, locale, section, {_COUNTS} from st group by grouping sets ((locale, section), (locale), ())", "st"),
)
def tally_grouping_sets(spark, d):
    return policy.tally(_statuses(spark, d))


@query(
    "policy_release_violations",
    sql("select locale, state, 0::bigint as \"limit\", count, unit_id, section from (select *, count(*) over (partition by locale, state) as count from st where state in ('missing', 'fuzzy', 'needs-review')) where count > 0", "st"),
)
def policy_release_violations(spark, d):
    return policy.offenders(_statuses(spark, d), "release")


@query("policy_preview", sql("select locale, state, 0::bigint as \"limit\", 0::bigint as count from st where false", "st"))
def policy_preview(spark, d):
    return policy.violations(_statuses(spark, d), "preview")


@query("policy_custom_threshold", sql("select locale, state, lim as \"limit\", count(*) as count from st join lim using (state) group by all having count(*) > lim", "st", more="lim(state, lim) as (values ('missing', 1000::bigint), ('fuzzy', 20), ('reviewed', 100))"))
def policy_custom_threshold(spark, d):
    return policy.violations(_statuses(spark, d), policy.Policy("custom", {"missing": 1000, "fuzzy": 20, "reviewed": 100}))


def _optional(spark, d):
    return _statuses(spark, d, (F.col("n") % 3 != 0).alias("required"))


@query("gated_units", sql("select locale, unit_id, section, state, n % 3 <> 0 as required from st where n % 3 <> 0 or state not in ('missing', 'fuzzy')", "st"))
def gated_units(spark, d):
    return policy.gated_units(_optional(spark, d), "release")


@query("gated_units_optional", sql("select locale, state, count(*) as n from st group by all", "st"))
def gated_units_optional(spark, d):
    strict = policy.Policy("strict", {"missing": 0}, gate_optional_units=True)
    return policy.gated_units(_optional(spark, d), strict).groupBy("locale", "state").agg(F.count("*").alias("n"))


@query(
    "duplicate_units",
    "with x as (select 'de' as locale, 'labs:user-' || user_id || ':body/' || event_type as unit_id, lpad(event_id::varchar, 12, '0') as section from events), y as (select *, lag(section) over w as previous_section from x window w as (partition by locale, unit_id order by section)) select locale, unit_id, previous_section, section from y where previous_section is not null",
)
def duplicate_units(spark, d):
    e = rel.table(spark, d, "events")
    name = F.concat(F.lit("labs:user-"), F.col("user_id").cast("string"), F.lit(":body/"), F.col("event_type"))
    rows = e.select(F.lit("de").alias("locale"), name.alias("unit_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("section"))
    return policy.duplicate_units(rows)


@query("unknown_states", "select 'de' as locale, 'quiz:conv-' || conv_id || ':' || turn as unit_id, role as state from conversations where role not in ('missing', 'fuzzy', 'needs-review', 'reviewed')")
def unknown_states(spark, d):
    c = rel.table(spark, d, "conversations")
    return policy.unknown_states(c.select(F.lit("de").alias("locale"), F.concat(F.lit("quiz:conv-"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("unit_id"), F.col("role").alias("state")))


# The merge


def _merged(spark, d):
    return merge.merged(rel.fresh_units(spark, d), rel.old_entries(spark, d), SOURCE_KEY, HASH_KEY)


@query("catalog_merge_outcomes", sql("select locale, unit_id, outcome, moved from m", "m"))
def catalog_merge_outcomes(spark, d):
    return merge.classified(rel.fresh_units(spark, d), rel.old_entries(spark, d)).select("locale", "unit_id", "outcome", "moved")


@query(
    "catalog_merge_entries",
    sql(
        f"""select locale, path, unit_id, outcome, obsolete, msgid, msgstr, state, case when moved then old_msgid else prev end as previous_msgid,
        concat_ws(',', nullif(flag, ''), case when moved and flag <> 'fuzzy' then 'fuzzy' end) as flags,
        case when u_source is null then '' else '. {SOURCE_KEY}: ' || reference || '|. {HASH_KEY}: sha256:' || substr(sha256(u_source), 1, 16) end as comments from ms""",
        "ms",
    ),
)
def catalog_merge_entries(spark, d):
    return _merged(spark, d).select(
        "locale", "path", "unit_id", "outcome", "obsolete", "msgid", F.get("msgstr", 0).alias("msgstr"), "state", F.col("previous.msgid").alias("previous_msgid"),
        F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("comments", lambda c: F.concat(c["marker"], c["text"])), "|").alias("comments"),
    )


@query("merge_duplicate_batch", "select 'de' as locale, 'quiz:conv-' || conv_id || ':' || role as unit_id, count(*) as n from conversations group by all having count(*) > 1")
def merge_duplicate_batch(spark, d):
    """Ids that a batch has twice: a merge refuses such a batch."""
    c = rel.table(spark, d, "conversations")
    return merge.repeated_units(c.select(F.lit("de").alias("locale"), F.concat(F.lit("quiz:conv-"), F.col("conv_id").cast("string"), F.lit(":"), F.col("role")).alias("unit_id")))


@query(
    "merge_live_before_dead",
    sql(
        """select coalesce(u.unit_id, e.unit_id) as unit_id, case when e.unit_id is null then 'added' when u.unit_id is null and e.dead then 'kept' when u.unit_id is null then 'obsoleted' when e.dead then 'resurrected' else 'there' end as outcome, e.dead as dead
        from u full join (select unit_id, dead from (select *, unnest([false, true]) as dead from (select unit_id, doc_id, obsolete as was from e)) where dead or doc_id % 3 = 0) e on u.unit_id = e.unit_id
        where not (u.unit_id is not null and coalesce(e.dead, false) and u.doc_id % 3 = 0)""",
        "u", "e",
    ),
)
def merge_live_before_dead(spark, d):
    """Catalogs with an obsolete entry of every id, and a live one of some: the live one meets the unit."""
    old = rel.old_entries(spark, d)
    both = old.filter("doc_id % 3 = 0").withColumn("obsolete", F.lit(False)).unionByName(old.withColumn("obsolete", F.lit(True)))
    rows = merge.classified(rel.fresh_units(spark, d), both)
    outcome = F.when(F.col("outcome").isin("fuzzied", "unchanged"), "there").otherwise(F.col("outcome"))
    return rows.select("unit_id", outcome.alias("outcome"), F.col("e_obsolete").alias("dead"))


@query(
    "merge_summary_by_locale",
    sql(
        "select locale, count(*) filter (outcome = 'added') as added, count(*) filter (outcome = 'unchanged') as unchanged, count(*) filter (outcome = 'fuzzied') as fuzzied, count(*) filter (outcome = 'resurrected') as resurrected, count(*) filter (outcome = 'obsoleted') as obsoleted, count(*) filter (outcome = 'resurrected' and state = 'fuzzy') as resurrected_fuzzy, count(*) filter (outcome = 'fuzzied' or (outcome = 'resurrected' and state = 'fuzzy')) as fuzzy from ms group by locale",
        "ms",
    ),
)
def merge_summary_by_locale(spark, d):
    return merge.summary(_merged(spark, d))


@query("obsolete_carryover", sql("select locale, path, unit_id, outcome, msgstr from ms where obsolete", "ms"))
def obsolete_carryover(spark, d):
    return _merged(spark, d).filter("obsolete").select("locale", "path", "unit_id", "outcome", F.get("msgstr", 0).alias("msgstr"))


@query("resurrected_units", sql("select locale, unit_id, path, state from ms where outcome = 'resurrected'", "ms"))
def resurrected_units(spark, d):
    return _merged(spark, d).filter("outcome = 'resurrected'").select("locale", "unit_id", "path", "state")


@query("leftover_anti_join", sql("select locale, unit_id, path from e where unit_id not in (select unit_id from u)", "u", "e"))
def leftover_anti_join(spark, d):
    return merge.leftovers(rel.old_entries(spark, d), rel.fresh_units(spark, d)).select("locale", "unit_id", "path")


@query("orphan_catalogs", sql("select distinct locale, path from e where path not in (select path from t)", "e", more="t as (select distinct 'i18n/de/old/' || source || '.po' as path from documents where doc_id % 40 = 1)"))
def orphan_catalogs(spark, d):
    docs = rel.table(spark, d, "documents").filter("doc_id % 40 = 1")  # these sources' catalogs still have their file
    targets = docs.select(F.lit("de").alias("locale"), F.concat(F.lit("i18n/de/old/"), F.col("source"), F.lit(".po")).alias("path")).distinct()
    return merge.orphan_catalogs(rel.old_entries(spark, d), targets)


@query(
    "pool_duplicate_ids",
    "with x as (select 'de' as locale, 'quiz:conv-' || conv_id || ':' || role as unit_id, 'i18n/de/' || (turn % 3) || '.po' as path, turn as line from conversations) select locale, unit_id, array_to_string(list_sort(list(path || ':' || line)), ' and ') as places from x group by locale, unit_id having count(*) > 1",
)
def pool_duplicate_ids(spark, d):
    c = rel.table(spark, d, "conversations")
    name = F.concat(F.lit("quiz:conv-"), F.col("conv_id").cast("string"), F.lit(":"), F.col("role"))
    path = F.concat(F.lit("i18n/de/"), (F.col("turn") % 3).cast("string"), F.lit(".po"))
    return merge.duplicate_ids(c.select(F.lit("de").alias("locale"), name.alias("unit_id"), path.alias("path"), F.col("turn").alias("line")))


@query("catalog_path_layout", "select page_id, url, 'i18n/pt-BR/' || regexp_replace(p, '([^/])\\.[^./]*$', '\\1') || '.po' as catalog_path from (select page_id, url, regexp_replace(url, '^[a-z]+://', '') as p from pages)")
def catalog_path_layout(spark, d):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return rel.table(spark, d, "pages").select("page_id", "url", merge.catalog_path(F.lit("pt-BR"), path).alias("catalog_path"))


@query(
    "catalog_path_collisions",
    "with x as (select distinct 'labs/' || p_brand || case p_partkey % 3 when 0 then '.md' when 1 then '.json' else '' end as path from part) select 'i18n/_/' || regexp_replace(path, '([^/])\\.[^./]*$', '\\1') || '.po' as catalog_path, array_to_string(list_sort(list(path)), ' and ') as owners from x group by 1 having count(*) > 1",
)
def catalog_path_collisions(spark, d):
    ending = F.when(F.col("p_partkey") % 3 == 0, ".md").when(F.col("p_partkey") % 3 == 1, ".json").otherwise("")
    return merge.path_collisions(rel.table(spark, d, "part").select(F.concat(F.lit("labs/"), F.col("p_brand"), ending).alias("path")))


@query("donor_header", sql("select u.locale, u.path, arg_min(e.path, u.n) as donor from u join e using (locale, unit_id) group by all", "u", "e"))
def donor_header(spark, d):
    return merge.donor_paths(rel.fresh_units(spark, d).withColumn("ord", F.col("n")), rel.old_entries(spark, d))


_SHIFT = """old as (select locale, string_split(unit_id, ':')[2] as c, case when outcome = 'fuzzied' then old_msgid else msgid end as english, unit_id as from_id, outcome = 'obsoleted' as late from ms where outcome in ('fuzzied', 'obsoleted')),
    one as (select locale, c, english, from_id from (select *, row_number() over (partition by locale, c, english order by late, from_id) as k from old) where k = 1),
    sh as (select ms.locale, ms.unit_id, one.from_id from ms join one on one.locale = ms.locale and one.c = string_split(ms.unit_id, ':')[2] and one.english = ms.msgid where ms.outcome in ('added', 'fuzzied') and one.from_id <> ms.unit_id)"""
# A line of a lab that moves down by one: what was line n is line n + 1, so that units shift within their container.
_MOVED = "(doc_id % 29 = 0)"


def _shifted_rows(spark, d):
    units = rel.fresh_units(spark, d)
    moved = units.filter(_MOVED).withColumn("n", F.col("n") + 1).withColumn("unit_id", rel.unit_name(F.col("doc_id"), F.col("n")))
    return merge.merged(units.filter(f"not {_MOVED}").unionByName(moved), rel.old_entries(spark, d), SOURCE_KEY, HASH_KEY)


def _shift_sql(body: str) -> str:
    own = rel.SQL["u"].replace("'labs:doc-' || doc_id || ':body/p-' || n as unit_id", "'labs:doc-' || doc_id || ':body/p-' || (case when doc_id % 29 = 0 then n + 1 else n end) as unit_id")
    return f"with {rel.SQL['ln']}, {own}, {rel.SQL['e']}, {rel.SQL['m']}, {rel.SQL['ms']}, {_SHIFT} {body}"


@query("shifted_units", _shift_sql("select locale, unit_id, from_id from sh"))
def shifted_units(spark, d):
    return merge.shifted_units(_shifted_rows(spark, d))


@query(
    "rekeyed_containers",
    _shift_sql(
        """, k as (select locale, 'labs:' || string_split(unit_id, ':')[2] as container, count(*) filter (outcome = 'added') as added, count(*) filter (outcome = 'fuzzied') as fuzzied, count(*) filter (outcome = 'obsoleted') as obsoleted from ms group by all),
        s as (select locale, 'labs:' || string_split(unit_id, ':')[2] as container, count(*) as shifted from sh group by all)
        select locale, container, added, fuzzied, obsoleted, coalesce(shifted, 0) as shifted, coalesce(shifted, 0) > 0 or (added > 0 and obsoleted > 0) as certain from k left join s using (locale, container)
        where coalesce(shifted, 0) > 0 or (added > 0 and obsoleted > 0) or (added > 0 and fuzzied > 0)"""
    ),
)
def rekeyed_containers(spark, d):
    return merge.rekeyed_containers(_shifted_rows(spark, d))


_DRAFTABLE = "not obsolete and (msgstr = '' or flag = 'needs-review')"


@query("draftable_entries", sql(f"select locale, unit_id from e where {_DRAFTABLE}", "e"))
def draftable_entries(spark, d):
    return merge.draftable(rel.old_entries(spark, d)).select("locale", "unit_id")


def _drafts(spark, d):
    rows = rel.source_units(spark, d)
    return rows.select(F.lit("de").alias("locale"), "unit_id", F.when(F.col("doc_id") % 6 == 5, "").otherwise(F.concat(F.lit("draft of "), F.col("unit_id"))).alias("text"))


@query(
    "apply_draft",
    sql(
        f"""select e.locale, e.unit_id, case when dr.text is not null then 'needs-review' else flag end as flags, coalesce(dr.text, msgstr) as msgstr from e
        left join (select unit_id, case when doc_id % 6 = 5 then '' else 'draft of ' || unit_id end as text from src where doc_id % 6 <> 5) dr on dr.unit_id = e.unit_id and {_DRAFTABLE} where not obsolete""",
        "src", "e",
    ),
)
def apply_draft(spark, d):
    out, _ = merge.with_drafts(rel.old_entries(spark, d), _drafts(spark, d))
    return out.select("locale", "unit_id", F.array_join("flags", ",").alias("flags"), F.get("msgstr", 0).alias("msgstr"))


@query(
    "refused_drafts",
    sql(
        f"select 'de' as locale, s.unit_id, case when s.doc_id % 6 = 5 then 'empty-draft' when e.unit_id is null then 'no-entry' else 'human-work' end as reason from src s left join e on e.unit_id = s.unit_id and not e.obsolete where s.doc_id % 6 = 5 or e.unit_id is null or not ({_DRAFTABLE})",
        "src", "e",
    ),
)
def refused_drafts(spark, d):
    _, refused = merge.with_drafts(rel.old_entries(spark, d), _drafts(spark, d))
    return refused.select("locale", "unit_id", "reason")


@query(
    "provenance_read",
    sql("select unit_id, case when n % 4 = 0 then null else 'labs/' || section || '.md' end as reference, case when n % 3 = 0 then null else 'sha256:' || substr(sha256(source), 1, 16) end as recorded_hash from src", "src"),
)
def provenance_read(spark, d):
    rows = rel.source_units(spark, d)

    def comment(marker, text):
        return F.struct(F.lit(marker).alias("marker"), text.alias("text"))

    where = F.concat(F.when(F.col("n") % 4 == 0, " other: ").otherwise(F.lit(f" {SOURCE_KEY}: ")), F.lit("labs/"), F.col("section"), F.lit(".md"))
    digest = F.concat(F.lit(f" {HASH_KEY}: "), F.when(F.col("n") % 3 == 0, "none").otherwise(ids.source_hash(F.col("source"))))
    comments = F.array(comment("", F.lit(" by hand")), comment(".", where), comment(".", F.lit(f" {HASH_KEY}: sha256:short")), comment(".", digest))
    return rows.select("unit_id", states.provenance(comments, SOURCE_KEY, HASH_KEY).alias("p")).select("unit_id", "p.reference", "p.recorded_hash")


# Text


@query("strip_tags", "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as plain from pages")
def strip_tags(spark, d):
    return rel.table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query(
    "looks_like_prose",
    r"with x as (select page_id, i + 1 as n, l[i + 1] as line from (select page_id, string_split(html, chr(10)) as l, unnest(range(len(string_split(html, chr(10))))) as i from pages)) select page_id, count(*) as lines, count(*) filter (length(regexp_replace(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'), '&[#A-Za-z0-9_]+;', '', 'g'), '^[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2028}\x{2029}]+|[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2028}\x{2029}]+$', '', 'g')) >= 3) as prose from x group by page_id",
)
def looks_like_prose(spark, d):
    lines = rel.table(spark, d, "pages").select("page_id", F.explode_outer(F.split("html", "\n")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.count(F.when(tx.looks_like_prose(F.col("line")), 1)).alias("prose"))


@query("coverage_gaps", "select url as section, count(*) as gaps from (select url, unnest(string_split(html, chr(10))) as line from pages) where contains(line, '<table') or contains(line, '<script') group by url")
def coverage_gaps(spark, d):
    """Warnings per file: here one for each line that opens a table or a script."""
    lines = rel.table(spark, d, "pages").select(F.col("url").alias("path"), F.explode_outer(F.split("html", "\n")).alias("line"))
    warned = lines.filter(F.col("line").contains("<table") | F.col("line").contains("<script")).withColumn("severity", F.lit("warning"))
    return gates.coverage_gaps(warned)


@query("surface_inventory", sql("select s.surface, count(distinct section) as files, count(distinct c) as containers, count(x.unit_id) as units from (values ('slides'), ('labs'), ('quiz')) as s(surface) left join (select 'labs' as surface, section, 'doc-' || doc_id as c, unit_id from src) x using (surface) group by s.surface", "src"))
def surface_inventory(spark, d):
    units = rel.source_units(spark, d).select("unit_id", F.col("section").alias("reference"))
    return gates.surface_inventory(units, list(ids.SURFACES))


@query("line_positions", sql("select doc_id, offset_, 1 + length(b) - length(replace(b, chr(10), '')) as line, length(string_split(b, chr(10))[-1]) + 1 as column_ from (select doc_id, k as offset_, substr(text, 1, k) as b from (select doc_id, text, length(text) // 2 as k from documents))"))
def line_positions(spark, d):
    docs = rel.table(spark, d, "documents").select("doc_id", "text", F.expr("length(text) div 2").alias("offset_"))
    rows = docs.select("doc_id", "offset_", tx.position_at(F.col("text"), F.col("offset_").cast("int")).alias("p"))
    return rows.select("doc_id", "offset_", F.col("p.line").alias("line"), F.col("p.column").alias("column_"))


def _holes(spark, d):
    """Lines of the documents as holes; in every tenth document each hole is two characters too long."""
    docs = rel.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.split("text", "\n").alias("l"))
    rows = docs.select("path", "doc_id", F.posexplode_outer("l").alias("i", "source"))
    return splice.with_offsets(rows, "path", "i", "source")


@query(
    "hole_overlap_check",
    sql(
        "select path, unit_id, start, prior_end from (select *, lag(end_) over (partition by path order by start, unit_id) as prior_end from h) where start < prior_end",
        "ln", more="a as (select doc_id, i, l[i + 1] as s from (select doc_id, string_split(text, chr(10)) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents)), o as (select doc_id, i, s, coalesce(sum(length(s) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from a), h as (select doc_id::varchar as path, 'labs:doc-' || doc_id || ':body/p-' || (i + 1) as unit_id, start, start + length(s) + case when doc_id % 10 = 0 then 2 else 0 end as end_ from o where s <> '')",
    ),
)
def hole_overlap_check(spark, d):
    rows = _holes(spark, d).filter("source <> ''")
    rows = rows.select("path", rel.unit_name(F.col("doc_id"), F.col("i") + 1).alias("unit_id"), "start", (F.col("end") + F.when(F.col("doc_id") % 10 == 0, 2).otherwise(0)).alias("end"))
    return splice.overlaps(rows)


_REPL = "'T:' || substr(s, 1, 5) || '!'"
_COMPOSED = "with a as (select doc_id, i, l[i + 1] as s from (select doc_id, string_split(text, chr(10)) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents)) select doc_id::varchar as path, string_agg(case when s <> '' and i % 3 = 1 then " + _REPL + " else s end, chr(10) order by i) as composed from a group by doc_id"


def _composition(spark, d, translate):
    docs = rel.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    holes = _holes(spark, d).filter("source <> ''").withColumn("unit_id", rel.unit_name(F.col("doc_id"), F.col("i") + 1))
    return splice.compose(docs, holes.select("path", "unit_id", "start", "end", "source"), translate(holes))


@query("compose_splice", _COMPOSED)
def compose_splice(spark, d):
    def some(holes):
        return holes.filter("i % 3 = 1").select("unit_id", F.concat(F.lit("T:"), F.substring("source", 1, 5), F.lit("!")).alias("text"))

    return _composition(spark, d, some)


@query("compose_empty_roundtrip", "select doc_id::varchar as path, text as composed from documents")
def compose_empty_roundtrip(spark, d):
    return _composition(spark, d, lambda holes: holes.limit(0).select("unit_id", F.col("source").alias("text")))


@query("slugify")
def slugify(spark, d):
    """Slugs of the documents; SQL has no compatibility decomposition."""
    return rel.table(spark, d, "documents").select("doc_id", tx.slugs(F.col("text")).alias("slug"))


@query("po_escape", r"""select doc_id, replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') as escaped from documents""")
def po_escape(spark, d):
    return rel.table(spark, d, "documents").select("doc_id", tx.po_escaped(F.col("text")).alias("escaped"))


def _po_sql(word: str, value: str, prefix: str) -> str:
    """A field of a PO entry; a value of two lines has each on its own."""
    text = f"replace(replace({value}, '\\', '\\\\'), '\"', '\\\"')"
    return f"""{prefix} || '{word} "' || case when contains({value}, chr(10)) then '"' || chr(10) || {prefix} || '"' || replace({text}, chr(10), '\\n"' || chr(10) || {prefix} || '"') else {text} end || '"' || chr(10)"""


_BLOCK = f"""case when u_source is null then '' else '#. {SOURCE_KEY}: ' || reference || chr(10) || '#. {HASH_KEY}: sha256:' || substr(sha256(u_source), 1, 16) || chr(10) end
    || case when flags <> '' then '#, ' || flags || chr(10) else '' end
    || coalesce({_po_sql('msgid', 'case when moved then old_msgid else prev end', "case when obsolete then '#~| ' else '#| ' end")}, '')
    || {_po_sql('msgctxt', 'unit_id', 'p')} || {_po_sql('msgid', 'msgid', 'p')} || {_po_sql('msgstr', 'msgstr', 'p')}"""
_HEADER = "'msgid \"\"' || chr(10) || 'msgstr \"\"' || chr(10) || '\"Language: de\\n\"' || chr(10) || '\"MIME-Version: 1.0\\n\"' || chr(10) || '\"Content-Type: text/plain; charset=UTF-8\\n\"' || chr(10) || '\"Content-Transfer-Encoding: 8bit\\n\"' || chr(10) || '\"X-Generator: l10n\\n\"' || chr(10)"


@query(
    "po_serialize",
    sql(
        f"select locale, path, {_HEADER} || chr(10) || string_agg({_BLOCK}, chr(10) order by obsolete, unit_id) as text from x group by locale, path",
        "ms", more="x as (select *, case when obsolete then '#~ ' else '' end as p, concat_ws(', ', nullif(flag, ''), case when moved and flag <> 'fuzzy' then 'fuzzy' end) as flags from ms)",
    ),
)
def po_serialize(spark, d):
    """The merged catalogs as PO text, one row per catalog."""
    from tessella.sources.po import serialized

    return serialized(_merged(spark, d), "l10n")


@query("po_roundtrip", sql("select locale, path, count(*) as entries, count(*) filter (obsolete) as obsolete, sum(length(msgid))::bigint as characters from ms group by locale, path", "ms"))
def po_roundtrip(spark, d):
    """Serialised and parsed again: the entries of each catalog."""
    from tessella.sources.po import parsed, serialized

    entries, _ = parsed(serialized(_merged(spark, d), "l10n"))
    rows = entries.filter("msgctxt is not null")
    return rows.groupBy("locale", "path").agg(F.count("*").alias("entries"), F.count(F.when(F.col("obsolete"), 1)).alias("obsolete"), F.sum(F.length("msgid")).alias("characters"))


@query("catalog_names", sql("select locale, path, regexp_replace(regexp_replace(path, '^[^/]*/[^/]*/', ''), '\\.po$', '') as name, count(*) as n from e group by all", "e"))
def catalog_names(spark, d):
    return rel.old_entries(spark, d).groupBy("locale", "path", merge.catalog_name(F.col("path")).alias("name")).agg(F.count("*").alias("n"))


@query("count_occurrences", "select doc_id, (length(text) - length(replace(text, 'de', ''))) // 2 as n from documents")
def count_occurrences(spark, d):
    return rel.table(spark, d, "documents").select("doc_id", tx.count_occurrences(F.col("text"), "de").alias("n"))


_HOSTILE = "case when doc_id % 3 = 0 then text || chr(8238) || lang when doc_id % 3 = 1 then chr(8203) || text else text || chr(7) end"


@query("neutralise_invisible", "select doc_id, " + "replace(" * len(tx.INVISIBLE_CODES) + _HOSTILE + "".join(f", chr({c}), '\\u{c:04x}')" for c in tx.INVISIBLE_CODES) + " as shown from documents")
def neutralise_invisible(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\u202e"), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\u200b"), "text")).otherwise(F.concat("text", F.lit("\a")))
    return rel.table(spark, d, "documents").select("doc_id", tx.neutralised(text).alias("shown"))


@query("unsafe_characters", f"select doc_id, regexp_matches({_HOSTILE}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') as unsafe from documents")
def unsafe_characters(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\u202e"), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\u200b"), "text")).otherwise(F.concat("text", F.lit("\a")))
    return rel.table(spark, d, "documents").select("doc_id", tx.has_unsafe_character(text).alias("unsafe"))


# Specified gates


@query("protected_terms", sql("select unit_id, term from src, (values ('the'), ('Licensed'), ('de')) as t(term) where contains(source, term) and not contains(replace(source, 'the', 'THE'), term)", "src"))
def protected_terms(spark, d):
    pairs = rel.source_units(spark, d).select("unit_id", "source", F.replace(F.col("source"), F.lit("the"), F.lit("THE")).alias("translation"))
    return gates.lost_terms(pairs, ["the", "Licensed", "de"])


@query("length_budget", sql("select unit_id, length(t) * 1.0 / length(source) as ratio from (select unit_id, source, source || substr(source, 1, 20) as t from src) where length(t) * 1.0 / length(source) > 1.4", "src"))
def length_budget(spark, d):
    pairs = rel.source_units(spark, d).select("unit_id", "source", F.concat("source", F.substring("source", 1, 20)).alias("translation"))
    return gates.over_budget(pairs, 1.4)


@query(
    "fence_identity",
    "select doc_id from documents where list_sort(regexp_extract_all(text, '[0-9]+')) <> list_sort(regexp_extract_all(replace(text, '1', '7'), '[0-9]+'))",
)
def fence_identity(spark, d):
    """Blocks that must survive: here the numbers of a document against those of an altered copy."""
    docs = rel.table(spark, d, "documents")
    own, other = (F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)) for t in (F.col("text"), F.replace("text", F.lit("1"), F.lit("7"))))
    return docs.filter(~gates.same_blocks(own, other)).select("doc_id")


@query(
    "seed_alignment",
    sql(
        "select s.unit_id, case when count(t.text) = 0 then 'missed' when count(t.text) > 1 then 'ambiguous' else 'matched' end as outcome, case when count(t.text) = 1 then min(t.text) end as text from src s left join t on t.container = 'labs:doc-' || s.doc_id and t.unit_key = 'body/p-' || s.n group by s.unit_id",
        "src", more="t as (select 'labs:doc-' || conv_id as container, 'body/p-' || (turn % 4 + 1) as unit_key, text from conversations)",
    ),
)
def seed_alignment(spark, d):
    units = rel.source_units(spark, d).select("unit_id", ids.container_of(F.col("unit_id")).alias("container"), F.concat(F.lit("body/p-"), F.col("n").cast("string")).alias("unit_key"))
    c = rel.table(spark, d, "conversations")
    tree = c.select(F.concat(F.lit("labs:doc-"), F.col("conv_id").cast("string")).alias("container"), F.concat(F.lit("body/p-"), (F.col("turn") % 4 + 1).cast("string")).alias("unit_key"), "text")
    return gates.seed(units, tree)


@query("override_staleness", sql("select doc_id, case when doc_id % 4 = 0 then 'stale' else 'current' end as standing from documents where doc_id % 2 = 0"))
def override_staleness(spark, d):
    docs = rel.table(spark, d, "documents")
    slides = docs.select(F.col("doc_id").cast("string").alias("container_id"), "doc_id", ids.source_hash(F.col("text")).alias("slide_hash"))
    recorded = F.when(F.col("doc_id") % 4 == 0, ids.source_hash(F.concat("text", F.lit("old")))).otherwise(ids.source_hash(F.col("text")))
    overrides = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("container_id"), recorded.alias("source_slide_hash"))
    return gates.override_standing(overrides, slides).select("doc_id", "standing")


# Locators, over files made of the tables' text


_PLAIN = "trim(regexp_replace(text, '[^{b}p{{L}}]+', ' '{g}))"


def _turns(spark, d):
    """The words of whole turns of conversations, lower-case so that nothing reads as markup."""
    c = rel.table(spark, d, "conversations").select("conv_id", "turn", F.expr(f"lower({_PLAIN.format(b=chr(92) * 2, g='')})").alias("said"))
    return c.filter("length(said) >= 3")


_TURNS = "t as (select conv_id, turn, lower(" + _PLAIN.format(b=chr(92), g=", 'g'") + ") as said from conversations), s as (select * from t where length(said) >= 3)"


def _decks(spark, d):
    slide = F.concat(F.lit("---\nslideId: c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("\ntitle: "), F.concat(F.lit('"'), F.col("said"), F.lit('"')), F.lit("\n---\n# "), "said", F.lit("\n\n- "), "said", F.lit("\n\n<!-- "), "said", F.lit(" -->\n"))
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", slide.alias("slide")))).alias("s"))
    return rows.select(F.lit("slides").alias("surface"), F.concat(F.lit("slides/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(F.transform("s", lambda x: x["slide"]), "").alias("text"), F.lit(0).alias("ord"))


@query("deck_split", f"with {_TURNS} select 'slides/' || conv_id || '.md' as path, count(*) as slides from s group by conv_id")
def deck_split(spark, d):
    found = extraction.located(_decks(spark, d))
    return found.filter("what = 'container'").groupBy("path").agg(F.count("*").alias("slides"))


@query(
    "deck_prose",
    f"with {_TURNS}, k as (select * from (values ('fm/title'), ('body/h1-1/title'), ('body/h1-1/l-1/li-1/p-1'), ('note/p-1')) as v(k)) select 'slides:c' || conv_id || '-' || turn || ':' || k as unit_id, 'slides/' || conv_id || '.md' as section, said as source, 'sha256:' || substr(sha256(said), 1, 16) as source_hash from s cross join k",
)
def deck_prose(spark, d):
    return extraction.units(extraction.located(_decks(spark, d))).select("unit_id", "section", "source", "source_hash")


def _labs(spark, d):
    turn = F.concat(F.lit("## "), "said", F.lit("\n\n"), "said", F.lit("\nand more\n\n> "), "said", F.lit("\n\n| a | b |\n|---|---|\n| "), "said", F.lit(" | `x` |\n\n```\ncode\n```\n\n"))
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("part")))).alias("s"))
    text = F.concat(F.lit("<!-- labId: lab-"), F.col("conv_id").cast("string"), F.lit(" -->\n\n"), F.array_join(F.transform("s", lambda x: x["part"]), ""))
    return rows.select(F.lit("labs").alias("surface"), F.concat(F.lit("labs/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.lit(0).alias("ord"))


@query(
    "lab_prose",
    f"""with {_TURNS}, n as (select *, row_number() over (partition by conv_id order by turn) as h from s),
    k as (select * from (values ('title', ''), ('p-1', chr(10) || 'and more'), ('bq-1/p-1', ''), ('t-1/r-1/c-1', 'a'), ('t-1/r-1/c-2', 'b'), ('t-1/r-2/c-1', '')) as v(k, x))
    select 'labs:lab-' || conv_id || ':body/h2-' || h || '/' || k as unit_id, case when x in ('a', 'b') then x else said || x end as source from n cross join k""",
)
def lab_prose(spark, d):
    return extraction.units(extraction.located(_labs(spark, d))).select("unit_id", "source")


def _banks(spark, d):
    q = F.struct(
        F.concat(F.lit("S01-Q-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.lit("s").alias("section"), F.concat("said", F.lit(' "?"\n')).alias("prompt"),
        F.array(F.struct(F.lit("a").alias("id"), F.col("said").alias("text"), F.lit("é").alias("rationale"))).alias("options"), F.lit("a").alias("answer"), F.lit("why").alias("explanation"),
        F.lit("x").alias("difficulty"), F.lit("y").alias("learningObjective"), F.array(F.lit("z")).alias("references"),
    )
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", q.alias("q")))).alias("s"))
    text = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.transform("s", lambda x: x["q"]).alias("questions")))
    return rows.select(F.lit("quiz").alias("surface"), F.concat(F.lit("quiz/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), text.alias("text"), F.lit(0).alias("ord"))


@query(
    "quiz_units",
    f"""with {_TURNS}, k as (select * from (values ('prompt'), ('explanation'), ('option/a/text'), ('option/a/rationale')) as v(k))
    select 'quiz:S01-Q-' || conv_id || '-' || turn || ':' || k as unit_id, case k when 'prompt' then said || ' "?"' || chr(10) when 'explanation' then 'why' when 'option/a/text' then said else 'é' end as source from s cross join k""",
)
def quiz_units(spark, d):
    return extraction.units(extraction.located(_banks(spark, d), "kubernetes-workshop")).select("unit_id", "source")


@query("duplicate_containers", "with x as (select distinct 'labs:c-' || conv_id as container, 'labs/' || role || '.md' as path, case role when 'system' then 0 when 'user' then 1 when 'assistant' then 2 else 3 end as ord from conversations) select container, string_agg(path, '|' order by ord, path) as paths from x group by container having count(*) > 1")
def duplicate_containers(spark, d):
    c = rel.table(spark, d, "conversations")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    rows = c.select(F.lit("container").alias("what"), F.concat(F.lit("labs:c-"), F.col("conv_id").cast("string")).alias("unit_id"), F.concat(F.lit("labs/"), "role", F.lit(".md")).alias("path"), rank.alias("ord"))
    return extraction.duplicate_containers(rows).select("container", F.array_join("paths", "|").alias("paths"))


@query("duplicate_declared_ids", "with x as (select 'id-' || (p_partkey % 50) as id, p_brand as path, p_size as line, p_partkey as ord from part) select id, string_agg(path || ':' || line, ' and ' order by ord, line) as places from x group by id having count(*) > 1")
def duplicate_declared_ids(spark, d):
    p = rel.table(spark, d, "part")
    rows = p.select(F.concat(F.lit("id-"), (F.col("p_partkey") % 50).cast("string")).alias("id"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("ord"))
    return extraction.duplicate_ids(rows)


# Markup of every kind around whole turns, with what it must give


def _said(template: str, **more) -> Column:
    """A text with ``{s}`` for what was said and other names for the columns given."""
    parts: list[Column] = []
    for n, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if piece:
            parts.append((more.get(piece) if n % 2 else None) if n % 2 and piece != "s" else F.col("said") if n % 2 else F.lit(piece))
    return F.concat(*parts)


_SLIDE = """---
slideId: {id}
layout: two
heading: x {s}
title: "{s} \\"x\\""
---
# {s}

```js
const x = 1 // {s}
---
```

> {s}
>
> - {s}
>   more

1. {s}
   - {s}

<div class="x">{s}</div>

~~~~
{s}
~~~~

Text with `code`, **{s}** &amp; <b>tag</b>.

<!-- {s}

second -->
"""
_AMISS = {0: "---\ntitle: no id\n---\n# {s}\n", 1: "---\nslideId: bad/{id}\n---\n{s}\n", 2: "---\nslideId: {id}\n---\n{s}\n", 3: ""}


def _marked_decks(spark, d):
    """A deck of a conversation: a slide for each turn, and one that is amiss. Every other deck has CRLF line ends."""
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    amiss = F.lit("")
    for k, text in _AMISS.items():
        amiss = F.when(F.col("turn") % 4 == k, _said(text, id=name) if text else F.lit("")).otherwise(amiss)
    rows = _turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(_said(_SLIDE, id=name), amiss).alias("slide")))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["slide"]), "")
    text = F.when(F.col("conv_id") % 2 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return rows.select(F.lit("slides").alias("surface"), F.concat(F.lit("slides/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.lit(0).alias("ord"))


@query(
    "deck_markup",
    f"""with {_TURNS}, k as (select conv_id, turn, unnest([('fm/heading', 'x ' || said), ('fm/title', said || ' "x"'), ('body/h1-1/title', said), ('body/h1-1/bq-1/p-1', said), ('body/h1-1/bq-1/l-1/li-1/p-1', said || chr(10) || 'more'),
      ('body/h1-1/l-1/li-1/p-1', said), ('body/h1-1/l-1/li-1/l-1/li-1/p-1', said), ('body/h1-1/p-1', 'Text with `code`, **' || said || '** &amp; <b>tag</b>.'), ('note/p-1', said), ('note/p-2', 'second')]) as u from s)
    select 'slides:c' || conv_id || '-' || turn || ':' || u[1] as unit_id, u[2] as source from k""",
)
def deck_markup(spark, d):
    return extraction.units(extraction.located(_marked_decks(spark, d))).select("unit_id", "source")


@query(
    "deck_diagnostics",
    f"""with {_TURNS}, x as (select conv_id, unnest(list_filter([('prose-in-html-block', 'warning'), case turn % 4 when 0 then ('missing-slide-id', 'error') when 1 then ('unsafe-slide-id', 'error') when 2 then ('duplicate-slide-id', 'error') end], lambda v: v is not null)) as c from s)
    select 'slides/' || conv_id || '.md' as path, c[1] as code, c[2] as severity, count(*) as n from x group by all""",
)
def deck_diagnostics(spark, d):
    return extraction.located(_marked_decks(spark, d)).filter("what = 'diagnostic'").groupBy("path", "code", "severity").agg(F.count("*").alias("n"))


_LAB = """# {s}

<!-- labId: {id} -->

{s}[^n] and more

> {s}
>
> > {s}

- {s}

  {s}
  1. {s}

<details>
<summary>{s}</summary>

{s}

</details>

    indented {s}

| a | {s} |
|---|:-:|
| {s} | `x` |

[^n]: {s}

Setext {s}
==========

***

```sh
{s}
```
"""


def _marked_labs(spark, d):
    name = F.concat(F.lit("lab-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    text = _said(_LAB, id=name)
    text = F.when(F.col("turn") % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return _turns(spark, d).select(F.lit("labs").alias("surface"), F.concat(F.lit("labs/"), name, F.lit(".md")).alias("path"), text.alias("text"), F.lit(0).alias("ord"))


@query(
    "lab_markup",
    f"""with {_TURNS}, k as (select conv_id, turn, unnest([('h1-1/title', said), ('h1-1/p-1', said || '[^n] and more'), ('h1-1/bq-1/p-1', said), ('h1-1/bq-1/bq-1/p-1', said), ('h1-1/l-1/li-1/p-1', said), ('h1-1/l-1/li-1/p-2', said), ('h1-1/l-1/li-1/l-1/li-1/p-1', said),
      ('h1-1/html-2/summary-1', said), ('h1-1/p-2', said), ('h1-1/t-1/r-1/c-1', 'a'), ('h1-1/t-1/r-1/c-2', said), ('h1-1/t-1/r-2/c-1', said), ('h1-1/fn-n/p-1', said), ('h1-2/title', 'Setext ' || said)]) as u from s)
    select 'labs:lab-' || conv_id || '-' || turn || ':body/' || u[1] as unit_id, u[2] as source from k""",
)
def lab_markup(spark, d):
    return extraction.units(extraction.located(_marked_labs(spark, d))).select("unit_id", "source")


@query("compose_markup", f"with {_TURNS} select 'labs/lab-' || conv_id || '-' || turn || '.md' as path, 15 as found, length(said) as said from s")
def compose_markup(spark, d):
    """Labs with every translation two words longer: the words are there for each unit, and the rest of the file is as it was."""
    files = _marked_labs(spark, d)
    units = extraction.units(extraction.located(files))
    rows = composition.composed(files, units, units.select("unit_id", F.concat("source", F.lit(" und mehr")).alias("said")))
    back = F.replace(F.col("text"), F.lit(" und mehr"), F.lit(""))
    both = rows.join(files.select("path", F.col("text").alias("was")), "path").filter(back == F.col("was"))
    words = F.split(F.regexp_replace("text", "\r", ""), " und mehr", -1)
    return both.select("path", F.size(words).alias("found"), F.length(F.regexp_extract("was", "^# ([^\r\n]*)", 1)).alias("said"))


_HEAD = 'msgid ""\nmsgstr "Language: de\\n"\n\n'
_PO = _HEAD + r"""# by hand
#. key: value
#: labs/a.md
#, fuzzy, c-format
#| msgid "old\tone"
msgctxt "labs:a:b"
msgid ""
"{s} "
"tail\tX \\ \"q\" \303\251 \x41"
msgstr "{t}\n"

#~ msgctxt "labs:a:c"
#~ msgid "gone {s}"
#~ msgstr ""
"""
_BROKEN = {
    0: 'msgctxt "a"\nmsgid "open\nmsgstr "x"\n', 1: 'msgctxt "a"\nmsgid "x\\q"\nmsgstr "x"\n', 2: 'msgctxt "a"\nmsgid "x"\nmsgid "y"\nmsgstr "x"\n', 3: 'msgctxt "a"\nmsgid "x\\777"\nmsgstr "x"\n', 4: 'msgctxt "a"\nmsgid "x"\n\nnonsense\n',
}


@query(
    "po_read",
    f"""with {_TURNS}, k as (select conv_id, turn, unnest([('labs:a:b', said || ' tail' || chr(9) || 'X \\ "q" é A', 'T' || turn || chr(10), 'fuzzy,c-format', 'old' || chr(9) || 'one', 'n'), ('labs:a:c', 'gone ' || said, '', '', null, 'y')]) as u from s)
    select 'i18n/de/' || conv_id || '-' || turn || '.po' as path, u[1] as msgctxt, u[2] as msgid, u[3] as msgstr, u[4] as flags, u[5] as previous, u[6] = 'y' as obsolete from k""",
)
def po_read(spark, d):
    """Catalogs with comments, flags, an older English, strings in pieces, escapes of every kind and an obsolete entry."""
    from tessella.sources.po import parsed

    path = F.concat(F.lit("i18n/de/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".po"))
    files = _turns(spark, d).select(F.lit("de").alias("locale"), path.alias("path"), _said(_PO, t=F.concat(F.lit("T"), F.col("turn").cast("string"))).alias("text"))
    rows, _ = parsed(files)
    return rows.filter("msgctxt is not null").select("path", "msgctxt", "msgid", F.get("msgstr", 0).alias("msgstr"), F.array_join("flags", ",").alias("flags"), F.col("previous.msgid").alias("previous"), "obsolete")


@query("po_malformed", "select 'i18n/de/' || conv_id || '-' || turn || '.po' as path, case turn % 5 when 2 then 6 when 4 then 4 else 5 end as line from conversations")
def po_malformed(spark, d):
    """Catalogs with one mistake each, and the line that it is said of."""
    from tessella.sources.po import parsed

    text = F.lit("")
    for k, broken in _BROKEN.items():
        text = F.when(F.col("turn") % 5 == k, F.lit(_HEAD + broken)).otherwise(text)
    path = F.concat(F.lit("i18n/de/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".po"))
    _, errors = parsed(rel.table(spark, d, "conversations").select(F.lit("de").alias("locale"), path.alias("path"), text.alias("text")))
    return errors.select("path", "line")


# A locale's tree, its gates and its seed, over the same files


@query(
    "compose_tree",
    f"""with {_TURNS}, n as (select *, row_number() over (partition by conv_id order by turn) as h from s),
    p as (select conv_id, turn, '## ' || case when turn % 2 = 0 then 'T ' || said else '[EN] ' || said end || chr(10) || chr(10) || '[EN] ' || said || chr(10) || 'and more' || chr(10) || chr(10)
      || '> ' || case when turn % 3 = 0 then 'T ' || said || chr(10) || 'zwei' else '[EN] ' || said end || chr(10) || chr(10)
      || '| [EN] a | [EN] b |' || chr(10) || '|---|---|' || chr(10) || '| [EN] ' || said || ' | `x` |' || chr(10) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || chr(10) as part from n)
    select 'labs/' || conv_id || '.md' as path, '<!-- labId: lab-' || conv_id || ' -->' || chr(10) || chr(10) || string_agg(part, '' order by turn) || chr(10) || '<!-- generated by l10n; do not edit -->' || chr(10) as text, 0 as issues from p group by conv_id""",
)
def compose_tree(spark, d):
    """The labs in a locale: titles of even turns and quotes of every third are translated, the rest is marked English."""
    files = _labs(spark, d)
    units = extraction.units(extraction.located(files))
    key, source = F.regexp_extract("unit_id", "[^/]+(/p-1)?$", 0), F.col("source")
    heading = F.regexp_extract("unit_id", "body/h2-([0-9]+)/", 1).cast("long")
    turns = _turns(spark, d).select(F.concat(F.lit("labs:lab-"), F.col("conv_id").cast("string")).alias("container"), "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("h"))
    named = units.withColumn("container", ids.container_of(F.col("unit_id"))).withColumn("h", heading).join(turns, ["container", "h"])
    text = F.when((key == "title") & (F.col("turn") % 2 == 0), F.concat(F.lit("T "), source)).when((key == "bq-1/p-1") & (F.col("turn") % 3 == 0), F.concat(F.lit("T "), source, F.lit("\nzwei")))
    entries = named.select("unit_id", source.alias("msgid"), text.alias("text"), F.when(text.isNull(), "missing").when(F.col("turn") % 4 == 0, "needs-review").otherwise("reviewed").alias("state"))
    rows = composition.composed(files, units, composition.spoken(entries), generator="l10n")
    return rows.select("path", "text", F.size("issues").alias("issues"))


@query(
    "compose_overrides",
    f"""with {_TURNS} select 'slides/' || conv_id || '.md' as path, '---' || chr(10) || '# generated by l10n; do not edit' || chr(10) || substr(string_agg(
      case when turn % 2 = 0 then '---' || chr(10) || 'slideId: c' || conv_id || '-' || turn || chr(10) || 'layout: wide' || chr(10) || '---' || chr(10) || '# Neu ' || said || chr(10) || '---' || chr(10) || 'slideId: c' || conv_id || '-' || turn || '-2' || chr(10) || '---' || chr(10) || 'Teil zwei' || chr(10)
      else '---' || chr(10) || 'slideId: c' || conv_id || '-' || turn || chr(10) || 'title: "' || said || '"' || chr(10) || '---' || chr(10) || '# ' || said || chr(10) || chr(10) || '- ' || said || chr(10) || chr(10) || '<!-- ' || said || ' -->' || chr(10) end, '' order by turn), 5) as text
    from s group by conv_id""",
)
def compose_overrides(spark, d):
    """The decks with each slide of an even turn replaced by two."""
    files, units = _decks(spark, d), extraction.units(extraction.located(_decks(spark, d)))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    text = F.concat(F.lit("---\nsourceSlideHash: sha256:0123456789abcdef\nlayout: wide\n---\n# Neu "), "said", F.lit("\n---\n\nTeil zwei\n"))
    overrides = composition.read_overrides(_turns(spark, d).filter("turn % 2 = 0").select(name.alias("slide_id"), name.alias("path"), text.alias("text")))
    return composition.composed(files, units, units.limit(0).select("unit_id", F.col("source").alias("said")), overrides, generator="l10n").select("path", F.regexp_replace("text", "---\n\nTeil", "---\nTeil").alias("text"))


_VERIFY_PAIRS = "v as (select 'de' as locale, 'slides:c' || conv_id || '-' || turn || ':p-1' as unit_id, text as source, case when turn % 3 = 0 then upper(text) when turn % 3 = 1 then text || text else text end as translation, case when turn % 2 = 0 then 'wide' when turn % 5 = 0 then 'tight' end as layout from conversations)"


@query(
    "verify_gates",
    f"""with {_VERIFY_PAIRS}, r as (select *, length(translation) / length(source) as ratio, case when layout = 'tight' then 1.2 else 1.4 end as allowed from v where length(source) > 0)
    select locale, unit_id as id, 'length-budget' as gate, printf('%.2f', ratio::double) as detail from r where ratio > allowed
    union all select locale, unit_id, 'protected-term', term from v, (values ('the'), ('de')) as t(term) where contains(source, term) and not contains(translation, term)
    union all select locale, unit_id, 'uncovered', layout from v where layout = 'wide'""",
)
def verify_gates(spark, d):
    c = rel.table(spark, d, "conversations")
    name = F.concat(F.lit("slides:c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(":p-1"))
    said = F.when(F.col("turn") % 3 == 0, F.upper("text")).when(F.col("turn") % 3 == 1, F.concat("text", "text")).otherwise(F.col("text"))
    layout = F.when(F.col("turn") % 2 == 0, "wide").when(F.col("turn") % 5 == 0, "tight")
    pairs = c.select(F.lit("de").alias("locale"), name.alias("unit_id"), F.col("text").alias("source"), said.alias("translation"), layout.alias("layout"))
    return composition.verified(pairs, ["the", "de"], 1.4, {"tight": 1.2})


@query(
    "override_fences",
    f"""with {_TURNS} select 'de' as locale, 'c' || conv_id || '-' || turn as id, g.gate, case when g.gate = 'override' then 'stale' else '```' || chr(10) || 'run ' || said || chr(10) || '``` | ```' || chr(10) || 'run other' || chr(10) || '```' end as detail
    from s, (values ('fence-identity'), ('override')) as g(gate) where turn % 2 = 1 and (g.gate = 'override' or turn % 3 = 0)""",
)
def override_fences(spark, d):
    """Overrides of slides with a fenced command: some with another command, all for an older version of the slide."""
    t = _turns(spark, d).filter("turn % 2 = 1")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    deck = F.concat(F.lit("---\nslideId: "), name, F.lit("\n---\n```\nrun "), "said", F.lit("\n```\n"))
    files = t.select(F.lit("slides").alias("surface"), F.concat(name, F.lit(".md")).alias("path"), deck.alias("text"))
    own = F.concat(F.lit("---\nsourceSlideHash: sha256:0123456789abcdef\n---\nNeu\n```\nrun "), F.when(F.col("turn") % 3 == 0, "other").otherwise(F.col("said")), F.lit("\n```\n"))
    overrides = composition.read_overrides(t.select(name.alias("slide_id"), name.alias("path"), own.alias("text")))
    return composition.verified_overrides("de", overrides, composition.slides(files), [])


@query(
    "seed_tree",
    """with t as (select conv_id, turn, text, conv_id % 4 as k from conversations),
    u as (select 'labs:c' || conv_id as container, 'body/p-' || turn as unit_key from t),
    o as (select 'labs:c' || conv_id as container, 'body/p-' || case when k = 3 then turn + 1 else turn end as unit_key, text, case when k = 1 then turn % 2 else 9 end as f from t where k <> 2),
    oo as (select container, string_agg(unit_key, ',' order by unit_key) as theirs, count(distinct f) as files from o group by container), uu as (select container, string_agg(unit_key, ',' order by unit_key) as ours from u group by container)
    select container || ':' || unit_key as unit_id, case when files > 1 then 'ambiguous' when ours = theirs then 'matched' else 'missed' end as outcome, case when files = 1 and ours = theirs then o.text end as text
    from u join uu using (container) left join oo using (container) left join o using (container, unit_key)""",
)
def seed_tree(spark, d):
    """Containers that a translated tree has alike, in two files, not at all, or with another structure."""
    c = rel.table(spark, d, "conversations")
    container = F.concat(F.lit("labs:c"), F.col("conv_id").cast("string"))
    key = lambda n: F.concat(F.lit("body/p-"), n.cast("string"))
    units = c.select(F.concat(container, F.lit(":"), key(F.col("turn"))).alias("unit_id"), container.alias("container"), key(F.col("turn")).alias("unit_key"), F.lit("s").alias("section"))
    path = F.when(F.col("conv_id") % 4 == 1, key(F.col("turn") % 2)).otherwise(F.lit("one"))
    other = key(F.when(F.col("conv_id") % 4 == 3, F.col("turn") + 1).otherwise(F.col("turn")))
    tree = c.filter("conv_id % 4 <> 2").select(container.alias("container"), path.alias("path"), other.alias("unit_key"), "text")
    return composition.seeded(units, tree).select("unit_id", "outcome", "text")
