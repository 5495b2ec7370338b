import pytest

from tessella.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, same):
    same(QUERIES[name](spark, sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_code_unit_order_differs_from_code_points(spark):
    from pyspark.sql import functions as F

    from tessella.functions.identity import code_unit_key

    rows = spark.createDataFrame([("\U0001f600",), ("～",)], "c string")
    assert [r.c for r in rows.orderBy(code_unit_key(F.col("c"))).collect()] == ["\U0001f600", "～"]


def test_tally_of_nothing_is_zero(spark):
    from tessella.operators import policy

    rows = policy.tally(spark.createDataFrame([], "locale string, unit_id string, section string, state string")).collect()
    assert [(r.level, r.total, r.missing) for r in rows] == [("total", 0, 0)]


def test_policies_are_checked():
    from tessella.operators import policy

    for bad in ({"lost": 0}, {"missing": -1}, {"missing": 1.5}, {"missing": True}):
        with pytest.raises(ValueError):
            policy.Policy("p", bad)
    with pytest.raises(ValueError):
        policy.resolve_policy("strict")
    with pytest.raises(ValueError):
        policy.resolve_policy(policy.Policy("release", {"missing": 9}))
    assert policy.resolve_policy("preview").max_required == {}


def test_statuses_are_checked(spark):
    from tessella.operators import policy

    twice = spark.createDataFrame([("de", "labs:a:b", "x", "missing"), ("de", "labs:a:b", "y", "missing")], "locale string, unit_id string, section string, state string")
    with pytest.raises(policy.DuplicateUnitError, match="'x' and 'y'"):
        policy.assert_statuses(twice)
    odd = spark.createDataFrame([("de", "labs:a:b", "x", "done")], "locale string, unit_id string, section string, state string")
    with pytest.raises(policy.UnknownUnitStateError):
        policy.assert_statuses(odd)


def test_slug():
    from tessella.functions.text import slug

    assert slug("Café – Ünïcode ①!") == "cafe-unicode-1"
    assert slug("---") == ""


def test_strip_tags_is_linear_on_unclosed_signs(spark):
    from pyspark.sql import functions as F

    from tessella.functions.text import strip_tags

    rows = spark.createDataFrame([("<" * 100_000,), ("a<b>c<d",), ("",)], "t string").select(strip_tags(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["<" * 100_000, "ac<d", ""]


def test_slugs_and_order_take_whole_texts(spark, sf_dir):
    from tessella.functions.text import slug

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.slug for r in QUERIES["slugify"](spark, sf_dir).collect()} == {i: None if t is None else slug(t) for i, t in texts.items()}
    order = [r.head for r in QUERIES["code_unit_order"](spark, sf_dir).collect() if r.head is not None]
    assert order == sorted({t for t in texts.values() if t is not None}, key=lambda t: t.encode("utf-16-be"))
