import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tessella.functions.identity import source_hash
from tessella.functions.register import register
from tessella.operators import merge
from tessella.operators.merge import ENTRY
from tessella.sources.exchange import MemoryPort, xliff

ROWS = [
    ("de", "i18n/de/a.po", "labs:a:b", False, [], [], None, 'x < "y" & z\n', ["ü"], "reviewed"),
    ("de", "i18n/de/a.po", "labs:a:c", False, [], [], None, "open\x01", [""], "missing"),
    ("de", "i18n/de/a.po", "labs:a:d", True, [], [], None, "gone", ["weg"], "reviewed"),
]


def entries(spark):
    return spark.createDataFrame(ROWS, f"locale string, path string, unit_id string, obsolete boolean, {ENTRY}, state string")


def test_xliff_is_well_formed_and_complete(spark):
    (row,) = xliff(entries(spark), "en").collect()
    root = ET.fromstring(row.text.encode())
    ns = {"x": "urn:oasis:names:tc:xliff:document:2.0"}
    units = root.findall(".//x:unit", ns)
    assert [u.get("name") for u in units] == ["labs:a:b", "labs:a:c"]
    assert [u.find(".//x:source", ns).text for u in units] == ['x < "y" & z\n', "open�"]
    assert [(t.text if (t := u.find(".//x:target", ns)) is not None else None) for u in units] == ["ü", None]
    assert (root.get("srcLang"), root.get("trgLang")) == ("en", "de")


def test_port_brings_drafts_that_never_replace_work(spark):
    port = MemoryPort(lambda source: F.concat(F.lit("draft "), source))
    units = entries(spark).select("locale", "unit_id", F.col("msgid").alias("source"), source_hash(F.col("msgid")).alias("source_hash"))
    port.push(units)
    port.push(units.limit(1).withColumn("source", F.lit("new")))
    assert port.pull("de").count() == 3 and port.pull("fr").count() == 0
    done, refused = merge.with_drafts(entries(spark), port.pull("de"))
    assert {r.unit_id: (list(r.msgstr), list(r.flags)) for r in done.collect()} == {"labs:a:b": (["ü"], []), "labs:a:c": (["draft open\x01"], ["needs-review"])}
    assert {r.unit_id: r.reason for r in refused.collect()} == {"labs:a:b": "human-work", "labs:a:d": "no-entry"}


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql("select source_hash('A Pod is a group of containers.') h, slugify('Über 1') s, unit_state(array('x'), array('fuzzy')) u, container_of(unit_id('labs', 'a', 'b:c')) c, strip_tags('a<b>c') t").first()
    assert tuple(row) == ("sha256:f3f9df29a26f57fd", "uber-1", "fuzzy", "labs:a", "ac")
    rows = spark.sql("select unit_id, source from locate_units('labs', '<!-- labId: l -->\\n\\nText.\\n', '')").collect()
    assert [tuple(r) for r in rows] == [("labs:l:body/p-1", "Text.")]
