import json

import pytest

from tessella import cli
from tessella.plans import commands
from tessella.sources import po
from tests.test_locators import BANK
from tests.test_workspace import tree

DECK = "---\nslideId: one\n---\n# Head\n\nA Pod runs.\n\n---\nslideId: two\n---\nMore text.\n"
FILES = {"slides/s.md": DECK, "labs/l.md": "# Lab\n\n<!-- labId: l -->\n\nDo this.\n", "quiz/q.json": json.dumps(BANK)}


@pytest.fixture
def run(spark, tmp_path):
    root = tree(tmp_path, FILES)

    def call(*args):
        said, errors = [], []
        code = cli.main([*args, "--root", str(root)], spark, said.append, errors.append)
        return code, "\n".join(said), "\n".join(errors)

    call.root = root
    return call


def edit(path, old, new):
    text = path.read_text("utf-8")
    assert old in text
    path.write_text(text.replace(old, new), "utf-8")


def test_extract_is_a_fixed_point_and_keeps_work(run):
    code, said, _ = run("extract", "--check")
    assert code == 1 and "6 catalogs out of date" in said
    assert not (run.root / "i18n").exists()
    code, said, _ = run("extract")
    assert code == 0
    assert "extract de: 0 fuzzy, 9 added, 0 obsoleted, 0 resurrected, 0 unchanged; 3 catalogs, 3 written, 0 removed" in said
    assert run("extract", "--check")[0] == 0
    catalog = run.root / "i18n/de/slides/s.po"
    text = catalog.read_text()
    assert "#. acme-source: slides/s.md\n" in text and '"X-Generator: acme\\n"' in text
    edit(catalog, 'msgid "A Pod runs."\nmsgstr ""', 'msgid "A Pod runs."\nmsgstr "Ein Pod läuft."')
    edit(catalog, 'msgid "More text."\nmsgstr ""', 'msgid "More text."\nmsgstr "Mehr."')
    edit(run.root / "slides/s.md", "A Pod runs.", "A Pod runs fast.")
    edit(run.root / "slides/s.md", "slideId: two", "slideId: three")
    code, said, _ = run("extract")
    assert "extract de: 1 fuzzy, 1 added, 1 obsoleted, 0 resurrected, 7 unchanged" in said
    text = catalog.read_text()
    assert '#, fuzzy\n#| msgid "A Pod runs."\n' in text and '#~ msgid "More text."\n#~ msgstr "Mehr."' in text
    edit(run.root / "slides/s.md", "slideId: three", "slideId: two")
    assert "1 obsoleted, 1 resurrected" in run("extract")[1]
    assert 'msgid "More text."\nmsgstr "Mehr."' in catalog.read_text()


def test_units_keep_their_work_when_files_move_and_headers_follow(run):
    run("extract")
    old = run.root / "i18n/de/labs/l.po"
    edit(old, '"MIME-Version: 1.0\\n"', '"MIME-Version: 1.0\\n"\n"X-Own: kept\\n"')
    edit(old, 'msgid "Do this."\nmsgstr ""', 'msgid "Do this."\nmsgstr "Mach."')
    (run.root / "labs/l.md").rename(run.root / "labs/new.md")
    code, said, _ = run("extract")
    assert code == 0 and not old.exists()
    text = (run.root / "i18n/de/labs/new.po").read_text()
    assert "X-Own: kept" in text and 'msgstr "Mach."' in text


def test_rekeyed_containers_are_reported(run):
    run("extract")
    edit(run.root / "labs/l.md", "Do this.", "New first.\n\nDo this.")
    _, said, _ = run("extract")
    assert "re-keyed labs:l (1 added, 1 fuzzy, 0 obsoleted)" in said
    assert "labs:l:body/h1-1/p-2 has the English that labs:l:body/h1-1/p-1 had" in said


def test_status(run):
    code, said, errors = run("status")
    assert code == 0 and "out of date" in errors and "total  18 units in 2 locales: missing 18, fuzzy 0, needs-review 0, reviewed 0" in said
    run("extract")
    catalog = run.root / "i18n/de/quiz/q.po"
    edit(catalog, 'msgid "t"\nmsgstr ""', 'msgid "t"\nmsgstr "T"')
    code, said, _ = run("status", "--json", "--policy", "release", "--locale", "de")
    told = json.loads(said)
    assert code == 1 and list(told) == ["schemaVersion", "sourceLocale", "catalogsCurrent", "total", "totals", "coverageGaps", "locales", "policy"]
    assert told["totals"] == {"missing": 8, "fuzzy": 0, "needs-review": 0, "reviewed": 1} and told["policy"]["violations"][0]["count"] == 8
    assert run("status", "--policy", "preview")[0] == 0
    assert run("status", "--policy", "lax")[0] == 64 and run("status", "--locale", "fr")[0] == 64 and run("nonsense")[0] == 64


def test_errors_stop_everything(run):
    edit(run.root / "labs/l.md", "labId: l", "labId: ../l")
    edit(run.root / "slides/s.md", "slideId: two", "slideId: one")
    code, _, errors = run("extract")
    assert code == 65 and "2 errors" in errors and "duplicate-slide-id" in errors and not (run.root / "i18n").exists()


def test_broken_catalogs_stop_everything(run):
    run("extract")
    catalog = run.root / "i18n/de/slides/s.po"
    before = catalog.read_text()
    for text in (before + '\nmsgctxt "labs:l:body/h1-1/title"\nmsgid "x"\nmsgstr ""\n', before + '\nmsgid "x"\nmsgstr ""\n', before + '\nmsgctxt "a:b"\nmsgid "x"\nmsgstr ""\n', before + "\nmsgid x\n"):
        catalog.write_text(text)
        assert run("extract")[0] == 65
        assert catalog.read_text() == text


def test_init_ids(run):
    edit(run.root / "slides/s.md", "---\nslideId: two\n---\n", "---\n\n")
    edit(run.root / "labs/l.md", "<!-- labId: l -->\n\n", "")
    assert run("init-ids", "--check")[0] == 1
    code, said, _ = run("init-ids")
    assert code == 0 and "init-ids slides: 1 file, 2 slides, 1 id added" in said and "labs: 1 file, 1 lab, 1 id added" in said
    assert run("init-ids", "--check")[0] == 0
    (run.root / "labs/m.md").write_text((run.root / "labs/l.md").read_text())
    code, _, errors = run("init-ids", "--check")
    assert code == 1 and 'labs/l.md:3 and labs/m.md:3 share the labId "l" [duplicate-lab-id]' in errors


def test_compose_and_verify(run, spark):
    run("extract")
    edit(run.root / "i18n/de/slides/s.po", 'msgid "A Pod runs."\nmsgstr ""', 'msgid "A Pod runs."\nmsgstr "Ein Behälter läuft heute sehr schnell."')
    out = commands.compose_locale(spark, str(run.root), "de")
    assert "Ein Behälter läuft" in out["slides/s.md"] and out["labs/l.md"] == FILES["labs/l.md"] and json.loads(out["quiz/q.json"]) == BANK
    assert "§More text." in commands.compose_locale(spark, str(run.root), "de", watermark="§")["slides/s.md"]
    code, said, errors = run("verify")
    assert code == 1 and said == "verify: 2 findings" and "protected-term: Pod" in errors and "length-budget: 3.45" in errors


def test_compose_writes_a_tree_that_says_it_is_generated(run):
    run("extract")
    edit(run.root / "i18n/de/slides/s.po", 'msgid "More text."\nmsgstr ""', 'msgid "More text."\nmsgstr "Mehr Text."')
    code, said, _ = run("compose", "--locale", "de")
    assert code == 0 and said == "compose de: 3 files in dist/de"
    deck = (run.root / "dist/de/slides/s.md").read_text()
    assert deck.startswith("---\n# generated by acme; do not edit\nslideId: one\n") and "Mehr Text." in deck and "[EN] A Pod runs." in deck
    lab, bank = (run.root / "dist/de/labs/l.md").read_text(), json.loads((run.root / "dist/de/quiz/q.json").read_text())
    assert lab.endswith("<!-- generated by acme; do not edit -->\n") and "[EN] Do this." in lab and bank["$comment"].startswith("generated")
    before = deck
    assert run("compose", "--locale", "de")[0] == 0 and (run.root / "dist/de/slides/s.md").read_text() == before
    code, _, errors = run("compose", "--locale", "de", "--strict")
    assert code == 1 and "slides:one:body/p-1: missing" in errors or "missing" in errors
    assert run("compose", "--locale", "xx")[0] == 64


def test_overrides(run):
    from tessella.locators.overrides import slides_of

    run("extract")
    english = slides_of(DECK)[0]
    folder = run.root / "i18n/de/overrides"
    folder.mkdir(parents=True)
    from tessella.locators.overrides import source_hash

    (folder / "one.md").write_text(f"---\nsourceSlideHash: {source_hash(english.text)}\n---\n# Kopf\n\nEin Pod.\n---\n\nTeil zwei\n")
    assert run("compose", "--locale", "de")[0] == 0
    deck = (run.root / "dist/de/slides/s.md").read_text()
    assert [s.slide_id for s in slides_of(deck)] == ["one", "one-2", "two"] and "Ein Pod." in deck and "A Pod runs." not in deck
    assert "de overrides: 1 of 2 slides (50.0 %)" in run("status")[1] and json.loads(run("status", "--json")[1])["overrides"][0]["notCurrent"] == []
    edit(run.root / "slides/s.md", "A Pod runs.", "A Pod runs.\n\n```\nkubectl get pods\n```")
    run("extract")
    assert "  one: stale" in run("status")[1]
    code, _, errors = run("verify")
    assert code == 1 and "fence-identity" in errors and "override: stale" in errors
    assert "stale override" in run("compose", "--locale", "de", "--strict")[2]
    code, _, errors = run("compose", "--locale", "de")
    assert code == 0 and "another version" in errors and "A Pod runs." in (run.root / "dist/de/slides/s.md").read_text()
    (folder / "none.md").write_text("---\nsourceSlideHash: sha256:0123456789abcdef\n---\nx\n")
    code, _, errors = run("compose", "--locale", "de")
    assert code == 65 and "none.md: orphaned" in errors


def test_seed(run, tmp_path):
    run("extract")
    other = tmp_path / "other"
    for path, text in (("slides/s.md", DECK.replace("Head", "Kopf").replace("A Pod runs.", "Ein Pod läuft.").replace("More text.", "Mehr.")), ("labs/l.md", "# Labor\n\n<!-- labId: l -->\n\nTu dies.\n\nUnd das.\n")):
        (other / path).parent.mkdir(parents=True, exist_ok=True)
        (other / path).write_text(text)
    edit(run.root / "i18n/de/slides/s.po", 'msgid "More text."\nmsgstr ""', 'msgid "More text."\nmsgstr "Von Hand."')
    code, said, _ = run("seed", "--from", str(other), "--locale", "de", "--json")
    told = json.loads(said)
    assert code == 0 and told["total"]["matched"] == 3 and told["total"]["missed"] == 6 and told["refused"] == {"human-work": 1}
    text = (run.root / "i18n/de/slides/s.po").read_text()
    assert '#, needs-review\nmsgctxt "slides:one' in text and 'msgstr "Ein Pod läuft."' in text and 'msgstr "Von Hand."' in text and "Mehr." not in text
    assert run("extract", "--check")[0] == 0 and 'msgstr "Labor"' not in (run.root / "i18n/de/labs/l.po").read_text()


def test_streaming_merge(spark, tmp_path):
    from tessella.streaming.incremental import UNITS, current, merge_stream, publish, versions

    folder, table = str(tmp_path / "in"), str(tmp_path / "table")

    def run_all():
        merge_stream(spark, folder, table, str(tmp_path / "cp"), "s", "h").awaitTermination(240)
        return {(r.locale, r.unit_id): (r.outcome, r.msgid, r.obsolete) for r in current(spark, table).collect()}

    def snapshot(n, rows):  # of several files, which are one snapshot
        publish(spark.createDataFrame(rows, UNITS).repartition(3), folder, f"s{n}")
        assert len(list((tmp_path / "in/data" / f"s{n}").glob("part-*.parquet"))) > 1

    snapshot(1, [("de", "p", "labs:a:x", "one", "f"), ("de", "p", "labs:a:y", "two", "f"), ("pt-BR", "p", "labs:a:x", "one", "f")])
    first = {("de", "labs:a:x"): ("added", "one", False), ("de", "labs:a:y"): ("added", "two", False), ("pt-BR", "labs:a:x"): ("added", "one", False)}
    assert run_all() == first
    snapshot(2, [("de", "p", "labs:a:x", "one!", "f"), ("de", "p", "labs:a:z", "three", "f")])
    after = {("de", "labs:a:x"): ("fuzzied", "one!", False), ("de", "labs:a:y"): ("obsoleted", "two", True), ("de", "labs:a:z"): ("added", "three", False)}
    assert run_all() == after | {("pt-BR", "labs:a:x"): ("added", "one", False)}
    snapshot(3, [("de", "p", "labs:a:x", "one!", "f"), ("de", "p", "labs:a:z", "three", "f")])
    run_all()
    assert {k: len(v) for k, v in versions(spark, table).items()} == {"de": 2, "pt-BR": 1}
    assert po.parse(po.serialize([po.default_header("de", "x")]))


def test_merge_refuses_a_unit_that_is_there_twice(spark):
    from tessella.operators import merge

    units = spark.createDataFrame([("de", "p", "labs:a:x", "one", "f"), ("de", "q", "labs:a:x", "two", "f")], "locale string, path string, unit_id string, source string, reference string")
    entries = spark.createDataFrame([], f"locale string, path string, unit_id string, obsolete boolean, {merge.ENTRY}")
    with pytest.raises(merge.DuplicateUnitError, match="labs:a:x"):
        merge.assert_batch(units)
    with pytest.raises(Exception, match="in the batch twice"):
        merge.merged(units, entries, "s", "h").collect()


def test_unseen_characters_are_shown():
    from tessella.functions.text import described, shown_name

    assert shown_name("a\u202eb\x01é") == "a\\u202eb\\u0001é" and described({"x": "\u200b"}) == '{"x": "\\u200b"}' and described({1}) == "set"
