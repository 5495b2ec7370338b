"""The stages one by one against what their operators say, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_contained, brute_fingerprint, prose


def test_stages(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(docs)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
    texts = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]
    all_texts = {r.doc_id: r.text for r in documents.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    lost = set(all_texts) - set(texts[0])
    assert sum(labels.get(i) == 0 for i in lost) <= 1
    norm = {i: " ".join(t.split()) for i, t in texts[0].items()}
    assert set(texts[1]) == {min(i for i in norm if norm[i] == norm[j]) for j in norm}
    prints = {i: brute_fingerprint(t) for i, t in texts[1].items()}
    ids = sorted(prints)
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    assert set(texts[2]) == {root(i) for i in ids}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contained(list(texts[2].items()), items)}
    assert set(texts[3]) == set(texts[2]) - bad
    assert {r.doc_id for r in kept[-1].select("doc_id").distinct().collect()} == set(texts[3])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["mark", "score", "fp", "group", "_sha", "sha", "h", "words", "kept", "head", "times", "_mark", "_lost_id", "predicted", "word", "anchor", "bucket", "target", "held_out"]


def frame(spark, rows):
    """Rows (doc_id, text), each with a number in a column of its own, and columns whose names the stages might use."""
    made = spark.createDataFrame([(i, t, "en", "s", 0, n) for n, (i, t) in enumerate(rows)], COLUMNS + ", n long")
    return made.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def left(stage, spark, docs, sf_dir, tmp_path):
    """The numbers of the rows that a stage leaves, which are as they were."""
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    return sorted(r.n for r in rows)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with labels that tell toxic words, and a benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    r = random.Random(1)
    rows = [(i, " ".join([*prose(i, 40).split()[:20], *(r.sample(["dimwit", "scumbag", "nitwit"], 2) if i % 4 == 0 else []), *prose(i, 40).split()[20:]])) for i in range(1000, 1400)]
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(500, 30)), (None, "x y z"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_toxic_rows_go_and_clean_ones_of_their_id_stay(spark, small, tmp_path):
    folder, known = small
    bad, good = prose(71, 20) + " dimwit scumbag d1mw1t " + prose(72, 20), prose(73, 60)
    own = [(7, bad), (7, good), (None, bad), (None, good), (8, None), (9, ""), (7, good), (10, "word " * 40_000)]
    docs = frame(spark, own + known)
    assert [n for n in left(corpus_pipeline.drop_toxic, spark, docs, folder, tmp_path) if n < len(own)] == [1, 3, 4, 5, 6, 7]
    assert left(corpus_pipeline.drop_toxic, spark, frame(spark, []), folder, tmp_path) == []


def test_one_row_of_equal_texts_stays(spark, small, tmp_path):
    long = "word " * 40_000
    rows = [(5, "a b"), (3, "a  b"), (3, "a\tb"), (None, "a b"), (3, "other"), (None, "c"), (None, "c "), (None, None), (4, ""), (6, None), (8, long), (2, long + " "), (2, "c")]
    got = left(corpus_pipeline.drop_exact_copies, spark, frame(spark, rows), small[0], tmp_path)
    # of "a b" one of the two rows with id 3; "c" and "c " differ; of null and empty the least id, of the long texts id 2
    assert len([n for n in got if n in (1, 2)]) == 1 and [n for n in got if n not in (1, 2)] == [4, 6, 8, 11, 12]
    assert left(corpus_pipeline.drop_exact_copies, spark, frame(spark, []), small[0], tmp_path) == []


def test_one_row_of_near_copies_stays(spark, small, tmp_path):
    words = prose(81, 400).split()
    near = [*words[:200], "changed", *words[201:]]
    far = prose(82, 400)
    assert (brute_fingerprint(" ".join(words)) ^ brute_fingerprint(" ".join(near))).bit_count() <= 3 < (brute_fingerprint(far) ^ brute_fingerprint(" ".join(words))).bit_count()
    rows = [(7, " ".join(words)), (7, far), (5, " ".join(near)), (None, " ".join(words)), (None, far), (9, None), (8, ""), (None, " \n"), (11, "word " * 40_000), (12, "word " * 40_001), (5, " ".join(near))]
    got = left(corpus_pipeline.drop_near_copies, spark, frame(spark, rows), small[0], tmp_path)
    assert [n for n in got if n not in (2, 10)] == [1, 6, 8] and len(got) == 4
    nulls = [(None, "one two three four"), (None, "one two three four"), (None, "ONE two three four")]
    assert len(left(corpus_pipeline.drop_near_copies, spark, frame(spark, nulls), small[0], tmp_path)) == 1
    assert left(corpus_pipeline.drop_near_copies, spark, frame(spark, []), small[0], tmp_path) == []


def test_contaminated_rows_go_and_clean_ones_of_their_id_stay(spark, small, tmp_path):
    item = prose(500, 30)
    rows = [(1, f"{prose(91, 50)} {item} {prose(92, 50)}"), (1, prose(93, 90)), (None, item), (None, prose(94, 90)), (2, None), (3, ""), (4, f"{'word ' * 40_000} {item.upper()}"), (1, prose(93, 90))]
    assert left(corpus_pipeline.drop_contaminated, spark, frame(spark, rows), small[0], tmp_path) == [1, 3, 4, 5, 7]
    assert left(corpus_pipeline.drop_contaminated, spark, frame(spark, []), small[0], tmp_path) == []


def test_every_row_is_packed(spark, small):
    rows = [(1, "a"), (1, "a"), (None, None), (None, "b"), (2, "word " * 40_000), (3, "")]
    got = corpus_pipeline.pack_all(spark, frame(spark, rows), small[0]).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    assert corpus_pipeline.pack_all(spark, frame(spark, []), small[0]).count() == 0


def test_run_leaves_the_last_stage_alone_in_the_shared_folder(spark, small, tmp_path, monkeypatch):
    folder, known = small
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in known[:60]], COLUMNS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda s: str(tmp_path))
    assert corpus_pipeline.run(spark, folder).count() > 0
    (run,) = tmp_path.iterdir()
    assert [p.name for p in run.iterdir()] == ["4-packing"]
