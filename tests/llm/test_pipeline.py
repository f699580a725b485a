import pathlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallybook.llm import registry

from .test_models import corpus


def test_stages_on_planted_documents(spark, tmp_path):
    docs, labels = corpus(400, 2)
    long = " ".join(t for _, t, _ in docs[:8] if "vilescum" not in t and "grotzig" not in t)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in docs]
    rows += [(1000, long, "en", "s0", 0), (1001, long.replace(" ", "  "), "en", "s1", 0), (1002, long + " last", "en", "s1", 0), (1003, None, None, None, None), (1004, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(got)) <= 4
    assert {1001, 1002, 1004} & set(got) == set() and {1000, 1003} <= set(got)
    clean = {i for i, _, t in labels if not t}
    assert len(clean - set(got)) <= 8
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert got[1000].ids == library.encode(long, add_special_tokens=False).ids


def test_stages_named_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert {k.split("_")[0] for k in registry.QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}


def test_one_of_a_group_stays_whatever_links_it(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    again, one, other, clean, passage = "p q r " * 3000, words(30), words(30), words(60), words(200)
    # 3 is linked with 1 only by its close fingerprint, with 2 only by its shingle set; 10 stands for two texts
    rows = [(1, again + one), (2, "p q r p q r p q r " + other), (3, again + other), (5, passage), (10, clean), (10, passage + " more"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_out(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, rows[0][1]), (5, passage), (10, clean)} and len(got) == 3


def test_near_copies_without_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, ""), (7, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_out(spark, docs, "").collect())
    assert got == [("7", ""), ("None", "one two three four five six")]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_out, corpus_pipeline.sources_mixed, corpus_pipeline.exact_out):
        assert stage(spark, docs, "").collect() == []
    assert corpus_pipeline.tokenised(spark, docs, "").collect() == []


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs, labels = corpus(300, 5)
    toxic = {i for i, _, t in labels if t}
    one, two = next(i for i, _, t in labels if t), next(i for i, _, t in labels if not t)
    rows = [(i, t, "s", 7.5, "mine", "f", 3, "w", "dot", "r", "blk", 1) for i, t, _ in docs]
    rows += [(two, rows[two][1], *rows[0][2:]), (None, "no id, " + rows[two][1], *rows[0][2:]), (None, None, None, *[None] * 9), (None, None, None, *[None] * 9)]
    names = ["doc_id", "text", "source", "severity", "p_toxic", "__file", "__row", "__whole", "a.b", "root", "block", "__position"]
    kinds = "doc_id long, text string, source string, severity double, p_toxic string, `__file` string, `__row` int, `__whole` string, `a.b` string, root string, block string, `__position` int"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.createDataFrame(rows, kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == names
    left = table.collect()
    assert {tuple(r)[3:] for r in left} <= {r[3:] for r in rows}
    assert one not in {r.doc_id for r in left} and len(toxic & {r.doc_id for r in left}) <= 3
    assert [r.doc_id for r in left].count(two) == 1 and sum(r.text is None for r in left) == 1


def test_without_labels_nothing_is_toxic(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (None, None, None)], "doc_id long, text string, severity double")
    for table in (docs, docs.limit(0)):
        assert sorted(map(str, corpus_pipeline.toxic_out(spark, table, str(tmp_path)).collect())) == sorted(map(str, table.collect()))


def test_tables_of_a_stage_are_removed(spark, tmp_path, monkeypatch):
    docs, labels = corpus(120, 3)
    spark.createDataFrame([(i, t, "s") for i, t, _ in docs], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr("tallybook.sources.shared.uuid.uuid4", lambda names=iter(range(10**6)): type("Name", (), {"hex": f"stage-test-{next(names)}"}))
    got = corpus_pipeline.run(spark, str(tmp_path)).count()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    left = [p.name for p in pathlib.Path(base).glob("stage-test-*")]
    assert got > 60 and len(left) == 1


def test_no_stage_starts_other_python_workers(spark, tmp_path, monkeypatch):
    """A frame made of a list is an RDD of pickled rows, for which executors start a daemon with workers of its own."""
    docs, labels = corpus(120, 3)
    table = spark.createDataFrame([(i, t, "s") for i, t, _ in docs], "doc_id long, text string, source string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *_: pytest.fail("a frame made of a list"))
    toxic = corpus_pipeline.toxic_out(spark, table, str(tmp_path)).count()
    assert 0 < toxic < 120 and corpus_pipeline.sources_mixed(spark, table, str(tmp_path)).count() == 120
    assert corpus_pipeline.sources_mixed(spark, table.limit(0), str(tmp_path)).count() == 0
