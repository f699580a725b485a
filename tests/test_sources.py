"""Outputs that appear together, loads one after the other, search by trigrams, numbers in parts."""

import random

import pytest
from pyspark.sql import functions as F

from tallybook.operators import classify, insights, ranks, redact, search
from tallybook.sources import adapters, loads, publish, texts


def frame(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "v string")


def shown(spark, target):
    return {name: sorted(r.v for r in publish.published(spark, target, name).collect()) for name in publish.manifest(spark, target)}


def test_all_outputs_or_none(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    assert publish.manifest(spark, target) == {}
    publish.publish({"a": frame(spark, "1"), "b": frame(spark, "2")}, target)
    assert shown(spark, target) == {"a": ["1"], "b": ["2"]}
    fails = frame(spark, "x").select(F.raise_error(F.col("v")).cast("string").alias("v"))
    with pytest.raises(Exception, match="x"):
        publish.publish({"a": frame(spark, "3"), "b": frame(spark, "4"), "c": fails}, target, overwrite=True)
    assert shown(spark, target) == {"a": ["1"], "b": ["2"]}
    with pytest.raises(publish.Exists, match="b"):
        publish.publish({"b": fails, "c": frame(spark, "5")}, target)  # looked up before anything is written
    old = publish.manifest(spark, target)["b"]
    reader = publish.published(spark, target, "b")
    publish.publish({"b": frame(spark, "6"), "c": frame(spark, "7")}, target, overwrite=True)
    assert shown(spark, target) == {"a": ["1"], "b": ["6"], "c": ["7"]}
    assert [r.v for r in reader.collect()] == ["2"] and old != publish.manifest(spark, target)["b"]
    assert len(publish.prune(spark, target)) == 1 and shown(spark, target) == {"a": ["1"], "b": ["6"], "c": ["7"]}
    with pytest.raises(ValueError):
        publish.publish({}, target)


def files(spark, *rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_two_loads_as_one(spark, tmp_path):
    folder = f"file://{tmp_path}/registry"
    rows = [("p1", "A"), ("p2", "B"), ("p3", "A"), ("p4", "C"), ("p5", "B"), ("p6", None), ("p7", "D"), ("p8", "D"), ("p9", "E")]
    once, dropped = texts.distinct_texts(files(spark, *rows))
    want = sorted(r.path for r in once.collect()), sorted(r.path for r in dropped.collect())
    kept, gone = [], []
    for name, part in (("one", rows[:4]), ("two", rows[4:])):
        for _ in range(2):  # a repeated load gives the same
            found = [sorted(r.path for r in x.collect()) for x in loads.load(files(spark, *part), folder, name)]
        kept, gone = kept + found[0], gone + found[1]
    assert (kept, gone) == want
    again, late = loads.load(files(spark, *rows), folder, "three")
    assert again.collect() == [] and {r.path: r.message for r in late.collect()}["p2"] == "Duplicate file content, first loaded as p2"
    assert sorted(r.path for r in loads.registry(spark, folder).collect()) == want[0]


def test_search_reads_what_can_match(spark):
    rng = random.Random(3)
    words = ["Pilot Travel", "ACME CO", "Bolt", "old anvil", "él ñandú", "x", "GOLDEN rod"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))) + f" {i % 97}") for i in range(2000)] + [(2000, None), (2001, "")]
    tx = spark.createDataFrame(rows, "n int, description string").withColumn("is_credit", F.lit(False))
    dictionary = classify.dictionary(tx, classify.ordered())
    found = search.index(dictionary)
    carried = classify.with_dictionary(tx, dictionary)
    for text in ("old", "OLD", "golden rod", "ñand", "x", "co b", "no such text", "9", "t t", ""):
        got = sorted(r.n for r in search.holding(carried, dictionary, found, text).collect())
        assert got == [n for n, t in rows if t is not None and text.lower() in t.lower()], text
    both = sorted(r.n for r in search.holding(carried, dictionary, found, "old", "pilot").collect())
    assert both == [n for n, t in rows if t and "old" in t.lower() and "pilot" in t.lower()]
    for text in ("golden", "travel"):
        can, does = search.candidates(found, text).count(), search.matching(dictionary, found, text).count()
        assert does <= can < dictionary.count() / 2
    plan = search.candidates(found, "golden")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "gram IN" in plan


def test_numbers_in_parts(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "a"]), rng.choice([0, -5, 1, 99, 100, 12345, 10**12]) + rng.randrange(3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, i int").withColumn("amount", (F.col("v") / 100).cast("decimal(18,2)")).repartition(5)
    got = ranks.numbered(df, ["g"], ranks.falling(F.col("amount")), [F.desc("v"), "i"])
    parts = got.select("g", ranks.falling(F.col("amount")).alias("p")).distinct().count()
    for g in "ab":
        order = [r.i for r in sorted(got.where(F.col("g") == g).collect(), key=lambda r: r.n)]
        assert order == [i for _, _, i in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))]
    assert parts > 8
    assert ranks.numbered(df.limit(0), ["g"], F.col("v"), ["i"]).collect() == []


def test_cells_of_whatever_months(spark):
    rows = [("Rent", "2023-01-05", 5, False), ("Rent", "2024-02-05", 7, False), ("Fun", "2023-01-09", 1, False), ("Pay", "2025-01-01", 9, True)]
    tx = spark.createDataFrame([(1, c, d, a, k) for c, d, a, k in rows], "account_id int, category string, post_dt string, amount int, is_credit boolean").withColumns({"post_dt": F.to_date("post_dt"), "amount": F.col("amount").cast("decimal(18,2)")})
    got = sorted((r.category, r.period, int(r.amount)) for r in insights.category_cells(tx).collect())
    assert got == [("Fun", "2023-01", 1), ("Fun", "2024-02", 0), ("Rent", "2023-01", 5), ("Rent", "2024-02", 7)]


def test_pseudonyms_over_parts(spark):
    df = spark.createDataFrame([(1, f"v{i % 40}", i // 10, i) for i in range(200)], "account_id int, v string, month int, n int")
    got = {r.key: r.pseudonym for r in redact.pseudonyms(df, F.col("v"), [F.col("month"), F.col("n")], "Vendor").collect()}
    assert got == {f"v{i}": f"Vendor {i + 1:03d}" for i in range(40)}


def test_statement_names(spark):
    names = ["a/b.txt", "a/B.TXT", "a/b.pdf", "a/my_Personal_Financial_Report.txt", "business_financial_report_2.txt", "b.txt.bak"]
    got = [r.v for r in frame(spark, *names).where(texts.statement_file(F.col("v"))).collect()]
    assert got == names[:2] and adapters.described("n", "m") is not None


def test_outputs_take_little_room(spark, tmp_path):
    """What is published stays beside what it replaces until the end: compressed, and read back as it was."""
    rows = spark.range(20000).select(F.concat(F.lit("a cell as in every other row "), F.col("id").cast("string")).alias("v"))
    size = lambda at: sum(p.stat().st_size for p in at.rglob("part-*"))
    publish.publish({"a": rows}, f"file://{tmp_path}/plain")
    publish.publish({"a": rows}, f"file://{tmp_path}/small", compression="gzip")
    assert size(tmp_path / "small") < size(tmp_path / "plain") / 3
    assert publish.published(spark, f"file://{tmp_path}/small", "a").exceptAll(rows).isEmpty() and publish.published(spark, f"file://{tmp_path}/small", "a").count() == 20000


def test_extracts_are_published_compressed(spark, tmp_path, monkeypatch):
    from tallybook.plans import queries

    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}/out")
    assert queries.QUERIES["s11_publish"](spark, "/root/testdata/sf0.001").count() > 0
    names = [p.name for p in (tmp_path / "out").rglob("part-*")]
    assert names and all(n.endswith(".csv.gz") for n in names)
