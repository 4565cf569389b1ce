"""The pipeline on rows that ids don't tell apart, clashing names and empty tables, and against its operators' brute-force rules."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from spanveil.llm import common

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", _row string, _rank string, _slot string, _bucket string, _bits string, _maybe string, _id string, _n string"


def prose(rng, n=60):
    return " ".join(f"word{rng.randrange(5000)}" for _ in range(n))


def table(spark, path, rows, items=(), schema=NAMES):
    wide = schema != NAMES
    spark.createDataFrame([(*r, *"abcdefgh") if wide else r for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def row(k, t, source="s"):
    return (k, t, "en", source, 0)


@pytest.mark.parametrize("schema", [NAMES, NAMES + EXTRA])
def test_rows_without_or_with_equal_ids_are_judged_one_by_one(spark, tmp_path, schema):
    rng = random.Random(1)
    a, b, c, d, e = (prose(rng) for _ in range(5))
    item = prose(rng, 15)
    rows = [row(None, a), row(None, b), row(None, "12 34"), row(None, None), row(1, a.upper()), row(7, c), row(7, d), row(7, c), row(7, "99"), row(7, f"{e} {item}"), row(8, " ".join(["new", *d.split()[1:]]))]
    docs = table(spark, tmp_path, rows, [(1, item)], schema)
    left = docs
    texts = lambda: sorted((r.doc_id is None, r.text) for r in left.collect())
    for name, step in corpus_pipeline.STAGES[:-1]:
        left = common.stage(step(spark, left, str(tmp_path)), f"test-{name}")
        assert left.columns == docs.columns and left.schema == docs.schema
        if name == "language_id":
            assert len(texts()) == 8
        if name == "exact_dedup":
            assert texts() == sorted([(False, a.upper()), (True, b), (False, c), (False, d), (False, f"{e} {item}"), (False, " ".join(["new", *d.split()[1:]]))])
        if name == "near_dedup":
            assert texts() == sorted([(False, a.upper()), (True, b), (False, c), (False, d), (False, f"{e} {item}")])
    assert texts() == sorted([(False, a.upper()), (True, b), (False, c), (False, d)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_empty_table(spark, tmp_path):
    docs = table(spark, tmp_path, [], [(1, "some item")])
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_large_group_and_tables_that_are_no_files(spark, tmp_path):
    rng = random.Random(2)
    base, other = prose(rng), prose(rng)
    rows = [row(k, base) for k in range(200)] + [row(1000 + k, f"{base} end{k}") for k in range(200)] + [row(5000, other)]
    table(spark, tmp_path, rows)
    docs = spark.createDataFrame(rows, NAMES)
    assert {r.doc_id for r in corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()} == {0, 5000, *range(1000, 1200)}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect()} == {0, 5000}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 5000}


def test_filters_keep_columns_that_clash(spark):
    df = spark.createDataFrame([(k, "s", "m") for k in range(50)], "k long, _slot string, _maybe string")
    left = common.drop_keys(df, spark.range(0, 50, 2).withColumnRenamed("id", "k"), "k")
    assert left.columns == df.columns and {tuple(r) for r in left.collect()} == {(k, "s", "m") for k in range(1, 50, 2)}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
