import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are absent")
def test_stages_keep_the_columns_and_only_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, before = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.6 * len(ids), name
        ids, before = kept, after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, no rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lost string, score string"
    long = " ".join(f"word{k * k % 7919}" for k in range(40_000))
    rows = [(0, "some plain text of a few words", "en", "a", 30, "x", "y"), (0, "some plain text of a few words", "en", "a", 30, "x", "y"), (1, "", None, None, None, None, None), (2, None, None, None, None, None, None), (3, long, "en", "b", len(long), None, None), (None, "words under no id at all", "en", "a", 24, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "an item that no text has"), (1, None), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame, least in ((spark.createDataFrame(rows, schema), 6), (spark.createDataFrame([], schema), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, frame, str(tmp_path))
            assert after.columns == frame.columns and after.count() >= least, name
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert bool(packed) == bool(least)


def test_near_copies_of_its_own_input_are_caught(spark):
    """The near-duplicate stage against all pairs of what line dedup leaves."""
    from tests.llm.test_corpus import plain_near

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.line_dedup(spark, docs, SF).cache()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, left, SF).collect()}
    want = plain_near({r.doc_id: r.text for r in left.collect()}, 5, 80)
    assert kept == {i for i, (_, component) in want.items() if i == component}


def test_sql_is_text_of_listed_queries():
    from snapweave.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries()) and all(isinstance(x, str) for x in queries.oracle_sql().values())
    assert sorted(int(name.split("_")[0][2:]) for name in queries.queries() if name.startswith("op")) == list(range(1, 14))
